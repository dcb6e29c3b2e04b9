"""Cutting lineage: narrow tables that several parts of a plan read are written once to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on one machine, where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/siftwell-checkpoints"


#: Bytes of the rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20
_MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands BATCH_BYTES of rows at once to Python, unless it has been told how many.

    A worker holds two batches, what it makes of them and what its allocator keeps; with Spark's own bound (64 MB, 10,000 rows) that
    grows with the input until tasks have full batches, and a stage with several Python functions has a worker for each and core.
    """
    if _MOST not in spark.conf.getAll:
        spark.conf.set(_MOST, str(BATCH_BYTES))


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back; a lost executor loses nothing of them."""
    context = rows.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint(eager=True)


def stage(rows: DataFrame) -> DataFrame:
    """The rows, written as compressed Parquet to the shared folder and read back; for wide rows, which ``cut`` would write plain.

    The folder stays, since results are read from it later.
    """
    import uuid

    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
