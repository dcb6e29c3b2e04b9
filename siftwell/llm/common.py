"""Helpers that several corpus operators share: word expressions, row keys, lineage cuts and bounded joins."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What separates words: runs of ASCII white space (so words are ``[^\x20\x09-\x0D]+``).
SPACES = r"[\x20\x09-\x0D]+"
#: Runs of ASCII other than letters and digits (so words are ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A lookup table is broadcast up to this many rows; beyond it a salted shuffle join takes over.
BROADCAST_ROWS = 200_000
#: Copies of a lookup row in a salted join: a key with a third of all rows is dealt to as many tasks.
SALTS = 64
#: In a shuffle join by a key with known counts, keys with more rows are joined by broadcast.
HOT_ROWS = 1_000_000
#: A table of links or pointers with up to so many rows is kept in one partition.
FEW_ROWS = 1 << 16


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, between: str = SPACES) -> Column:
    """The words of a text in order; null and empty texts have none. (Splitting is several times faster than extracting.)"""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between), lambda w: w != "")


def word_count(text: Column, between: str = SPACES) -> Column:
    """The number of words: of the parts of the split, only the first and the last can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), between)
    ends = F.when(F.size(parts) == 1, (F.get(parts, F.lit(0)) == "").cast("int")).otherwise(
        (F.get(parts, F.lit(0)) == "").cast("int") + (F.get(parts, F.size(parts) - 1) == "").cast("int"))
    return (F.size(parts) - ends).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``, as a whole URI (a path without a scheme is in the cluster's
    own file system); only where the setting is unset (tests, one machine) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        found = f"file://{tempfile.gettempdir()}/siftwell-checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file:///{whole[6:].lstrip('/')}" if whole.startswith("file:/") else whole


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def cut_few(df: DataFrame, *also: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, with the number of rows (``n``) and the aggregates ``also``, which are observed while the rows are written.

    Up to FEW_ROWS rows are one partition from then on: the driver keeps a record of every task and every query, so rounds over a
    few rows mustn't take hundreds of tasks each, nor queries that only ask whether there is a row.
    """
    seen = Observation()
    rows = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *also))
    return (rows.coalesce(1) if seen.get["n"] <= FEW_ROWS else rows), seen.get


def column_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: int, seed: Column, how: str = "left") -> DataFrame:
    """Rows with the columns of a lookup table that has one row per ``key`` (null matches null).

    ``count`` is the lookup's known row count. Up to BROADCAST_ROWS it is broadcast. Beyond that both sides shuffle,
    and each key is dealt over SALTS tasks by ``seed``, so that a key with a third of all rows stays spread.
    """
    at = column_name(rows, "_lookup_key")
    right = lookup.withColumnRenamed(key, at)
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(right), rows[key].eqNullSafe(right[at]), how).drop(at)
    salt, other = column_name(rows, "_salt"), column_name(rows, "_salt_of")
    left = rows.withColumn(salt, F.pmod(F.xxhash64(seed), F.lit(SALTS)))
    right = right.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, left[key].eqNullSafe(right[at]) & (left[salt] == right[other]), how).drop(at, salt, other)


def join_counted(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a lookup table knows, with its columns. It has one row per key and in ``n`` how many rows have the key.

    The table may grow with the corpus, so it isn't broadcast: this is a shuffle join, but for the keys with over HOT_ROWS rows.
    These are few (rows / HOT_ROWS at most) and are broadcast by themselves, so no key brings more rows into one task.
    """
    hot, seen = cut_few(lookup.where(F.col("n") > HOT_ROWS))
    if not seen["n"]:
        return rows.join(lookup, keys)
    usual = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(lookup.where(F.col("n") <= HOT_ROWS), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(usual)


#: Bytes of the rows that a Python worker gets at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands BATCH_BYTES of rows at once to Python, unless it has been told how many: both the worker and the
    executor's JVM hold whole batches beside their heaps."""
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if most not in spark.conf.getAll:
        spark.conf.set(most, str(BATCH_BYTES))


#: What this Python worker keeps between tasks: for each thing, how to let go of it.
_kept: set[Callable[[], object]] = set()


def keep(release: Callable[[], object]) -> None:
    """Tells that this worker keeps something for later tasks of its kind, which ``release`` frees."""
    _kept.add(release)


def let_go() -> None:
    """Frees what other operators keep in this worker; called where a task of another kind begins.

    Spark hands a worker from one stage to the next, so what one stage keeps would stand beside all that the next ones take.
    """
    if _kept:
        while _kept:
            _kept.pop()()
        gc.collect()
        pa.default_memory_pool().release_unused()


#: The folders that this driver has made in the shared one and not removed yet.
_folders: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, until ``clean_up``."""
    import uuid

    _folders.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def clean_up(spark: SparkSession) -> int:
    """Removes the staged tables, models and shards that this driver's operators have made; how many. Results that aren't written yet
    are lost with them."""
    removed = 0
    while _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        removed += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def stage(df: DataFrame) -> DataFrame:
    """The rows, written as compressed Parquet to the shared folder and read back; for wide rows, where ``cut`` would write them plain."""
    path = new_folder(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
