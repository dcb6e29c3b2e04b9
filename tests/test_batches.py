import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.plans import pipeline
from siftwell.policy import Policy
from siftwell.sources import staging
from test_plans import lists


def batch_bytes(df):
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
    return [r.n for r in sizes.collect()]


def test_python_gets_pages_in_small_batches(spark):
    pages = spark.range(0, 3000, 1, 1).select("id", F.lit("p.html").alias("name"), F.encode(F.repeat(F.lit("<p>some text</p>"), 512), "UTF-8").alias("data"), F.lit("text/html").alias("declared_header"))
    spark.conf.unset(staging._MOST)
    try:
        rows = pipeline.process(pages, Policy(), *lists(spark))
        sizes = batch_bytes(pages.select("data"))
        assert len(sizes) > 1 and max(sizes) < 2 * staging.BATCH_BYTES
        assert rows.where("status = 'clean' AND bytes_in = 8192 AND bytes_out = 8192").count() == 3000
        spark.conf.set(staging._MOST, str(1 << 20))  # what a session has been told stays
        pipeline.process(pages, Policy(), *lists(spark))
        assert max(batch_bytes(pages.select("data"))) < 2 << 20
    finally:
        spark.conf.unset(staging._MOST)
