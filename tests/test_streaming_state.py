"""Streams with state that expires, restarts and begins with what is known; summaries observed while reports are written."""

import time

import pytest

from siftwell.plans import pipeline
from siftwell.streaming import stateful
from siftwell.streaming.streams import sanitise_batches, submissions


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(stateful.PROVIDER)
    spark.conf.set(stateful.PROVIDER, stateful.ROCKSDB)
    yield spark
    spark.conf.set(stateful.PROVIDER, before)


def run(stream, tmp_path, name, rows):
    """One run of a query until ``rows`` more rows have come; its results so far. (A query with times to live has always another batch to run.)"""
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    came, last = 0, -1
    for _ in range(600):
        for p in query.recentProgress:
            if p["batchId"] > last:
                came, last = came + p["numInputRows"], p["batchId"]
        if came >= rows or not query.isActive:
            break
        time.sleep(0.1)
    query.stop()
    assert came >= rows
    return stream.sparkSession.read.parquet(str(tmp_path / name))


def test_a_restarted_query_knows_its_submissions(rocksdb, tmp_path):
    spark, schema = rocksdb, "id string, data string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([("a", "1"), ("b", "1"), ("a", "1"), ("old", "1")])
    known = spark.createDataFrame([("old",)], "id string")
    new = lambda: stateful.new_submissions(submissions(spark, str(tmp_path / "in"), schema), 3_600_000, known=known)
    assert sorted((r.id, r.data) for r in run(new(), tmp_path, "out", 4).collect()) == [("a", "1"), ("b", "1")]
    put([("b", "2"), ("c", "2"), ("old", "2")])  # after a restart
    assert sorted((r.id, r.data) for r in run(new(), tmp_path, "out", 3).collect()) == [("a", "1"), ("b", "1"), ("c", "2")]


def test_verdicts_expire_and_begin_with_known_ones(rocksdb, tmp_path):
    spark, schema = rocksdb, "key string, at long, allowed boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("bad", False), ("mixed", True), ("mixed", False), ("good", True)], "key string, allowed boolean")
    put([("bad", 1, True), ("mixed", 1, True), ("good", 1, False), ("x", 1, True), ("x", 2, False), ("y", 1, False), ("y", 2, True)])
    looked = lambda: stateful.remembered_verdicts(submissions(spark, str(tmp_path / "in"), schema), 4_000, known)
    found = sorted((r.key, r.allowed, r.hit) for r in run(looked(), tmp_path, "out", 7).collect())
    assert found == [("bad", False, True), ("good", True, True), ("mixed", False, True), ("x", True, False), ("x", True, True), ("y", False, False), ("y", False, True)]
    time.sleep(5)
    put([("x", 3, False), ("good", 3, False), ("bad", 3, True)])
    again = sorted((r.key, r.allowed, r.hit) for r in run(looked(), tmp_path, "out", 3).collect())
    for row in found:
        again.remove(row)
    assert again == [("bad", False, True), ("good", False, False), ("x", False, False)]


def test_state_with_a_time_to_live_needs_rocksdb(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        stateful.new_submissions(spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS id"), 1)


def test_the_summary_is_observed_in_the_one_write(spark, tmp_path):
    statuses = ["clean", "clean", "sanitised", "refused", "budget_exceeded", "ssrf_blocked", "fetch_error"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(statuses)], "id long, status string").withColumn("bucket", pipeline.bucket(pipeline.F.col("status"))).repartition(3)
    rows.count()
    counted = lambda: spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()
    before = counted()
    summary, code = pipeline.write_reports(rows, str(tmp_path / "reports"))
    assert counted() == before + 1 and code == 1
    assert summary == pipeline.run_summary(rows).first().asDict() and spark.read.parquet(str(tmp_path / "reports")).count() == 7
    assert pipeline.write_reports(rows.where("id < 3"), str(tmp_path / "some"))[1] == 0 and pipeline.write_reports(rows.where("id < 0"), str(tmp_path / "none"))[0]["inputs_total"] == 0
    subs = spark.createDataFrame([(1, "clean", ["clean", "refused", "ssrf_blocked"]), (2, "refused", None), (3, "ssrf_blocked", ["sanitised"])], "id long, status string, s array<string>")
    whole = subs.select("id", "status", pipeline.bucket(pipeline.F.col("status")).alias("bucket"), pipeline.F.transform("s", lambda x: pipeline.F.struct(x.alias("status"))).alias("subresources"))
    flat = whole.selectExpr("explode(subresources) AS s").selectExpr("s.status AS status")
    assert pipeline.write_reports(whole, str(tmp_path / "whole"))[0] == pipeline.run_summary(whole, flat).first().asDict()


def test_batches_report_their_summaries(spark, tmp_path):
    spark.createDataFrame([(1, "clean"), (2, "refused")], "id long, status string").write.parquet(str(tmp_path / "in"))
    got = {}
    process = lambda batch: batch.withColumn("bucket", pipeline.bucket(pipeline.F.col("status")))
    query = sanitise_batches(submissions(spark, str(tmp_path / "in"), "id long, status string"), process, str(tmp_path / "out"), str(tmp_path / "state"), got.__setitem__)
    query.processAllAvailable()
    query.stop()
    assert {k: (v["inputs_total"], v["inputs_refused"]) for k, v in got.items()} == {0: (2, 1)}
