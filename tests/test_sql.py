"""SQL text gives what the queries give."""

from collections import Counter

from pyspark.sql import functions as F

from siftwell.functions import sniff, sql
from siftwell.queries import pages
from siftwell.sources.inputs import from_pages

SF = "/root/testdata/sf0.001"


def bag(rows):
    return Counter(tuple(r[c] for c in sorted(r.asDict())) for r in rows.collect())


def test_types_in_sql(spark):
    sql.register_types(spark)
    blobs = [bytes.fromhex("00" * at + code) for at, code, _ in sniff.MAGIC] + [b"", None, b"x", b"<!DOCTYPE HTML>"]
    names = ["a/b.tar.PNG", ".htm", "x", "a.doc", "p.mjs?x=y.png", "http://h/p.css#a", None, "é.tif"]
    headers = ["text/html; charset=utf-8", None, "Application/PDF", "x/unknown", " image/JPG ", "text/jscript"]
    rows = [(b, h, n) for b in blobs for h in headers for n in names]
    table = spark.createDataFrame(rows, "data binary, header string, name string")
    table.createOrReplaceTempView("blobs")
    declared, sniffed = sniff.declared(F.col("header"), F.col("name")), sniff.sniffed(F.col("data"))
    expected = table.select(sniffed.alias("a"), declared.alias("b"), sniff.effective(sniffed, declared).alias("c"))
    assert bag(spark.sql("SELECT sniff(data) AS a, declared_type(header, name) AS b, effective_type(data, header, name) AS c FROM blobs")) == bag(expected)
    assert "Python" not in spark.sql("SELECT sniff(data) FROM blobs")._jdf.queryExecution().toString()


def test_reports_in_sql(spark):
    sql.create_views(from_pages(pages.read(spark, SF, "pages")), pages.POLICY, *pages.lists(spark))
    reports = spark.sql("""SELECT id AS page_id, status, bucket, bytes_in, bytes_out, CAST(size(actions) AS BIGINT) AS n_actions, CAST(size(filter(actions, a -> a.rule_id = 'html.script.disallowed')) AS BIGINT) AS n_scripts,
                                  sha2(output, 256) AS output_sha256 FROM sanitised""")
    assert bag(reports) == bag(pages.page_reports(spark, SF))
    assert bag(spark.sql("SELECT rule_id, category, action, count(*) AS n FROM sanitised_actions GROUP BY ALL")) == bag(pages.page_rule_counts(spark, SF))
    assert spark.sql("SELECT count(*) AS n FROM sanitised_references").first().n >= 0
    sql.create_url_view(pages.read(spark, SF, "pages"), *pages.lists(spark))
    assert bag(spark.sql("SELECT label, count(*) AS n FROM classified GROUP BY label")) == bag(pages.url_labels(spark, SF))
