"""Queries over the other tables: networks, guard decisions, scanners, evaluation, measurements and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import netaddr
from ..operators import scanners
from ..plans import evaluate, guard, subresources
from ..policy import Policy
from ..streaming.streams import event_windows
from .pages import read

SPREAD, MODULUS = 2654435761, 1 << 32


def network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.pmod(F.col("event_id") * F.lit(SPREAD), F.lit(MODULUS))
    rows = read(spark, sf_dir, "events").select("event_id", F.lit(4).alias("of_family"), netaddr.ipv4_hex(number).alias("digits"))
    found = netaddr.classify(rows, netaddr.deny_table(spark), "event_id", "of_family", "digits")
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def guard_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    host = lambda c: F.concat(F.lit("h"), c.cast("string"))
    number = lambda n: F.pmod((F.col("c_custkey") * 7 + n) * F.lit(SPREAD), F.lit(MODULUS))
    dns = customers.select(host(F.col("c_custkey")).alias("host"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), "c_custkey").select("host", "ord", F.lit(4).alias("family"), netaddr.ipv4_hex(number(F.col("ord"))).alias("digits"))
    requests = orders.select(F.col("o_orderkey").alias("request_id"), host(F.col("o_custkey")).alias("host"), F.lit(80).alias("port"), F.lit(None).cast("string").alias("endpoint"))
    found = guard.decide(requests, dns, netaddr.deny_table(spark))
    return found.groupBy("allowed", "rule").agg(F.count("*").alias("n"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda k: (F.pmod(F.col("p_partkey") * F.lit(k), F.lit(12_000)) + 1)
    digits = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), digits(side(7919)), digits(side(104729)), F.lit("0806000000")))
    rows = read(spark, sf_dir, "part").select("p_partkey", png.alias("data"), F.lit("image/png").alias("mime"))
    found = scanners.scan(F.col("data"), F.col("mime"), Policy())
    return rows.select("p_partkey", (F.size(found) > 0).alias("over_budget"))


def entity_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML whose innermost entity has p_size characters and whose others each refer ten times to the one before."""
    depth = (F.col("p_partkey") % 8).cast("int")
    link = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.concat(F.lit("<!ENTITY e"), k.cast("string"), F.lit(' "'), F.repeat(F.concat(F.lit("&e"), (k - 1).cast("string"), F.lit(";")), F.lit(10)), F.lit('">')))
    body = F.concat(F.lit("<?xml version=\"1.0\"?><!DOCTYPE r ["), F.lit('<!ENTITY e0 "'), F.repeat(F.lit("x"), F.col("p_size")), F.lit('">'), F.when(depth > 0, F.array_join(link, "")).otherwise(""), F.lit("]><r/>"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.encode(body, "UTF-8").alias("data"))
    found = scanners.scan(F.col("data"), F.lit("application/xml"), Policy())
    return rows.select("p_partkey", F.get(found, F.lit(0))["rule"].alias("rule"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``labels`` as ground truth for two rules on ``documents``: a measured table as ``evaluate.measure`` gives it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("category"), F.coalesce("text", F.lit("")).alias("text"))
    truth = read(spark, sf_dir, "labels").join(docs, "doc_id")
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]", "")) * 50 > F.length("text")
    short = F.length("text") < 200
    none = F.array().cast("array<string>")
    rules = F.when(F.col("quality") == 0, F.array(F.lit("symbols"))).otherwise(none)
    samples = truth.select(F.when(F.col("quality") == 0, "malicious").otherwise("benign").alias("kind"), F.col("doc_id").cast("string").alias("name"), "category", F.array(F.lit("sanitised"), F.lit("clean")).alias("status"),
                           rules.alias("rules"), none.alias("allowed"), F.array(F.lit("short")).alias("forbidden_rules"), F.array(F.lit("AKIA")).alias("forbidden"), none.alias("preserved"))
    fired = F.concat(F.when(symbols, F.array(F.lit("symbols"))).otherwise(none), F.when(short, F.array(F.lit("short"))).otherwise(none))
    results = truth.select(F.when(F.col("quality") == 0, "malicious").otherwise("benign").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.when(F.size(fired) > 0, "sanitised").otherwise("clean").alias("status"), fired.alias("fired"), F.col("text").alias("output"))
    return evaluate.measure(samples, results)


def label_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("kind", "verdict").agg(F.count("*").alias("n"))


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rule_confusion(labelled(spark, sf_dir))


def label_category_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.category_rates(labelled(spark, sf_dir))


def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(labelled(spark, sf_dir))


def latency_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.middle(read(spark, sf_dir, "events"), "event_type", "value")


def cost_per_kib(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("us"), F.pmod(F.col("l_partkey"), F.lit(50)).alias("bytes"))
    return rows.select("l_orderkey", "l_linenumber", evaluate.per_kib(F.col("us"), F.col("bytes")).alias("us_per_kib"), F.greatest(F.col("us") - F.col("bytes"), F.lit(0)).cast("long").alias("rewrite_us"))


def speed_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("workers")).agg(F.sum("l_quantity").alias("seconds"), F.sum(F.col("l_quantity") * 2).alias("mib"))
    return evaluate.scaling(rows, "run")


def run_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("kind"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"))
    return evaluate.run_pairs(runs)


def status_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status as one printed cell for each order priority: ``status=n`` joined by spaces."""
    counts = read(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    cell = F.array_join(F.array_sort(F.collect_list(F.concat("o_orderstatus", F.lit("="), F.col("n").cast("string")))), " ")
    return counts.groupBy("o_orderpriority").agg(cell.alias("cell"))


def bucket_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..plans.pipeline import bucket

    status = F.element_at(F.array(*[F.lit(x) for x in ("sanitised", "clean", "refused", "ssrf_blocked", "fetch_error", "budget_exceeded")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "orders").select(status.alias("status")).withColumn("bucket", bucket(F.col("status")))
    return rows.rollup("bucket", "status").agg(F.count("*").alias("n"))


def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references of their order: returned ones are refused before any request, the rest have a budget of three."""
    url = F.concat_ws("/", F.lit("http://h"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", url.alias("raw"), F.lit("image").alias("kind"), (F.col("l_returnflag") == "R").alias("returned"))
    pages = rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "raw", "kind"))).alias("references"))
    pages = pages.select("id", F.lit("http://h/").alias("page_url"), F.lit(None).cast("string").alias("base"), F.transform("references", lambda r: F.struct(r["raw"].alias("raw"), r["kind"].alias("kind"))).alias("references"))
    refused = rows.where("returned").select(F.col("raw").alias("url"), F.lit("returned").alias("label")).distinct()
    found = subresources.slots(pages, 3, refused)
    line = F.element_at(F.split("url", "/"), -1).cast("int")
    return found.select(F.col("id").alias("l_orderkey"), line.alias("l_linenumber"), F.when(F.col("refusal").isNotNull(), "refused").when(F.col("over"), "budget_exceeded").otherwise("requested").alias("state"))


def truth_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents"), "doc_id")


def rule_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.words_by_cell(read(spark, sf_dir, "part"), "p_name")


def suite_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("suite"), (F.col("o_orderstatus") == "F").alias("passed"))
    return evaluate.suite_counts(judged)


def memory_growths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.pmod(F.col("p_partkey"), F.lit(40)).alias("bytes"), F.col("p_size").alias("peak_rss_kib"), F.lit(20).alias("baseline_kib"))
    return evaluate.memory_growth(rows)


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(read(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (
    network_rules, guard_decisions, image_sizes, entity_risks, label_verdicts, label_confusion, label_category_rates, label_summary, latency_middle, cost_per_kib, speed_up,
    run_comparisons, status_cells, bucket_rollup, request_budget, truth_agreement, rule_words, suite_results, memory_growths, hourly_events)}

_NETWORKS = "(VALUES " + ", ".join(f"({n}, {int(lo, 16)}, {int(hi, 16)}, '{rule}')" for n, family, lo, hi, rule in netaddr.deny_rows() if family == 4) + ") net(ord, lo, hi, rule)"
_SAMPLES = """WITH d AS (SELECT doc_id, coalesce(source, '') category, coalesce(text, '') t, quality FROM labels JOIN documents USING (doc_id)),
  m AS (SELECT *, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) * 50 > length(t) AS sym, length(t) < 200 AS short, contains(lower(t), 'akia') AS leak, quality = 0 AS bad FROM d),
  v AS (SELECT *, CASE WHEN bad AND leak THEN 'leaked' WHEN bad AND NOT sym THEN 'mislabelled' WHEN bad THEN 'detected' WHEN sym OR short THEN 'false_positive' ELSE 'clean' END AS verdict, CASE WHEN bad THEN 'malicious' ELSE 'benign' END AS kind FROM m)"""
ORACLES = {
    "rule_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(coalesce(p_name, ''), ' ')) AS word FROM part) WHERE word <> '' GROUP BY 1",
    "suite_results": "SELECT o_orderpriority AS suite, count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS passed, count_if(o_orderstatus <> 'F')::BIGINT AS failed FROM orders GROUP BY 1",
    "memory_growths": "SELECT p_partkey AS name, p_partkey % 40 AS bytes, greatest(p_size - 20, 0)::BIGINT AS growth_kib, CASE WHEN p_partkey % 40 = 0 THEN 'n/a' ELSE printf('%.3f', greatest(p_size - 20, 0) * 1024 / (p_partkey % 40)) END AS bytes_per_input_byte FROM part",
    "network_rules": f"SELECT rule, count(*) AS n FROM (SELECT event_id, arg_min(rule, ord) rule FROM events JOIN {_NETWORKS} ON (event_id::HUGEINT * {SPREAD}) % {MODULUS} BETWEEN lo AND hi GROUP BY 1) GROUP BY 1",
    "guard_decisions": f"""WITH a AS (SELECT c_custkey, ord, ((c_custkey::HUGEINT * 7 + ord) * {SPREAD}) % {MODULUS} ip FROM customer, (VALUES (0), (1)) o(ord)),
  r AS (SELECT c_custkey, a.ord, arg_min(rule, net.ord) rule FROM a JOIN {_NETWORKS} ON ip BETWEEN lo AND hi GROUP BY ALL), f AS (SELECT c_custkey, arg_min(rule, ord) rule FROM r GROUP BY 1)
  SELECT rule IS NULL AND c_custkey IS NOT NULL AS allowed, rule, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN f USING (c_custkey) GROUP BY 1, 2""",
    "image_sizes": "SELECT p_partkey, ((p_partkey * 7919) % 12000 + 1) * ((p_partkey * 104729) % 12000 + 1) > 50000000 AS over_budget FROM part",
    "entity_risks": "SELECT p_partkey, CASE WHEN p_size * 10 ** (p_partkey % 8) > 10485760 THEN 'scan.xml.entity_expansion' ELSE 'scan.xml.xxe' END AS rule FROM part",
    "label_verdicts": f"{_SAMPLES} SELECT kind, verdict, count(*) AS n FROM v GROUP BY ALL",
    "label_confusion": f"""{_SAMPLES}, r AS (SELECT 'symbols' AS rule, count_if(bad)::BIGINT AS expected, count_if(sym)::BIGINT AS fired, count_if(bad AND sym)::BIGINT AS true_positive, count_if(bad AND NOT sym)::BIGINT AS false_negative, count_if(NOT bad AND sym)::BIGINT AS false_positive FROM v
  UNION ALL SELECT 'short', 0, count_if(short)::BIGINT, 0, 0, count_if(NOT bad AND short)::BIGINT FROM v)
  SELECT *, CASE WHEN true_positive + false_positive = 0 THEN 'n/a' ELSE printf('%.4f', true_positive / (true_positive + false_positive)) END AS precision, CASE WHEN true_positive + false_negative = 0 THEN 'n/a' ELSE printf('%.4f', true_positive / (true_positive + false_negative)) END AS recall
  FROM r WHERE expected + fired > 0""",
    "label_category_rates": f"{_SAMPLES} SELECT kind, category, count_if(verdict IN ('detected', 'clean', 'mislabelled'))::BIGINT AS numerator, count(*) AS denominator, printf('%.4f', count_if(verdict IN ('detected', 'clean', 'mislabelled')) / count(*)) AS rate FROM v GROUP BY GROUPING SETS ((kind, category), (kind))",
    "label_summary": f"""{_SAMPLES}, l AS (SELECT 'detection_rate' AS metric, kind, count_if(verdict IN ('detected', 'mislabelled'))::BIGINT AS numerator, count(*) AS denominator FROM v WHERE bad GROUP BY 2
  UNION ALL SELECT 'rule_accuracy', kind, count_if(sym)::BIGINT, count(*) FROM v WHERE bad GROUP BY 2 UNION ALL SELECT 'leak_rate', kind, count_if(leak)::BIGINT, count(*) FROM v WHERE bad GROUP BY 2
  UNION ALL SELECT 'false_negative_rate', kind, count_if(verdict NOT IN ('detected', 'mislabelled'))::BIGINT, count(*) FROM v WHERE bad GROUP BY 2
  UNION ALL SELECT 'false_positive_rate', kind, count_if(verdict = 'false_positive')::BIGINT, count(*) FROM v WHERE NOT bad GROUP BY 2
  UNION ALL SELECT CASE WHEN bad THEN 'detection_rate.' ELSE 'clean_rate.' END || category, kind, count_if(verdict IN ('detected', 'mislabelled', 'clean'))::BIGINT, count(*) FROM v GROUP BY 1, 2)
  SELECT metric, kind, numerator, denominator, printf('%.2f', 100.0::DOUBLE * numerator / denominator) AS rate FROM l""",
    "latency_middle": "SELECT event_type, count(value) AS n, min(value) AS low, list_sort(list(value))[count(value) // 2 + 1] AS middle, max(value) AS high FROM events WHERE value IS NOT NULL GROUP BY 1",
    "cost_per_kib": "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 = 0 THEN 'n/a' ELSE printf('%.3f', l_quantity::BIGINT * 1024 / (l_partkey % 50)) END AS us_per_kib, greatest(l_quantity::BIGINT - l_partkey % 50, 0)::BIGINT AS rewrite_us FROM lineitem",
    "speed_up": "WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) l_quantity FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS run, l_linenumber AS workers, l_quantity AS batch_seconds, l_quantity * 2 / l_quantity AS mib_per_second, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / l_quantity AS speedup, first_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) / l_quantity / l_linenumber AS efficiency FROM l",
    "run_comparisons": "SELECT a.n_regionkey AS kind, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "status_cells": "SELECT o_orderpriority, string_agg(o_orderstatus || '=' || n, ' ' ORDER BY o_orderstatus || '=' || n) AS cell FROM (SELECT o_orderpriority, o_orderstatus, count(*) n FROM orders GROUP BY 1, 2) GROUP BY 1",
    "bucket_rollup": """WITH s AS (SELECT (['sanitised', 'clean', 'refused', 'ssrf_blocked', 'fetch_error', 'budget_exceeded'])[o_orderkey % 6 + 1] AS status FROM orders)
  SELECT CASE WHEN status IN ('sanitised', 'clean') THEN 'ok' WHEN status = 'fetch_error' THEN 'errored' ELSE 'refused' END AS bucket, status, count(*) AS n FROM s GROUP BY ROLLUP (bucket, status)""",
    "request_budget": """WITH d AS (SELECT l_orderkey, l_linenumber, max((l_returnflag = 'R')::INT) AS returned FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, CASE WHEN returned = 1 THEN 'refused' WHEN coalesce(sum(1 - returned) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 3 THEN 'budget_exceeded' ELSE 'requested' END AS state FROM d""",
    "truth_agreement": "SELECT doc_id, 'missing' AS what FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT doc_id, 'unlabelled' FROM documents ANTI JOIN labels USING (doc_id)",
    "hourly_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
