"""Evaluation of a rule set against ground truth, and of measurements, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import cut


def rate(numerator: Column, denominator: Column) -> Column:
    """A share with four decimals, ``n/a`` over nothing."""
    return F.when(denominator == 0, "n/a").otherwise(F.format_string("%.4f", numerator / denominator))


def measure(truth: DataFrame, results: DataFrame) -> DataFrame:
    """Each sample (kind, name) with what it should and did do: missing, unexpected, leaked, lost (arrays) and a verdict.

    ``truth``: kind, name, category, status array, rules, allowed, forbidden_rules, forbidden, preserved arrays. ``results``: kind,
    name, status, fired array, output. Markers are looked for in the output whatever the case; without output none is there.
    """
    both = truth.withColumnRenamed("status", "expected").join(results, ["kind", "name"])
    shown = F.lower(F.coalesce("output", F.lit("")))
    fired = F.array_sort(F.array_distinct("fired"))
    missing = F.array_sort(F.array_except("rules", "fired"))
    unexpected = F.array_sort(F.array_union(F.array_except(fired, F.array_union("rules", "allowed")), F.array_intersect(fired, "forbidden_rules")))
    leaked = F.filter("forbidden", lambda m: F.contains(shown, F.lower(m)))
    lost = F.filter("preserved", lambda m: ~F.contains(shown, F.lower(m)))
    rows = both.select("kind", "name", "category", "status", F.array_contains("expected", F.col("status")).alias("as_expected"), fired.alias("fired"), F.col("rules").alias("required"), missing.alias("missing"), unexpected.alias("unexpected"), leaked.alias("leaked"), lost.alias("lost"))
    bad = F.col("kind") == "malicious"
    verdict = (F.when(bad & (F.size("leaked") > 0), "leaked").when(bad & ~(F.col("as_expected") & (F.size("lost") == 0)), "missed").when(bad & (F.size("missing") > 0), "mislabelled").when(bad, "detected")
               .when((F.size("unexpected") > 0) | (F.size("lost") > 0), "false_positive").otherwise("clean"))
    return rows.withColumn("verdict", verdict)


def rule_confusion(measured: DataFrame) -> DataFrame:
    """(rule, expected, fired, true_positive, false_negative, false_positive, precision, recall) by rule; false positives are benign samples' only."""
    one = lambda name, array, where=None: (measured if where is None else measured.where(where)).select(F.explode(array).alias("rule"), F.lit(name).alias("what"))
    rows = one("expected", "required").unionByName(one("fired", "fired")).unionByName(one("tp", F.array_intersect("required", "fired"))).unionByName(one("fn", "missing")).unionByName(one("fp", "unexpected", "kind = 'benign'"))
    n = lambda what: F.count_if(F.col("what") == what)
    out = rows.groupBy("rule").agg(n("expected").alias("expected"), n("fired").alias("fired"), n("tp").alias("true_positive"), n("fn").alias("false_negative"), n("fp").alias("false_positive"))
    tp = F.col("true_positive")
    return out.withColumn("precision", rate(tp, tp + F.col("false_positive"))).withColumn("recall", rate(tp, tp + F.col("false_negative")))


def category_rates(measured: DataFrame, good: tuple[str, ...] = ("detected", "clean", "mislabelled")) -> DataFrame:
    """(kind, category, numerator, denominator, rate) for each category, and with a null category for each kind."""
    hits = F.count_if(F.col("verdict").isin(*good))
    return measured.groupingSets([["kind", "category"], ["kind"]], "kind", "category").agg(hits.alias("numerator"), F.count("*").alias("denominator"), rate(hits, F.count("*")).alias("rate"))


def middle(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, low, middle, high): the upper median by rank.

    Equal values are counted first; the counts are dealt by ranges of key and value, added up inside each range, and the ranges'
    sums lead to the one with the middle. No task sees more than a range, however few keys there are.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange("_k", "_v").withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_k", "_range").agg(F.sum("_c").alias("_s"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    of_key = Window.partitionBy("_k")
    sums = sums.withColumn("_before", F.sum("_s").over(of_key.orderBy("_range")) - F.col("_s")).withColumn("n", F.sum("_s").over(of_key))
    sums = sums.withColumn("low", F.min("_low").over(of_key)).withColumn("high", F.max("_high").over(of_key)).withColumn("_at", F.floor(F.col("n") / 2))
    here = sums.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_s"))).drop("_s", "_low", "_high")
    inside = ranged.join(here, ["_k", "_range"])
    inside = inside.withColumn("_ends", F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_range").orderBy("_v")))
    return inside.where((F.col("_ends") - F.col("_c") <= F.col("_at")) & (F.col("_at") < F.col("_ends"))).select(F.col("_k").alias(key), "n", "low", F.col("_v").alias("middle"), "high")


def agreement(truth: DataFrame, found: DataFrame, key: str, names: tuple[str, str] = ("missing", "unlabelled")) -> DataFrame:
    """(key, what): keys of ``truth`` that aren't found, and found ones that ``truth`` doesn't know."""
    lost = truth.join(found, key, "left_anti").select(key, F.lit(names[0]).alias("what"))
    return lost.unionByName(found.join(truth, key, "left_anti").select(key, F.lit(names[1]).alias("what")))


def suite_counts(judged: DataFrame, key: str = "suite") -> DataFrame:
    """(key, total, passed, failed) of judged scenarios (``passed``)."""
    return judged.groupBy(key).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def memory_growth(measured: DataFrame) -> DataFrame:
    """(name, bytes, growth_kib, bytes_per_input_byte) of measured peaks (name, bytes, peak_rss_kib, baseline_kib)."""
    growth = F.greatest(F.col("peak_rss_kib") - F.col("baseline_kib"), F.lit(0))
    ratio = F.when(F.col("bytes") == 0, "n/a").otherwise(F.format_string("%.3f", growth * 1024 / F.col("bytes")))
    return measured.select("name", "bytes", growth.cast("long").alias("growth_kib"), ratio.alias("bytes_per_input_byte"))


def words_by_cell(cells: DataFrame, column: str) -> DataFrame:
    """(word, n) of all space-joined cells of a column; empty and null cells have none."""
    words = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), " "), lambda w: w != "")
    return cells.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def by_size(measured: DataFrame) -> DataFrame:
    """Measurements in order of their bytes, then names."""
    return measured.orderBy("bytes", "name")


def by_category(samples: DataFrame) -> DataFrame:
    """Samples in order of category and name."""
    return samples.orderBy("category", "name")


def by_count(counts: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """Counts in ascending order, equal ones by name in descending order."""
    return counts.orderBy(F.col(n), F.col(name).desc())


def run_order(runs: DataFrame) -> DataFrame:
    """Runs (kind, slug): those without fetching first, then those with, then custom ones, each by slug."""
    return runs.orderBy(F.when(F.col("kind") == "nofetch", 0).when(F.col("kind") == "fetch", 1).otherwise(2), "slug")


def per_kib(microseconds: Column, n_bytes: Column) -> Column:
    return F.when(n_bytes == 0, "n/a").otherwise(F.format_string("%.3f", microseconds * 1024 / n_bytes))


def scaling(rows: DataFrame, key: str, digits: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Speed-up and efficiency against the fewest workers; ``rows`` has key, workers, seconds, mib. With ``digits`` (printed tables have
    4, 1, 3, 3) the seconds, rates, speed-ups and efficiencies are rounded."""
    first = F.first("seconds").over(Window.partitionBy(key).orderBy("workers"))
    faster = first / F.col("seconds")
    out = rows.select(key, "workers", F.col("seconds").alias("batch_seconds"), (F.col("mib") / F.col("seconds")).alias("mib_per_second"), faster.alias("speedup"), (faster / F.col("workers")).alias("efficiency"))
    columns = ("batch_seconds", "mib_per_second", "speedup", "efficiency")
    return out if digits is None else out.select(key, "workers", *[F.round(c, n).alias(c) for c, n in zip(columns, digits, strict=True)])


def run_pairs(runs: DataFrame) -> DataFrame:
    """(kind, a, b): each pair of runs (kind, ord, name) of a kind once, the earlier first. Runs are a handful."""
    left, right = runs.select("kind", F.col("ord").alias("i"), F.col("name").alias("a")), runs.select("kind", F.col("ord").alias("j"), F.col("name").alias("b"))
    return left.join(right, "kind").where("i < j").select("kind", "a", "b")


def judge(outcomes: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, passed, reasons) of scenario outcomes (name, http, status, fired array, output, wall_ms) against what is expected.

    ``expected``: name, http array, status, rules, forbidden arrays, max_wall_ms; a null expects nothing. A scenario without an
    outcome fails.
    """
    met = expected.select("name", F.col("http").alias("codes"), F.col("status").alias("state"), "rules", "forbidden", "max_wall_ms").join(outcomes, "name", "left")
    shown = F.lower(F.coalesce("output", F.lit("")))
    checks = F.array(
        F.when(F.col("wall_ms").isNull(), "no outcome"), F.when(~F.array_contains("codes", F.col("http")), "http code"), F.when(F.col("state") != F.col("status"), "status"),
        F.when(F.size(F.array_except("rules", "fired")) > 0, F.concat(F.lit("missing "), F.array_join(F.array_sort(F.array_except("rules", "fired")), " "))),
        F.when(F.exists("forbidden", lambda m: F.contains(shown, F.lower(m))), "leaked"), F.when(F.col("wall_ms") > F.col("max_wall_ms"), "too slow"))
    reasons = F.filter(checks, lambda c: c.isNotNull())
    return met.select("name", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def percentage(numerator: Column, denominator: Column) -> Column:
    """A share in percent with two decimals, ``n/a`` over nothing."""
    return F.when(denominator == 0, "n/a").otherwise(F.format_string("%.2f", 100.0 * numerator / denominator))


def summary(measured: DataFrame) -> DataFrame:
    """(metric, kind, numerator, denominator, rate) in long form: the rates of each kind, and of each category in it.

    Malicious samples: ``detection_rate`` (neutralised, whatever rule was named), ``rule_accuracy``, ``leak_rate``,
    ``false_negative_rate``; benign ones: ``false_positive_rate``. By category: ``detection_rate.<category>`` and
    ``clean_rate.<category>``. One pass over the samples; the categories' counts are added up for the kinds.
    """
    held = F.col("verdict").isin("detected", "mislabelled", "clean")
    counts = measured.groupBy("kind", "category").agg(
        F.count("*").alias("total"), F.count_if(held).alias("held"), F.count_if(F.size("missing") == 0).alias("named"),
        F.count_if(F.col("verdict") == "leaked").alias("leaked"), F.count_if(F.col("verdict") == "false_positive").alias("wrong"))
    bad = F.col("kind") == "malicious"
    prefix = F.when(bad, "detection_rate.").otherwise("clean_rate.")
    by_category = counts.select(F.concat(prefix, "category").alias("metric"), "kind", F.col("held").alias("numerator"), F.col("total").alias("denominator"))
    whole = counts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("total", "held", "named", "leaked", "wrong")])
    line = lambda metric, n: F.struct(F.lit(metric).alias("metric"), n.alias("numerator"))
    lines = F.when(bad, F.array(line("detection_rate", F.col("held")), line("rule_accuracy", F.col("named")), line("leak_rate", F.col("leaked")), line("false_negative_rate", F.col("total") - F.col("held")))).otherwise(F.array(line("false_positive_rate", F.col("wrong"))))
    by_kind = whole.select(F.explode(lines).alias("x"), "kind", "total").select("x.metric", "kind", "x.numerator", F.col("total").alias("denominator"))
    return by_kind.unionByName(by_category).withColumn("rate", percentage(F.col("numerator"), F.col("denominator")))
