"""Host-level quality rules: rule failures by domain, rates shrunk by an empirical beta prior, verdicts joined back.

The measures of a text come from one Arrow function over its bytes; everything by host is DataFrame aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_name, cut, join_lookup, let_go, small_batches
from .symbols import Words, pieces

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Words in a window; a power of two.
WINDOW = 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

#: The rules whose failures are counted by host, over the measures. Percentages are compared in whole numbers.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 20,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 30 * m("n_words"),
    "symbols": lambda m: 100 * m("n_symbols") > 10 * m("word_chars"),
    "duplicate_lines": lambda m: 100 * m("n_dup_lines") > 5 * m("n_words"),
}
#: A document that fails one of these is rejected whatever its host.
BASE_RULES = ("few_words", "repeated_words")


def measure_texts(texts: pa.Array) -> list[np.ndarray]:
    """The MEASURES of some texts, one array each. Lines and windows are compared as they are, never by hash."""
    w = Words(texts)
    n_docs = len(texts)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])

    chars = per_doc(w.inside & ((w.data & 0xC0) != 0x80))
    symbols = per_doc(_SYMBOL[w.data])
    data, edges = w.data.tobytes(), w.offsets.tolist()
    dup_lines = np.zeros(n_docs, np.int64)
    for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        lines = [x for x in data[a:b].split(b"\n") if x.strip()]
        dup_lines[n] = len(lines) - len(set(lines))

    starts = np.flatnonzero(w.window_starts(WINDOW))
    cover = np.zeros(len(w.starts) + 1, np.int64)
    if len(starts):
        names = w.codes()[0] + np.repeat(np.arange(n_docs), w.counts) * len(w.starts)
        size = 1
        while size < WINDOW:  # names of windows of 2, 4, 8 words: equal for equal windows of one text only
            names = np.unique(names, return_inverse=True)[1]
            names = names[:-size] * len(w.starts) + names[size:]
            size *= 2
        names = np.unique(names[starts], return_inverse=True)[1]
        repeated = starts[np.bincount(names)[names] > 1]
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return [w.counts, chars, symbols, dup_lines, np.diff(covered[w.bounds])]


def measures_of(texts: pa.Array) -> pa.Array:
    """A struct of the MEASURES (all bigint) of each text."""
    let_go()
    parts = [measure_texts(texts.slice(a, b - a)) for a, b in pieces(texts)]
    columns = [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) if parts else pa.array([], pa.int64()) for k in range(len(MEASURES))]
    return pa.StructArray.from_arrays(columns, list(MEASURES))


def measures(text: Column) -> Column:
    """A struct of the MEASURES (all bigint) of a text."""
    return F.arrow_udf(measures_of, ", ".join(f"{m} bigint" for m in MEASURES))(text.cast("string"))


def host_table(measured: DataFrame, host: str, at: str) -> DataFrame:
    """One row per host: its documents ``n`` and for each rule its failures. ``at`` names the struct of measures."""
    failed = [F.count_if(rule(lambda m: F.col(f"{at}.{m}"))).alias(name) for name, rule in RULES.items()]
    return measured.groupBy(F.col(host).cast("string").alias("host")).agg(F.count("*").alias("n"), *failed)


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule the beta distribution of the hosts' failure rates, fitted by moments (beta-binomial).

    The prior is strong where hosts differ no more than chance explains, and weak where they do differ.
    """
    sums = [F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn")]
    for name in RULES:
        sums += [F.sum(name).alias(name), F.sum(F.col(name).cast("double") * F.col(name) / F.col("n")).alias(f"{name}_2")]
    row = hosts.agg(*sums).first()
    priors = {}
    for name in RULES:
        n, k = row["n"] or 0, row["k"]
        mean = (row[name] + 0.5) / (n + 1) if n else 0.5
        spread = mean * (1 - mean)
        free = n - row["nn"] / n - (k - 1) if n else 0.0
        rho = ((row[f"{name}_2"] - row[name] ** 2 / n) - spread * (k - 1)) / (spread * free) if free > 0 else 0.0
        strength = 1 / min(max(rho, 1e-4), 0.9) - 1
        priors[name] = (mean * strength, (1 - mean) * strength)
    return priors


def host_verdicts(hosts: DataFrame, max_rate: float) -> DataFrame:
    """(host, host_kept, host_rate): a host is kept unless the shrunk failure rate of some rule is above ``max_rate``."""
    rates = [(F.col(name) + F.lit(a)) / (F.col("n") + F.lit(a + b)) for name, (a, b) in beta_priors(hosts).items()]
    return hosts.select("host", F.greatest(*rates).alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= max_rate)


def base_failed(at: str) -> Column:
    return F.greatest(*[RULES[name](lambda m: F.col(f"{at}.{m}")) for name in BASE_RULES])


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per document: id, host, the MEASURES, base_failed, host_rate (the host's worst shrunk rate) and kept.

    A document is kept if it fails no base rule (under 20 words; over 30 % of its words in 8-word windows found twice or more)
    and its host's shrunk failure rate is at most ``max_rate`` for every rule. Words are split at ASCII white space.

    With the default a host goes once its next document more likely fails a rule than not.

    Null and empty texts have no words and fail; very long texts are measured whole, in one task's memory. A null host is a
    host of its own. Repeated rows and ids count and are judged each by itself; ties don't occur. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), measures(docs[text_col]).alias("m"))
    rows = cut(rows)
    hosts = cut(host_table(rows, "host", "m"))
    rows = join_lookup(rows, host_verdicts(hosts, max_rate), "host", hosts.count(), F.col("id"))
    failed = base_failed("m")
    return rows.select("id", "host", "m.*", failed.alias("base_failed"), "host_rate", (~failed & F.col("host_kept")).alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns. Texts are measured twice, and never shuffled.

    Null and empty texts fail and go; very long ones are measured whole. A null host is a host of its own. Repeated rows stay or go
    together. An empty table gives an empty result. Other columns are kept, whatever their names. Sets the session's bound of
    batches for Python (``small_batches``).
    """
    small_batches(docs.sparkSession)
    at, host = column_name(docs, "_measures"), column_name(docs, "_host")
    rows = docs.withColumn(at, measures(docs[text_col])).withColumn(host, docs[host_col].cast("string"))
    hosts = cut(host_table(rows.select(host, at), host, at))
    names = {c: column_name(docs, f"_{c}") for c in ("host_kept", "host_rate")}
    verdicts = host_verdicts(hosts, max_rate).select(F.col("host").alias(host), *[F.col(c).alias(x) for c, x in names.items()])
    good = join_lookup(rows.where(~base_failed(at)), verdicts, host, hosts.count(), docs[text_col])
    return good.where(F.col(names["host_kept"])).drop(at, host, *names.values())


def host_report(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: host, n (its documents), the failures of each of the RULES, host_rate (the worst shrunk rate), host_kept.

    Nulls, empty tables and repeated rows are handled as in ``judge``.
    """
    rows = docs.select(docs[host_col].cast("string").alias("host"), measures(docs[text_col]).alias("m"))
    hosts = cut(host_table(rows, "host", "m"))
    verdicts = host_verdicts(hosts, max_rate)
    return hosts.join(verdicts.withColumnRenamed("host", "of"), hosts["host"].eqNullSafe(F.col("of"))).drop("of")
