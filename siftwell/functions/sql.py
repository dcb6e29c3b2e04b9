"""The engine in SQL text: types as SQL functions that Catalyst inlines, and the sanitiser's results as views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..policy import Policy
from . import sniff


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _case(of: str, pairs: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in pairs.items()) + " END"


def register_types(spark: SparkSession) -> None:
    """Temporary functions ``sniff(data)``, ``declared_type(header, name)`` and ``effective_type(data, header, name)``, by the tables of
    ``functions.sniff``. (What is in a ZIP archive takes a look inside; ``sniff`` calls all of them application/zip.)"""
    magic = " ".join(f"WHEN substring(data, {at + 1}, {len(code) // 2}) = X'{code}' THEN {_text(mime)}" for at, code, mime in sniff.MAGIC)
    headers = sniff.HEADER_ALIASES | {h: h for h in sniff.HEADERS}
    extensions = {e: m for m, e in sniff.EXTENSION_OF.items() if e not in sniff.UNDECLARED} | sniff.MORE_EXTENSIONS
    last = r"element_at(split(regexp_replace(name, '[?#].*$', ''), '/'), -1)"
    by_name = _case(f"lower(nullif(regexp_extract({last}, '^.+[.]([^.]*)$', 1), ''))", extensions)
    by_header = _case("lower(trim(split(header, ';')[0]))", headers)
    for signature, body in (
            ("sniff(data BINARY)", f"CASE {magic} END"), ("declared_type(header STRING, name STRING)", f"coalesce({by_header}, {by_name})"),
            ("effective_type(data BINARY, header STRING, name STRING)", "coalesce(sniff(data), declared_type(header, name))")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")


def create_views(inputs: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame, name: str = "sanitised") -> None:
    """Views of the sanitised inputs (see ``pipeline.process``): ``name`` has the reports, ``name_actions`` a row for each action (id, n, rule_id,
    category, line, byte_offset, original, action, replacement), ``name_references`` one for each reference (id, n, raw, kind)."""
    from ..plans import pipeline

    reports = pipeline.process(inputs, policy, blocklist, protected, networks)
    reports.createOrReplaceTempView(name)
    actions = reports.select("id", F.posexplode("actions").alias("n", "a"))
    actions.select("id", "n", "a.rule_id", "a.category", "a.location.line", "a.location.byte_offset", "a.original", "a.action", "a.replacement").createOrReplaceTempView(f"{name}_actions")
    reports.select("id", F.posexplode("references").alias("n", "r")).select("id", "n", "r.*").createOrReplaceTempView(f"{name}_references")


def create_url_view(urls: DataFrame, blocklist: DataFrame, protected: DataFrame, networks: DataFrame, name: str = "classified") -> None:
    """A view (url, label, rule, canonical) of the distinct URLs of a table; see ``urls.classify_urls``."""
    from ..operators.urls import classify_urls

    classify_urls(urls, blocklist, protected, networks).createOrReplaceTempView(name)
