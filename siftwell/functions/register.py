"""The engine's functions by name, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class ZipEntries:
    def eval(self, data: bytes) -> Iterator[tuple]:
        from siftwell.operators.scanners import zip_entries

        for name, offset, packed, size in zip_entries(data or b"") or []:
            yield name.decode("utf-8", "replace"), offset, packed, size


class CssFindings:
    def eval(self, text: str) -> Iterator[tuple]:
        from siftwell.functions.css import css_findings

        for rule, at, _ in css_findings(text or ""):
            yield rule, at


class HtmlTags:
    def eval(self, data: bytes) -> Iterator[tuple]:
        from siftwell.functions.markup import find_elements

        for e in find_elements(data or b""):
            yield e["tag"], e["start"], e["end"], {a["name"]: a["value"] for a in e["attrs"]}


def register(spark: SparkSession) -> None:
    """Scalar functions ``parsed_host(text)`` and ``decode_references(text)``; table functions ``zip_entries(binary)``,
    ``css_findings(text)`` and ``html_tags(binary)``."""
    from . import hosts, markup

    spark.udf.register("parsed_host", F.arrow_udf(hosts._parsed_host, hosts.HOST))
    spark.udf.register("decode_references", F.arrow_udf(markup._decoded, "string"))
    for name, kind, columns in (("zip_entries", ZipEntries, "name string, offset long, packed long, size long"), ("css_findings", CssFindings, "rule string, offset long"),
                                ("html_tags", HtmlTags, "tag string, start int, end int, attrs map<string,string>")):
        spark.udtf.register(name, F.udtf(kind, returnType=columns))
