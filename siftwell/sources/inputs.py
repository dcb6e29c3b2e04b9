"""Inputs as rows: arguments and list files gathered in order, files read by Spark, tables taken as inputs; and what is written out."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SizedFiles

INPUTS = "input_index long, kind string, source string, name string"


def gather(spark: SparkSession, args: Iterable[str], list_file: str | None = None, extensions: tuple[str, ...] = ("html", "htm")) -> DataFrame:
    """(input_index, kind, source, name) of arguments and of a list file's lines (blank ones and comments left out), in order.

    kind is url, malformed_url, file or skipped_symlink. Folders are walked depth first, by name; of their files only those with an
    extension count (whatever its case). A link that leads out of the folder is skipped and reported; no folder is entered twice.
    Only names are handled here; bytes are read by ``read_files``.
    """
    items = list(args)
    if list_file:
        items += [r.value.strip() for r in spark.read.text(list_file).collect() if r.value.strip() and not r.value.strip().startswith("#")]
    rows = [row for item in items for row in _one(item, extensions)]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], INPUTS)


def _one(item: str, extensions: tuple[str, ...]) -> Iterable[tuple[str, str, str]]:
    if "://" in item:
        scheme, rest = item.split("://", 1)
        good = scheme.isalnum() and rest.strip("/") and not any(c.isspace() for c in item)
        yield ("url" if good else "malformed_url", item, item.split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1])
    elif os.path.isdir(item):
        yield from _walk(item, os.path.realpath(item), extensions, set())
    else:
        yield "file", item, os.path.basename(item)


def _walk(folder: str, root: str, extensions: tuple[str, ...], seen: set[str]) -> Iterable[tuple[str, str, str]]:
    own = os.path.realpath(folder)
    if own in seen:
        return
    seen.add(own)
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        target = os.path.realpath(entry.path)
        if entry.is_symlink() and os.path.commonpath([root, target]) != root:
            yield "skipped_symlink", entry.path, entry.name
        elif entry.is_dir():
            yield from _walk(entry.path, root, extensions, seen)
        elif os.path.splitext(entry.name)[1][1:].lower() in extensions:
            yield "file", entry.path, entry.name


def read_files(spark: SparkSession, paths: list[str], max_bytes: int) -> DataFrame:
    """(source, name, length, data): files by Spark's binary reader; those over the budget keep their length and no bytes.

    The reader decides filters on the length before it opens a file, so each file is either read or listed.
    """
    files = spark.read.format("binaryFile").load(paths)
    named = files.select(F.col("path").alias("source"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("content").alias("data"))
    return named.where(F.col("length") <= max_bytes).unionByName(named.drop("data").where(F.col("length") > max_bytes).withColumn("data", F.lit(None).cast("binary")))


def read_sized(spark: SparkSession, paths: list[str], max_bytes: int, extensions: tuple[str, ...] = ("html", "htm"), pushdown: bool = False) -> DataFrame:
    """Files and folders by the source ``sized_files`` (see ``files.SizedFiles``), in order of ``position``."""
    spark.dataSource.register(SizedFiles)
    read = spark.read.format("sized_files").option("paths", json.dumps(paths)).option("maxBytes", max_bytes).option("extensions", ",".join(extensions))
    return read.option("pushdown", str(pushdown).lower()).load()


def sized_inputs(files: DataFrame) -> DataFrame:
    """``read_sized`` rows as rows of ``fetch.process_all``: id, name, data, declared_header, and the status of those that can't be processed."""
    failure = F.when(F.col("kind") != "file", F.col("kind")).when(F.col("data").isNull(), "budget_exceeded")
    return files.select(F.col("position").alias("id"), "name", "data", F.lit(None).cast("string").alias("declared_header"), failure.alias("failure"))


def from_pages(pages: DataFrame) -> DataFrame:
    """The ``pages`` table as inputs: id, name (the URL), data, declared_header."""
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("name"), F.encode("html", "UTF-8").alias("data"), F.lit("text/html").alias("declared_header"))


def safe_name(index: Column, source: Column) -> Column:
    """``index-name``: the last part of a source with all but letters, digits, ``.``, ``_`` and ``-`` replaced."""
    last = F.regexp_replace(F.element_at(F.split(F.rtrim(source, F.lit("/")), "/"), -1), "[^A-Za-z0-9._-]", "_")
    return F.concat(index.cast("string"), F.lit("-"), F.when(last.isin("", "..", "."), "input").otherwise(last))


def write_outputs(outputs: DataFrame, path: str) -> None:
    """(name, output) as Parquet rows: millions of small files help nobody. Refused rows have no output and aren't written."""
    outputs.where(F.col("output").isNotNull()).select("name", "output").write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header; list cells are joined by a space."""
    flat = [F.array_join(F.col(c).cast("array<string>"), " ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)
