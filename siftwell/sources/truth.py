"""A labelled corpus: files in folders of benign and malicious samples, joined to a ground truth in TOML."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a sample that hold lists of texts, and the others with their types.
LISTS = ("status", "rules", "allowed", "forbidden_rules", "forbidden", "preserved")
OTHERS = {"name": "string", "set": "string", "category": "string", "source": "string", "licence": "string", "carries": "string", "threat": "string", "output": "boolean", "max_duration_ms": "long"}
KINDS = ("benign", "malicious")
#: Keys that are called otherwise in the table.
RENAMED = {"set": "kind", "output": "has_output"}
SCHEMA = ", ".join([*[f"{RENAMED.get(k, k)} {t}" for k, t in OTHERS.items()], *[f"{k} array<string>" for k in LISTS]])


def parse_truth(text: str) -> list[tuple]:
    """The samples of a ground truth. Unknown keys, unknown kinds and names that are given twice in a kind are errors."""
    rows, seen = [], set()
    for sample in tomllib.loads(text).get("sample", []):
        if unknown := sorted(set(sample) - set(OTHERS) - set(LISTS) - {"fetch"}):
            raise ValueError(f"unknown key {unknown[0]} of {sample.get('name')}")
        own = (sample.get("set"), sample.get("name"))
        if own[0] not in KINDS or not own[1] or own in seen:
            raise ValueError(f"a sample needs a set and a name of its own: {own}")
        seen.add(own)
        rows.append((*[sample.get(k, True if k == "output" else None) for k in OTHERS], *[sample.get(k, []) for k in LISTS]))
    return rows


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name, category, ..., lists): a row for each sample of a TOML file."""
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # a file of some hundred samples
    return spark.createDataFrame(parse_truth(text), SCHEMA)


def corpus(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(kind, name, id, data, declared_header) of the files in one folder for each kind, sorted by kind and name.

    Spark's readers leave out files without any bytes.
    """
    found = None
    for kind in KINDS:
        files = spark.read.format("binaryFile").load(folders[kind])
        files = files.select(F.lit(kind).alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))
        found = files if found is None else found.unionByName(files)
    return found.select("kind", "name", F.concat_ws("/", "kind", "name").alias("id"), "data", F.lit(None).cast("string").alias("declared_header")).orderBy("kind", "name")
