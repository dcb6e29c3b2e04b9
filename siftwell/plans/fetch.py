"""Inputs that are URLs: looked up in tables of responses and addresses, and processed with the files beside them, in input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.html import ACTION, REFERENCE
from ..policy import Policy
from ..sources.staging import cut
from . import guard, pipeline


def acquired(inputs: DataFrame, files: DataFrame, responses: DataFrame, dns: DataFrame, networks: DataFrame, policy: Policy, origin: str = "server") -> DataFrame:
    """(id, name, data, declared_header, failure) of gathered inputs (input_index, kind, source, name), one row each.

    ``files``: source, data. ``responses``: url, status, location, content_type, content_encoding, content_length, body. ``failure``
    is null for what can be processed, else the status to report: malformed_url, skipped_symlink, unsupported_scheme (neither http nor
    https), ssrf_blocked (the URL or a hop leads to a denied address; where ``guard_input_urls`` covers the ``origin``, "server" or "cli"), fetch_error (no good
    response, a coded body, or one over ``max_response_bytes``, as declared or as it is), io_error (no such file).
    """
    scheme = F.lower(F.regexp_extract("source", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    asked = inputs.where((F.col("kind") == "url") & scheme.isin("http", "https")).select(F.col("input_index").alias("request_id"), F.col("source").alias("url"))
    ways = guard.fetched(asked.select("url", F.lit(None).cast("string").alias("endpoint")), responses, dns, networks, policy, origin)
    ends = asked.join(ways.select("url", "final_url", "outcome"), "url").select("request_id", "final_url", "outcome")
    answers = responses.select(F.col("url").alias("final_url"), "content_type", "content_encoding", "content_length", "body")
    most = policy.fetch.max_response_bytes
    met = ends.join(answers, "final_url", "left")
    large = F.greatest(F.coalesce("content_length", F.lit(0)), F.coalesce(F.octet_length("body"), F.lit(0))) > most
    coded = ~F.lower(F.coalesce("content_encoding", F.lit(""))).isin("", "identity")
    failed = F.when(F.col("outcome") == "blocked", "ssrf_blocked").when((F.col("outcome") != "fetched") | large | coded, "fetch_error")
    met = met.select("request_id", "content_type", F.when(failed.isNull(), F.coalesce("body", F.lit(b""))).alias("body"), failed.alias("failed"))
    rows = inputs.join(met, inputs["input_index"] == met["request_id"], "left").join(files.select("source", F.col("data").alias("bytes"), F.lit(True).alias("known")), "source", "left")
    failure = (F.when(F.col("kind").isin("malformed_url", "skipped_symlink"), F.col("kind")).when(F.col("kind") == "url", F.when(scheme.isin("http", "https"), F.col("failed")).otherwise("unsupported_scheme"))
               .when(F.col("known").isNull(), "io_error"))
    return rows.select(F.col("input_index").alias("id"), "name", F.coalesce("body", "bytes").alias("data"), F.col("content_type").alias("declared_header"), failure.alias("failure"))


def process_all(rows: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame) -> DataFrame:
    """Report rows (see ``pipeline.process``) of ``acquired`` inputs; those with a failure have it as their status, and no output."""
    rows = cut(rows)
    done = pipeline.process(rows.where("failure IS NULL").drop("failure"), policy, blocklist, protected, networks)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    failed = rows.where("failure IS NOT NULL").select(
        "id", "name", F.col("failure").alias("status"), pipeline.bucket(F.col("failure")).alias("bucket"), zero.alias("bytes_in"), zero.alias("bytes_out"), none.alias("declared_mime"), none.alias("sniffed_mime"),
        F.array().cast(f"array<{ACTION}>").alias("actions"), F.array().cast(f"array<{REFERENCE}>").alias("references"), none.alias("base"), F.lit(None).cast("binary").alias("output"))
    return done.unionByName(failed)
