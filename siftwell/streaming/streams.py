"""The stateless plan over a stream of submissions, keyed verdicts with state, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import sniff
from ..plans import pipeline


def submissions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet submissions that land in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def typed_stream(rows: DataFrame) -> DataFrame:
    """(id, declared, sniffed, effective) of a stream of inputs: the batch plan's own expressions."""
    declared, sniffed = sniff.declared(F.col("declared_header"), F.col("name")), sniff.sniffed(F.col("data"))
    return rows.select("id", declared.alias("declared"), sniffed.alias("sniffed"), sniff.effective(sniffed, declared).alias("effective"))


def sanitise_batches(stream: DataFrame, process, path: str, checkpoint: str, on_summary=None):
    """Each micro-batch through ``process`` (a batch plan with joins), its reports in a folder of its own, ``batch=<number>``.

    A batch that is tried again writes its folder anew, so every submission is reported once. ``on_summary`` (a function of the
    number and the summary), if given, gets what was observed while the batch was written.
    """
    def write(batch: DataFrame, number: int) -> None:
        where = f"{path.rstrip('/')}/batch={number}"
        if on_summary is None:
            process(batch).write.mode("overwrite").parquet(where)
        else:
            on_summary(number, pipeline.write_reports(process(batch), where)[0])

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def resolve_verdicts(lookups: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, at, allowed, hit) of lookups (key, at timestamp, allowed): verdicts kept by key.

    A denial stays for good and is never upgraded; a permission counts for ``ttl_ms`` from when it was learned (0: never).
    """
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        allowed, learned = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, answer in zip(rows["at"].astype("int64") // 1_000_000 if rows["at"].dtype == "datetime64[ns]" else rows["at"].astype("datetime64[ms]").astype("int64"), rows["allowed"], strict=True):
            hit = allowed is False or (allowed is True and at < learned + ttl_ms)
            if not hit:
                allowed, learned = bool(answer), int(at)
            out.append((key[0], int(at), bool(allowed), bool(hit)))
        state.update((allowed, learned))
        yield pd.DataFrame(out, columns=["key", "at_ms", "allowed", "hit"])

    return lookups.groupBy("key").applyInPandasWithState(keep, "key string, at_ms long, allowed boolean, hit boolean", "allowed boolean, learned long", "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, value): tumbling windows over events, for streams with a watermark and for tables alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "value")
