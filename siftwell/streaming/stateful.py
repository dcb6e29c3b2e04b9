"""Stateful streams over a state store with times to live: submissions that are new, and verdicts that are remembered.

The state is kept by RocksDB and survives restarts through the query's checkpoint; what has expired is dropped by the store itself, so
state doesn't grow with the keys of all times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
VERDICT = "key string, allowed boolean, hit boolean"


def _checked(rows: DataFrame) -> None:
    if not rows.sparkSession.conf.get(PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"{PROVIDER} must be {ROCKSDB}: state with a time to live needs it")


class FirstSeen(StatefulProcessor):
    """Hands on a key's first row, and none while it is remembered."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        for batch in rows:
            if not known and len(batch):
                known = True
                self.seen.update((True,))
                yield batch.iloc[:1]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((True,))


def new_submissions(stream: DataFrame, keep_ms: int, key: str = "id", known: DataFrame | None = None) -> DataFrame:
    """The rows of a stream whose ``key`` hasn't come within ``keep_ms``, in this batch or an earlier one; of several in a batch one.

    ``known`` (key) names keys that came before the stream began; they count in its first batch. A restarted query remembers.
    """
    _checked(stream)
    initial = known.select(key).distinct().groupBy(key) if known is not None else None
    return stream.groupBy(key).transformWithStateInPandas(FirstSeen(keep_ms), stream.schema, "Append", "ProcessingTime", initial)


class Verdicts(StatefulProcessor):
    """A key's verdict: a denial for good, a permission for its time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.denied = handle.getValueState("denied", "denied boolean")
        self.allowed = handle.getValueState("allowed", "allowed boolean", self.ttl_ms) if self.ttl_ms > 0 else None

    def learn(self, allowed: bool) -> None:
        if not allowed:
            self.denied.update((True,))
        elif self.allowed is not None:
            self.allowed.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answers = pd.concat(list(rows)).sort_values("at")["allowed"].tolist()
        denied, allowed = self.denied.exists(), self.allowed is not None and self.allowed.exists()
        out = []
        for answer in answers:
            hit = denied or allowed
            if not hit:
                self.learn(bool(answer))
                denied, allowed = not answer, bool(answer) and self.allowed is not None
            out.append((key[0], not denied and (hit or bool(answer)), hit))
        yield pd.DataFrame(out, columns=["key", "allowed", "hit"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.learn(bool(initialState["allowed"].all()))


def remembered_verdicts(lookups: DataFrame, ttl_ms: int, known: DataFrame | None = None) -> DataFrame:
    """VERDICT of a stream of lookups (key, at, allowed): what is remembered of a key is a hit, else the lookup's own answer is learned.

    A denial stays and is never upgraded; a permission expires ``ttl_ms`` after it was learned, by the clock (0: at once). ``known``
    (key, allowed) are verdicts from before, loaded when the query starts for the first time; of several for a key a denial counts.
    """
    _checked(lookups)
    initial = known.select("key", "allowed").groupBy("key") if known is not None else None
    schema = StructType.fromDDL(VERDICT)
    return lookups.groupBy("key").transformWithStateInPandas(Verdicts(ttl_ms), schema, "Append", "ProcessingTime", initial)
