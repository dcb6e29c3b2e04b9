"""Byte-level BPE by a file of ranks: encoding in two tiers, and decoding.

A text is cut into pre-tokens by a pattern. Those that stand in the vocabulary as a whole are resolved by a minimal perfect hash
of all its entries, many at once; the entry in the slot is compared, so foreign ones are told. The others are merged: a heap
holds the ranks of neighbouring parts, linked lists lead from a part to its neighbours, and the pair of least rank (of
equal ones the leftmost) becomes one part until no pair has a rank. A pre-token of n bytes takes n log n steps, so a text
without blanks is no exception; in a short one the least rank is looked for in a list. Each worker remembers the ids of the
pre-tokens that it has met. Decoding takes the entries of many texts' ids at once.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mph
from .symbols import pieces, word_hashes

#: Pre-tokens whose ids a worker remembers; longer ones than this many characters are encoded anew each time.
REMEMBERED, LONGEST = 600_000, 64
#: Pre-tokens of up to so many bytes are merged in a list; their pairs' ranks are few enough to look at all of them each time.
SHORT = 48
#: What stands for no rank.
NONE = 1 << 62
#: Ids that are decoded at once, about.
IDS_AT_ONCE = 1 << 20


class Bpe:
    """A vocabulary with its ranks. An entry's rank is its id; every single byte has one."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, f)}
        if any(bytes([b]) not in self.ranks for b in range(256)) or len(set(self.ranks.values())) != len(self.ranks):
            raise ValueError("each byte needs a rank, and each entry one of its own")
        self.split = regex.compile(pattern).findall
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.ids, self.entries = np.array([r for _, r in by_rank], np.int64), pa.array([e for e, _ in by_rank], pa.large_binary())
        entries = list(self.ranks)
        keys = word_hashes(entries)
        self.index = mph.Mph(mph.build(keys))
        order = np.argsort(self.index.slots(keys))
        self.by_slot = [entries[k] for k in order]
        self.id_of_slot = [self.ranks[e] for e in self.by_slot]
        self.known: dict[str, bytes] = {}

    def merge(self, part: bytes) -> list[int]:
        """The ids of a pre-token that isn't an entry."""
        n, rank = len(part), self.ranks.get
        if n <= SHORT:
            return self.merge_short(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part begins at each place that is alive
        heap = [(r, k) for k in range(n - 1) if (r := rank(part[k : k + 2])) is not None]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            middle = after[k]
            if middle < 0 or middle == n or rank(part[k : after[middle]]) != r:
                continue  # one of the two parts was merged since
            end = after[k] = after[middle]
            after[middle] = -1
            if end < n:
                before[end] = k
                if (s := rank(part[k : after[end]])) is not None:
                    heappush(heap, (s, k))
            first = before[k]
            if first >= 0 and (s := rank(part[first:end])) is not None:
                heappush(heap, (s, first))
        ids, k = [], 0
        while k < n:
            ids.append(self.ranks[part[k : after[k]]])
            k = after[k]
        return ids

    def merge_short(self, part: bytes) -> list[int]:
        rank = self.ranks.get
        parts, ranks = [part[k : k + 1] for k in range(len(part))], [rank(part[k : k + 2], NONE) for k in range(len(part) - 1)]
        while ranks and (r := min(ranks)) != NONE:
            k = ranks.index(r)
            del ranks[k]
            parts[k] += parts.pop(k + 1)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], NONE)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], NONE)
        return [self.ranks[x] for x in parts]

    def resolve(self, parts: list[str]) -> list[bytes]:
        """The ids of pre-tokens, as 32-bit numbers: whole entries by the index, the rest merged."""
        spelled = [x.encode() for x in parts]
        slots = self.index.slots(word_hashes(spelled)).tolist()
        return [array("i", [self.id_of_slot[s]] if s >= 0 and self.by_slot[s] == x else self.merge(x)).tobytes() for s, x in zip(slots, spelled, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as 32-bit numbers."""
        split = [self.split(t) for t in texts]
        met = set().union(*split)
        new = [x for x in met if x not in self.known]
        if len(self.known) + len(new) > REMEMBERED:  # what was met first is frequent
            self.known = dict(islice(self.known.items(), REMEMBERED // 4))
            new = [x for x in met if x not in self.known]
        self.known.update(zip(new, self.resolve(new), strict=True))
        out = [b"".join(map(self.known.__getitem__, s)) for s in split]
        for x in new:
            if len(x) > LONGEST:
                del self.known[x]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int64())))[0].as_py()

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; of a null list none."""
        values, lengths = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0)
        if values.null_count:
            raise ValueError("no entry has the id None")
        ids = np.asarray(values)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1) if self.ids[-1] >= len(self.ids) else np.clip(ids, 0, len(self.ids) - 1)
        if len(wrong := np.flatnonzero(self.ids[at] != ids)):
            raise ValueError(f"no entry has the id {ids[wrong[0]]}")
        _, offsets, data = self.entries.take(pa.array(at)).buffers()
        begins = np.concatenate([[0], np.cumsum(np.asarray(lengths), dtype=np.int64)])
        edges = np.frombuffer(offsets, np.int64)[begins] if len(ids) else np.zeros(len(begins), np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(edges), data]).cast(pa.binary())


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, ids)."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1), "")
        for a, b in pieces(texts, 4 << 20):
            found = bpe(path, pattern).encode(texts.slice(a, b - a).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], ["id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(..., ids) -> the same with their bytes."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(batch.num_columns - 1)), 0)), dtype=np.int64)
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + IDS_AT_ONCE, "right")))
            some = batch.slice(row, end - row)
            decoded = bpe(path, pattern).decode_lists(some.column(some.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*some.columns, decoded], [*some.schema.names, "decoded"])
            row = end


def encode_bpe(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text, one row for each row of ``docs``.

    ``path`` is a file of ranks (base64 of an entry, blank, rank, one a line) that all executors can read; ``pattern`` cuts texts into
    pre-tokens, which are encoded one by one. There are no special tokens: their names are ordinary text.

    Null and empty texts have no ids. A very long text is encoded whole in one task; its ids must fit a row. Repeated rows each keep
    their row; pairs of equal rank (ties) merge from the left. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, pattern), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_bpe(tokens: DataFrame, path: str, pattern: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded): the bytes that each row's ids stand for (a cut of a text need not be whole UTF-8).

    Null and empty lists decode to no bytes; an id that no entry has, or a null one, is an error. Repeated rows each keep their row.
    An empty table gives an empty result. Other columns are ignored.
    """
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda b: _decode(b, path, pattern), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary")
