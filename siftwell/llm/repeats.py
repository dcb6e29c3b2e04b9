"""Exact repeated windows of a corpus: which symbols (words or bytes) lie in a window that also starts somewhere else.

Both substring operators use this frame and differ in how they compare blocks (``Windows.resolve``).

1. A window's anchor is the leftmost smallest hash among its short grams: equal windows have equal anchors, at the same place.
   Consecutive windows with one anchor form a block, so a text is a sequence of blocks. The anchors' counts over the corpus
   are the index.
2. A block whose anchor is unique has no repeated window. Blocks that are equal as a whole are repeated as a whole; they are told by
   128 bits under a seed drawn for the job, so nobody can build texts that share them. Blocks alone among different ones stay open.
3. Texts meet their blocks once. A text without open blocks is finished there. Of open blocks, and of one block of each other
   kind with the same anchor, the symbols are written out, dealt by anchor, and compared.
4. Open texts meet the findings and are finished.

Shuffled are: 8 bytes and a count for each block (one of a dozen words or 75 bytes), the repeated blocks, the texts once, and
the open texts again. An anchor with a third of all blocks is counted before the shuffle; of its blocks only different ones
reach step 3. Where more than GROUP different ones have one anchor, they are split: windows whose anchor is nearer to their
begin than to their end share more symbols after it, the others more before it; these shared symbols deal each half anew, down
to single windows if need be. Halves that are equal as a whole are settled there by an aggregate, and one of them goes on, so
near copies soon are few rows. So equal windows always meet, and no group is compared in one task that is larger than GROUP.
Equal rows (id and text) take part once; all their windows are repeated.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted, join_lookup, stage
from .symbols import Rolling, pieces, sliding_min

#: A text is cut into blocks in parts of so many symbols; two blocks may take the place of one where parts meet.
SEGMENT = 1 << 26
POSITION_BITS = 28
#: Different blocks of one anchor that one task compares; more are split by what stands around the anchor.
GROUP = 500
#: Windows that a task compares at once.
WINDOWS_AT_ONCE = 400_000
KEY = "row_key bigint, row_check int"
BLOCKS = "array<struct<start:int,end:int,at:int,open:boolean,anchor:bigint>>"
RECORD = "array<struct<anchor:bigint,start:int,end:int,at:int,open:boolean,body:binary>>"
FOUND = f"{KEY}, start int, offsets binary, factors array<struct<at:int,length:int,ref_key:bigint,ref_check:int,ref_at:int>>"
PART = f"part bigint, anchor bigint, {KEY}, start int, end int, at int, low int, high int, open boolean, body binary"
PART_COLUMNS = [c.split()[0] for c in PART.split(", ")]


@dataclass(frozen=True)
class Block:
    """A block written out for comparing: where its windows start in its text, where its anchor is in its symbols, and its symbols."""

    part: int
    anchor: int
    row_key: int
    row_check: int
    start: int
    end: int
    at: int
    low: int
    high: int
    open: bool
    body: bytes

    @property
    def windows(self) -> int:
        return self.end - self.start


@dataclass(frozen=True)
class Windows:
    """How a text becomes symbols, and how windows are told apart. All functions are module-level ones, so that tasks can load them."""

    size: int
    gram: int
    #: texts, seed -> values of all symbols, and where each text's begin (one more entry than texts).
    symbols: Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]
    #: one text -> how many symbols it has.
    count: Callable[[bytes], int]
    #: one text, block ranges (start, end of the windows' starts), size -> the symbols of each block, written out.
    bodies: Callable[[bytes, list[tuple[int, int]], int], list[bytes]]
    #: symbols written out, first, last -> those from number first up to last.
    part: Callable[[bytes, int, int], bytes]
    #: blocks, size -> of each the offsets of its windows that another block has (only those of open blocks count), and factors
    #: (offset, length, number of another block, offset there).
    resolve: Callable[[list[Block], int], tuple[list[np.ndarray], list[list[tuple[int, int, int, int]]]]]
    #: one text, merged ranges of removed symbols -> the result columns.
    finish: Callable[[bytes, list[tuple[int, int]]], tuple]
    #: The result columns, as (name, Arrow type).
    columns: tuple[tuple[str, pa.DataType], ...]


def row_keys(id_col: str, text_col: str, seed: int = 0) -> list[Column]:
    """96 bits that are equal for repeated rows only; under a seed that isn't known nobody can build other ones."""
    own = [F.lit(seed)] if seed else []
    return [F.xxhash64(*own, id_col, text_col).alias("row_key"), F.hash(F.lit("row"), *own, F.col(id_col), F.octet_length(F.col(text_col).cast("string"))).alias("row_check")]


def blocks_of(values: np.ndarray, bounds: np.ndarray, size: int, gram: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text, start, end, at, anchor, content): each block's text, the range of its windows' starts (from the text's begin), the
    place of its anchor after the first of them, the anchor and a hash of all its symbols (two numbers)."""
    found = []
    for low in range(0, max(len(values), 1), SEGMENT):
        high = min(low + SEGMENT + size - 1, len(values))
        inner = np.clip(bounds, low, high) - low
        of = _blocks_of(values[low:high], inner, size, gram, seed)
        first = np.maximum(low - bounds[of[0]], 0)  # a text's symbols before this part
        found.append((of[0], of[1] + first, of[2] + first, *of[3:]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def contents(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """128 bits of the symbols of each range, as two numbers."""
    from xxhash import xxh3_128_digest

    symbols = memoryview(np.ascontiguousarray(values)).cast("B")
    digests = [xxh3_128_digest(symbols[a:b], seed) for a, b in zip((8 * starts).tolist(), (8 * ends).tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _blocks_of(values: np.ndarray, bounds: np.ndarray, size: int, gram: int, seed: int) -> tuple[np.ndarray, ...]:
    n = len(values) - size + 1
    if n <= 0:
        return *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64)), np.zeros((0, 2), np.uint64)
    grams = Rolling(values).windows(gram)
    ranked = (grams >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(ranked, size - gram + 1)[:n] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    counts = np.diff(bounds)
    inside = (np.repeat(bounds[1:], counts) - np.arange(len(values)))[:n] >= size
    new = inside.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new)
    after = np.append(~inside[1:] | new[1:], True)
    ends = np.flatnonzero(inside & after) + 1
    text = np.searchsorted(bounds, starts, "right") - 1
    return text, starts - bounds[text], ends - bounds[text], at[starts] - starts, grams[at[starts]], contents(values, starts, ends + size - 1, seed)


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    """A record batch of arrays or lists by a schema of simple types."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, names, strict=True)], [n for n, _ in names])


FOUND_BLOCKS = f"{KEY}, start int, end int, at int, anchor bigint, content bigint, content_2 bigint"


def _find_blocks(batches: Iterator[pa.RecordBatch], w: Windows, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, checks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for a, b in pieces(batch.column(2)):
            values, bounds = w.symbols(batch.column(2).slice(a, b - a), seed)
            text, start, end, at, anchor, content = blocks_of(values, bounds, w.size, w.gram, seed)
            yield _batch([keys[a:b][text], checks[a:b][text], start, end, at, anchor.view(np.int64), content[:, 0].view(np.int64), content[:, 1].view(np.int64)], FOUND_BLOCKS)


def merged(ranges: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of windows' starts as merged ranges of the symbols under the windows. ``ranges`` has rows (start, end)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, ranges.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + size - 1))
        else:
            out.append((a, b + size - 1))
    return out


def _results(rows: list[tuple], w: Windows) -> list[pa.Array]:
    return [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(w.columns)]


def _meet(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """(id, row_key, row_check, text, repeats, blocks) -> the results of finished texts; of open ones the text, its removed ranges so far, and records."""
    record = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("open", pa.bool_()), ("body", pa.binary())]))
    names = ["id", "row_key", "row_check", "repeats", "text", "known", "records", *[c for c, _ in w.columns]]
    for batch in batches:
        texts = batch.column(3).cast(pa.large_binary())
        done, text_out, known_out, records_out = [], [], [], []
        for row, (blocks, repeats) in enumerate(zip(batch.column(5).to_pylist(), batch.column(4).to_pylist(), strict=True)):
            text = texts[row].as_py() or b""
            blocks = blocks or []
            if repeats > 1:  # its copies have all its windows; for others it is compared all the same
                windows = max(w.count(text) - w.size + 1, 0)
                blocks = [b | {"open": False} for b in blocks] + [{"start": 0, "end": windows, "at": 0, "open": False, "anchor": None}] * (windows > 0)
            out = sorted({(b["start"], b["end"], b["at"], b["open"], b["anchor"]) for b in blocks if b["anchor"] is not None})
            known = np.array([(b["start"], b["end"]) for b in blocks if not b["open"]], np.int32).reshape(-1, 2)
            bodies = w.bodies(text, [(s, e) for s, e, *_ in out], w.size) if out else []
            records_out.append([{"anchor": a, "start": s, "end": e, "at": at, "open": o, "body": x} for (s, e, at, o, a), x in zip(out, bodies, strict=True)])
            if any(o for *_, o, _ in out):
                done.append((None,) * len(w.columns))
                text_out.append(text)
                known_out.append(known.tobytes())
            else:
                done.append(w.finish(text, merged(known, w.size)))
                text_out.append(None)
                known_out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(4), pa.array(text_out, pa.binary()), pa.array(known_out, pa.binary()), pa.array(records_out, record), *_results(done, w)], names)


def _compare(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Blocks (PART) in order of their part -> FOUND of open blocks with repeated windows or factors."""
    factor = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ref_key", pa.int64()), ("ref_check", pa.int32()), ("ref_at", pa.int32())]))

    def compared(rows: list[Block]) -> pa.RecordBatch:
        found, factors = w.resolve(rows, w.size)
        hits = []
        for r, x, own in zip(rows, found, factors, strict=True):
            if r.open and (len(x) or own):
                refs = [{"at": r.start + a, "length": n, "ref_key": rows[k].row_key, "ref_check": rows[k].row_check, "ref_at": rows[k].start + b} for a, n, k, b in own]
                hits.append((r.row_key, r.row_check, r.start, x.astype(np.int32).tobytes(), refs))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), factor)
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], t) for k, t in enumerate(kinds)], ["row_key", "row_check", "start", "offsets", "factors"])

    waiting: list[Block] = []
    windows = 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            block = Block(*row)
            if waiting and block.part != waiting[-1].part and windows >= WINDOWS_AT_ONCE:
                yield compared(waiting)
                waiting, windows = [], 0
            waiting.append(block)
            windows += block.windows
    if waiting:
        yield compared(waiting)


def _split(batches: Iterator[pa.RecordBatch], w: Windows, seed: int) -> Iterator[pa.RecordBatch]:
    """Blocks (PART) -> each as its windows with the anchor in the lower and in the upper half of the places it may have.

    All windows of a half have some symbols around the anchor in common; their hash, with the half, is the new part.
    """
    for batch in batches:
        rows, values = [], []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            b = Block(*row)
            middle = (b.low + b.high) // 2
            for low, high in ((b.low, middle), (middle + 1, b.high)):
                # a window's place of the anchor is b.at for the first one and falls by one with each
                first, last = max(b.at - high, 0), min(b.at - low, b.windows - 1)
                if first <= last and low <= high:
                    rows.append((b.anchor, b.row_key, b.row_check, b.start + first, b.start + last + 1, b.at - first, low, high, b.open, w.part(b.body, first, last + w.size)))
                    values.append((w.part(b.body, b.at - low, b.at - high + w.size), low))
        texts = pa.array([v for v, _ in values], pa.large_binary())
        of, bounds = w.symbols(texts, seed)
        hashes = Rolling(of).of(bounds[:-1], bounds[1:]) + np.array([low for _, low in values], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        anchors = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        yield _batch([(hashes ^ (anchors * np.uint64(0xD6E8FEB86659FD93))).view(np.int64), *[[r[k] for r in rows] for k in range(10)]], PART)


def _all_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_key, row_check, start, windows, factors) -> FOUND, with all the windows."""
    for batch in batches:
        offsets = [np.arange(n, dtype=np.int32).tobytes() for n in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(offsets, pa.binary()), batch.column(4)], ["row_key", "row_check", "start", "offsets", "factors"])


def settle(records: DataFrame, w: Windows) -> tuple[DataFrame, DataFrame]:
    """One of each of the blocks (PART) of a part that are equal as a whole, and FOUND of those: all their windows are repeated.

    The one that stays is compared with the others of its part, so it is open only if it has no equal. Equal are the symbols
    themselves and the anchor's place.
    """
    keys, place = ["part", "at", "body"], F.struct("row_key", "row_check", "start")
    one = F.struct("row_key", "row_check", "start", "end", "anchor", "low", "high", "open")
    kinds = stage(records.groupBy(*keys).agg(F.count("*").alias("n"), F.min(one).alias("one"), F.max(place).alias("other")))
    kept = kinds.select(*keys, "one.*", "n").withColumn("open", F.col("open") & (F.col("n") == 1)).select(*PART_COLUMNS)
    equal = join_counted(records.where("open"), kinds.where("n > 1").select(*keys, "n", place_of("one").alias("one"), "other"), keys)
    ref = F.when(F.col("one") == place, F.col("other")).otherwise(F.col("one"))
    factor = F.struct(F.col("start").alias("at"), (F.col("end") - F.col("start") + w.size - 1).alias("length"), ref["row_key"].alias("ref_key"), ref["row_check"].alias("ref_check"), ref["start"].alias("ref_at"))
    hits = equal.select("row_key", "row_check", "start", (F.col("end") - F.col("start")).alias("windows"), F.array(factor).alias("factors"))
    return kept, hits.mapInArrow(_all_windows, FOUND)


def place_of(block: str) -> Column:
    return F.struct(*[F.col(f"{block}.{c}").alias(c) for c in ("row_key", "row_check", "start")])


def compare_blocks(records: DataFrame, w: Windows, seed: int) -> DataFrame:
    """FOUND for the blocks (PART) of all parts; parts with too many blocks are split first, down to single windows."""
    found, places = None, w.size - w.gram + 1
    while True:
        large = cut(records.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > GROUP))
        n_large = large.count()
        marked = join_lookup(records, large.select("part", F.lit(True).alias("large")), "part", n_large, F.col("row_key")) if n_large else records.withColumn("large", F.lit(None).cast("boolean"))
        usual = marked.where("large IS NULL").drop("large")
        dealt = usual.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: _compare(b, w), FOUND)
        found = dealt if found is None else found.unionByName(dealt)
        if not n_large:
            return found
        met = stage(marked.where("large").drop("large"))
        if places == 1:
            return found.unionByName(settle(met, w)[1])
        places = -(-places // 2)
        split = met.where("low < high").select(*PART_COLUMNS).mapInArrow(lambda b: _split(b, w, seed), PART)
        records, equal = settle(stage(split), w)
        found = found.unionByName(equal)


def _finish(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """(id, text, known, findings) -> results."""
    for batch in batches:
        rows = []
        for text, known, findings in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
            ranges = [np.frombuffer(known, np.int32).reshape(-1, 2)]
            for f in findings or []:
                starts = np.frombuffer(f["offsets"], np.int32) + f["start"]
                ranges.append(np.stack([starts, starts + 1], axis=1))
            rows.append(w.finish(text, merged(np.concatenate(ranges), w.size)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *_results(rows, w)], ["id", *[c for c, _ in w.columns]])


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(id, row_key, row_check, text, repeats): one of each of the rows that are equal, with how many there are."""
    rows = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col, seed), F.col(text_col).cast("string").alias("text"))
    again = cut(rows.groupBy("row_key", "row_check").agg(F.count("*").alias("repeats")).where("repeats > 1"))
    n = again.count()
    if not n:
        return rows.withColumn("repeats", F.lit(1).cast("long"))
    key = F.struct("row_key", "row_check").alias("key")
    marked = join_lookup(rows.withColumn("key", key), again.select(key, "repeats"), "key", n, F.monotonically_increasing_id()).drop("key")
    ones = marked.where("repeats IS NOT NULL").groupBy("row_key", "row_check").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.first("repeats").alias("repeats"))
    return marked.where("repeats IS NULL").withColumn("repeats", F.lit(1).cast("long")).unionByName(ones)


def match_blocks(docs: DataFrame, w: Windows, id_col: str, text_col: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts met with their blocks (see ``_meet``), the repeated blocks, and FOUND of the open ones."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    base = keyed_rows(docs, id_col, text_col, seed)
    blocks = base.select("row_key", "row_check", "text").mapInArrow(lambda b: _find_blocks(b, w, seed), FOUND_BLOCKS)
    mixed = (F.min("content") != F.max("content")) | (F.min("content_2") != F.max("content_2"))
    index = blocks.groupBy("anchor").agg(F.count("*").alias("n"), mixed.alias("mixed"))
    repeated = stage(join_counted(blocks, cut(index.where("n > 1")), ["anchor"]).drop("n"))
    place = F.struct("row_key", "row_check", "start")
    kinds = cut(repeated.where("mixed").groupBy("anchor", "content", "content_2").agg(F.count("*").alias("n"), F.min(place).alias("one")))
    told = join_counted(repeated.where("mixed"), kinds, ["anchor", "content", "content_2"])
    told = told.select("row_key", "row_check", "start", "end", "at", (F.col("n") == 1).alias("open"), F.when(F.col("one") == place, F.col("anchor")).alias("anchor"))
    plain = repeated.where("NOT mixed").select("row_key", "row_check", "start", "end", "at", F.lit(False).alias("open"), F.lit(None).cast("bigint").alias("anchor"))
    of_text = plain.unionByName(told).groupBy("row_key", "row_check").agg(F.collect_list(F.struct("start", "end", "at", "open", "anchor")).alias("blocks"))
    met = base.join(of_text, ["row_key", "row_check"], "left").select("id", "row_key", "row_check", "text", "repeats", F.col("blocks").cast(BLOCKS).alias("blocks"))
    met = stage(met.mapInArrow(lambda b: _meet(b, w), f"id {kind}, {KEY}, repeats long, text binary, known binary, records {RECORD}, {result_columns(w)}"))
    records = met.select("row_key", "row_check", F.explode("records").alias("r"))
    records = records.select(F.col("r.anchor").alias("part"), "r.anchor", "row_key", "row_check", "r.start", "r.end", "r.at", F.lit(0).alias("low"), F.lit(w.size - w.gram).alias("high"), "r.open", "r.body")
    return met, repeated, compare_blocks(records, w, seed)


def result_columns(w: Windows) -> str:
    return ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in w.columns)


def as_often(rows: DataFrame) -> DataFrame:
    """Each row ``repeats`` times, without that column."""
    many = rows.where("repeats > 1")
    blocks = many.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "repeats", F.lit(4096).cast("long"))).alias("_low"))
    many = blocks.select("*", F.explode(F.sequence("_low", F.least(F.col("_low") + 4095, "repeats"))).alias("_at")).drop("_low", "_at")
    return rows.where("repeats = 1").unionByName(many).drop("repeats")


def find_repeats(docs: DataFrame, w: Windows, id_col: str, text_col: str) -> DataFrame:
    """``id`` and the result columns of ``w`` for each row of ``docs``. Results don't depend on the seed that is drawn."""
    met, _, found = match_blocks(docs, w, id_col, text_col, secrets.randbits(62) + 1)
    kind = met.schema["id"].dataType.simpleString()
    findings = found.groupBy("row_key", "row_check").agg(F.collect_list(F.struct("start", "offsets")).alias("findings"))
    opened = met.where(F.col("text").isNotNull()).select("id", "row_key", "row_check", "text", "known").join(findings, ["row_key", "row_check"], "left")
    opened = opened.select("id", "text", "known", "findings").mapInArrow(lambda b: _finish(b, w), f"id {kind}, {result_columns(w)}")
    done = as_often(met.where(F.col("text").isNull()).select("id", *[c for c, _ in w.columns], "repeats"))
    return done.unionByName(opened)  # rows with copies are never open
