"""SimHash near-duplicates by covering locality-sensitive hashing, without emitting pairs.

Fingerprints are compared under structured bit masks. Each bit has a non-zero vector of radius + 1 bits; each non-zero vector
v of that size is a table, whose mask keeps the bits whose vector has an odd product with v. Any ``radius`` bits leave a v that
is orthogonal to all of theirs, so every pair of fingerprints within the radius agrees under some mask: none is lost.

Inside a bucket, fingerprints are linked through hubs: the value itself and those that differ from it in one free bit. Two
fingerprints of a bucket are within 2 bits if and only if they share a hub, so a group of any size costs a few rows for each
member instead of a row for each pair, every link is exact, and a hub has 65 fingerprints at most.

``drop_near_duplicates`` goes by the similarity of the texts' shingle sets instead. Sets that share four fifths differ in about
ten of 64 bits, which would take thousands of masks to cover; so its candidates are the texts that share a shingle of their
prefixes: of a set in one order for all texts, rare shingles first, so many that two sets without a common one there can't be
similar enough. No pair is lost. Every candidate is verified by its exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, FEW_ROWS, column_name, cut, cut_few, join_counted, let_go, small_batches, stage
from .components import connected
from .repeats import KEY, row_keys

RADIUS = 2
#: One text in so many tells which shingles are frequent, and so many of these are known; any choice gives the same groups.
SAMPLED, FREQUENT = 64, 1 << 17
#: Texts that share a shingle are compared each with each once that takes at most so many pairs for each text and shingle.
PAIRS_A_ROW = 16
#: Numbers in a set's sketch: each of its 64 bits tells whether an odd number of the set's hashes falls on it.
SKETCH = 16
#: A hot text's shingles are dealt to up to so many tasks.
DEALT = 16


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the covering code, one for each table, as signed 64-bit numbers."""
    n = (1 << (radius + 1)) - 1
    found = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(64) if bin((i % n + 1) & v).count("1") % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of a text, repeats included; of all words, if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(x) + 1 for x in parts])
    size = min(shingle, len(parts))
    starts = np.concatenate([[0], ends[:-1]])[: len(parts) - size + 1].tolist()
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(64, np.int64)
    for begin in range(0, len(hashes), 1 << 14):
        part = hashes[begin : begin + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def _text_of(value: pa.Scalar) -> bytes:
    return value.as_py() or b""


def fingerprints_of(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(id, text) -> (id, fingerprint); see ``fingerprints``."""
    for batch in batches:
        out = np.array([fingerprint(shingle_hashes(_text_of(x), shingle)) for x in batch.column(1).cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fingerprint"])


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The prefix of a set of hashes: rare ones first, by ``frequent`` (ascending hashes and their counts), equal ones by the hash.

    A set shares at least ``similarity`` of its own size with any that is similar enough, so one of these is among what they share.
    """
    known, counts = frequent
    n = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        n = np.where(known[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, n))][: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1]


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> Iterator[pa.RecordBatch]:
    """(id, row_key, row_check, text) -> id, keys, content, content_2 (128 bits of the words), size of the set, prefix and sketch."""
    from xxhash import xxh3_128_digest

    let_go()
    for batch in batches:
        contents, sizes, found, sketches = [], [], [], []
        for x in batch.column(3).cast(pa.binary()):
            text = _text_of(x)
            hashes = shingle_hashes(text, shingle)
            contents.append(xxh3_128_digest(b" ".join(text.lower().split())))
            own = np.unique(hashes)
            sketches.append(np.packbits((np.bincount((own % np.uint64(64 * SKETCH)).view(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64))
            sizes.append(len(own))
            found.append(prefix(own, frequent, similarity).view(np.int64) if len(own) else [])
        content = np.frombuffer(b"".join(contents), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(content[:, 0]), pa.array(content[:, 1]), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
            ["id", "row_key", "row_check", "content", "content_2", "size", "prefix", "sketch"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        sets = [np.unique(shingle_hashes(_text_of(x), shingle)).view(np.int64) for x in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(node, rep, text), each rep's own text before those compared with it -> (a, b) of those that are similar."""
    let_go()
    of, other = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for node, rep, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if node == rep and of == rep:
                continue
            own = np.unique(shingle_hashes(_text_of(x), shingle))
            if node == rep:
                of, other = rep, own
                continue
            common = len(np.intersect1d(own, other, assume_unique=True))
            if common >= similarity * (len(own) + len(other) - common):
                found.append((node, rep))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint) for each row of ``docs``, the fingerprint as a signed 64-bit number.

    A-Z are lower-cased; words are split at ASCII white space; a shingle is ``shingle`` words joined by a space (all words, if
    there are fewer), repeats included. A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42). Texts
    without words, null ones among them, have fingerprint 0.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: fingerprints_of(batches, shingle), f"id {kind}, fingerprint bigint")


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fingerprint``) within ``radius`` (0 or 2) bits, a > b.

    Of a hub's fingerprints each is linked to the smallest one, so the links' components are those of all pairs within the radius.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.lit(m).alias("mask")) for k, m in enumerate(masks(radius))])
    rows = values.select("fingerprint", F.explode(tables).alias("t")).select("fingerprint", "t.table", (F.col("fingerprint").bitwiseAND(F.col("t.mask"))).alias("bucket"), F.bitwise_not(F.col("t.mask")).alias("free"))
    shared = rows.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("table", "bucket")
    rows = rows.join(shared, ["table", "bucket"])
    hubs = rows.select("fingerprint", F.explode(hub_values(F.col("fingerprint"), F.col("free"), radius // 2)).alias("hub")).distinct()
    stars = hubs.groupBy("hub").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    return hubs.join(stars, "hub").where(F.col("fingerprint") != F.col("b")).select(F.col("fingerprint").alias("a"), "b").distinct()


def hub_values(value: Column, free: Column, flips: int) -> Column:
    """The value itself and all values that differ from it in up to ``flips`` (0 or 1) of the free bits."""
    own = F.array(value)
    if flips < 1:
        return own
    bits = F.filter(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]), lambda b: b.bitwiseAND(free) != 0)
    return F.concat(own, F.transform(bits, lambda b: value.bitwiseXOR(b)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component): documents whose fingerprints are linked by steps of up to ``radius`` (0 or 2) bits share a
    component, named by the smallest id in it.

    Copies (equal fingerprints) are merged before anything is compared, so a group of thousands of copies is one row. Texts
    without words, null ones among them, are linked like any others, by fingerprint 0; a very long text is hashed whole, in one
    task's memory. Null ids belong to components as well but never name one unless all of a component's ids are null; repeated
    rows and ids keep a row each (ties share the component). An empty table gives an empty result. Other columns are ignored.
    """
    if radius not in (0, 2):
        raise ValueError("hubs are exact for radius 0 and 2")
    marked = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    values = cut(marked.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("id").alias("least_id")))
    roots = connected(links(values.select("fingerprint"), radius))  # (node, root) of linked fingerprints only
    named = values.join(roots, values["fingerprint"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    named = cut(named.select("fingerprint", "n", "root").join(least, "root").select("fingerprint", "n", "component"))
    return join_counted(marked, named, ["fingerprint"]).select("id", "fingerprint", "component")


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that several different texts of a sample have, ascending, and in how many; the FREQUENT most frequent ones."""
    texts = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.xxhash64("text").alias("node"), "text").dropDuplicates(["node"])
    found = texts.mapInArrow(lambda b: _shingle_sets(b, shingle), "node bigint, shingles array<bigint>").select(F.explode("shingles").alias("value"))
    top = found.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n")).limit(FREQUENT).toArrow()
    value, n = np.asarray(top["value"], np.int64).view(np.uint64), np.asarray(top["n"], np.int64)
    order = np.argsort(value)
    return value[order], n[order]


def prefix_rows(contents: DataFrame) -> DataFrame:
    """(value, node, pos, size): the prefixes' hashes that several texts (node, size, prefix) share, with their place."""
    rows = contents.select("node", "size", F.posexplode("prefix").alias("pos", "value"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("value"))).where("n > 1")
    return stage(rows.select("value", "node", "pos", "size"))


def may_be_similar(pairs: DataFrame, contents: DataFrame, similarity: float) -> DataFrame:
    """The pairs (node, rep) without those whose sketches differ in more bits than similar sets in hashes; no similar pair goes."""
    own = contents.select("node", "size", "sketch")
    other = contents.select(F.col("node").alias("rep"), F.col("size").alias("rep_size"), F.col("sketch").alias("rep_sketch"))
    apart = F.aggregate(F.zip_with("sketch", "rep_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("size") + F.col("rep_size")) + F.lit(1e-6)
    return pairs.join(own, "node").join(other, "rep").where(near).select("node", "rep")


def prefix_links(contents: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root): the smallest node of its component for each text (node, first, size, prefix, sketch) that is joined to others,
    where all texts that are similar enough are joined.

    Texts that share a hash of their prefixes are compared unless links join them already. While that would be too many pairs,
    all texts of a hash are compared with a few, which then leave it: with one at first, in each round with four times as many.
    """
    left, few = prefix_rows(contents), 1
    roots = left.select("node", F.col("node").alias("root")).where(F.lit(False))

    def linked(pairs: DataFrame) -> DataFrame:
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(similar(pairs, rows, contents, shingle, similarity))
        found, seen = cut_few(connected(links))
        return F.broadcast(found) if seen["n"] <= FEW_ROWS else found

    while True:
        of = roots.select(F.col("node").alias("of"), "root")
        left = left.select("value", "node", "pos", "size").join(of, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("root", "node")).drop("of")
        of_value = Window.partitionBy("value")
        open_ = (F.min("root").over(of_value) != F.max("root").over(of_value))
        left = stage(left.withColumn("open", open_).withColumn("n", F.count("*").over(of_value)).where("open").drop("open"))
        count, total = left.agg(F.count("*"), F.sum("n")).first()  # the sum of the squares of the values' counts
        if not count:
            return roots
        last = total // 2 <= PAIRS_A_ROW * count
        other = left if last else cut(left.withColumn("at", F.row_number().over(of_value.orderBy(F.xxhash64("root", "node")))).where(F.col("at") <= few))
        other = other.select("value", F.col("node").alias("rep"), F.col("pos").alias("rep_pos"), F.col("size").alias("rep_size"), F.col("root").alias("rep_root"), "n")
        met = join_counted(left.drop("n"), other, ["value"])
        rest = F.least(F.col("size") - F.col("pos"), F.col("rep_size") - F.col("rep_pos"))  # at most so many are common, if this is the first
        enough = rest >= F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("rep_size")) - F.lit(1e-6))
        pairs = met.where((F.col("root") != F.col("rep_root")) & enough).select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct()
        pairs, found = cut_few(may_be_similar(pairs, contents, similarity))
        if found["n"]:
            firsts, _ = cut_few(pairs.groupBy("node").agg(F.min("rep").alias("rep")))  # what these link needs no more comparison
            roots = linked(firsts)
            ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("node", "rep")]
            apart = pairs.join(firsts, ["node", "rep"], "left_anti").join(ends[0], "node", "left").join(ends[1], "rep", "left")
            apart, found = cut_few(apart.where(F.coalesce("node_root", "node") != F.coalesce("rep_root", "rep")).select("node", "rep"))
            roots = linked(apart) if found["n"] else roots
        if last:
            return roots
        left, few = left.join(other.select("value", F.col("rep").alias("node")), ["value", "node"], "left_anti"), 4 * few


def similar(pairs: DataFrame, rows: DataFrame, contents: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): the pairs (node, rep) whose texts have shingle sets that share ``similarity`` of their union."""
    asked = pairs.select(F.explode(F.array("node", "rep")).alias("node")).distinct()
    asked, seen = cut_few(contents.select("node", "first.row_key", "first.row_check").join(asked, "node"))
    asked = F.broadcast(asked) if seen["n"] <= BROADCAST_ROWS else asked
    texts = rows.join(asked, ["row_key", "row_check"]).select("node", "text").dropDuplicates(["node"])  # of repeated rows one
    pairs = pairs.withColumn("dealt", F.pmod(F.xxhash64("node"), F.lit(DEALT)))
    asked_by = pairs.select("node", "rep", "dealt").unionByName(pairs.select(F.col("rep").alias("node"), "rep", "dealt").distinct())
    groups = texts.join(asked_by, "node").repartition("rep", "dealt").sortWithinPartitions("rep", "dealt", F.col("node") != F.col("rep"))
    return groups.select("node", "rep", "text").mapInArrow(lambda b: _compared(b, shingle, similarity), "a bigint, b bigint").distinct()


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: one with the smallest id (a null id comes last), of these one by its
    text's hash. The rows keep all their columns, whatever their names.

    Two texts are near-duplicates if they have the same words, or if their sets of ``shingle`` consecutive words (all words, if
    there are fewer; A-Z lower-cased) share at least ``similarity`` of their union; groups are the components of such pairs.
    No such pair is missed, whatever else its texts share; sets are told by 64-bit hashes.

    Texts without words, null ones among them, are copies of each other. A very long text is hashed whole, in one task's memory.
    Of a repeated row one stays. An empty table gives an empty result. Sets the session's bound of batches for Python (``small_batches``).
    """
    small_batches(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    frequent = frequent_shingles(rows, shingle)
    marked = rows.mapInArrow(lambda b: _signatures(b, shingle, frequent, similarity), f"id {kind}, {KEY}, content bigint, content_2 bigint, size int, prefix array<bigint>, sketch array<bigint>")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row_key", "row_check"))
    contents = marked.groupBy("content", "content_2").agg(first.alias("first"), *[F.first(c).alias(c) for c in ("size", "prefix", "sketch")])
    contents = stage(contents.select(F.monotonically_increasing_id().alias("node"), "first", "size", "prefix", "sketch"))
    roots = prefix_links(contents, rows, shingle, similarity).select(F.col("node").alias("of"), "root")
    named = contents.join(roots, contents["node"] == roots["of"], "left").withColumn("root", F.coalesce("root", "node"))
    keys = {c: column_name(docs, f"_{c}") for c in ("row_key", "row_check", "order")}
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row_key").alias(keys["row_key"]), F.col("first.row_check").alias(keys["row_check"]))
    keyed = docs.select(*[docs[c] for c in docs.columns], *[c.alias(keys[x]) for c, x in zip(row_keys(id_col, text_col), ("row_key", "row_check"), strict=True)])
    at = [keys["row_key"], keys["row_check"]]
    one = F.row_number().over(Window.partitionBy(*at).orderBy(at[0]))
    return keyed.join(keep, at, "left_semi").withColumn(keys["order"], one).where(F.col(keys["order"]) == 1).select(*[F.col(c) for c in docs.columns])
