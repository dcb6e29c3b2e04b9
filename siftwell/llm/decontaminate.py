"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, looked up for every training token window.

Only DataFrame functions are used, and one way serves test sets of any size: every position of a text has the hash of its next
few words (its head), and those that are the head of some test window are found by a hash join. That set is broadcast while
its row count is within bounds; beyond, the same join is a shuffle of (document, position, head), dealt by head and salt. Only
positions found, a small part of the corpus, are then compared word by word with the whole windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import NOT_ALNUM, ascii_lower, column_name, cut, join_lookup, word_count, words

#: The words of a head; windows of fewer words are heads themselves.
HEAD = 5


def normalised(text: Column) -> Column:
    return words(ascii_lower(text), NOT_ALNUM)


def benchmark_grams(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, size, gram): the distinct windows of ``n`` words of each item; an item with fewer words is one window.

    Items with no word (null and empty texts among them) have none.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), normalised(F.col(text_col)).alias("tokens"))
    items = items.where(F.size("tokens") > 0).withColumn("size", F.least(F.size("tokens"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("tokens") - F.col("size") + 1)
    grams = items.select("item_id", "size", F.explode(F.transform(starts, lambda i: F.slice(F.col("tokens"), i, F.col("size")))).alias("gram"))
    return grams.distinct()


def heads(tokens: str, size: int) -> Column:
    """The hash of the ``size`` words from each position on, in order (the last ``size`` - 1 positions have none)."""
    at = ", ".join(f"get({tokens}, i + {j})" for j in range(size))
    return F.expr(f"IF(size({tokens}) >= {size}, transform(sequence(0, size({tokens}) - {size}), i -> xxhash64({at})), CAST(array() AS array<bigint>))")


def find_windows(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key_id, key_text, hits, items) of the documents with hits: (pos, size) of each window found, the items they are from.

    A key is the document's id and the hash of its text: equal rows have one key, and one row here. Item ids are strings.
    """
    grams = cut(benchmark_grams(benchmark, n, item_id_col, item_text_col))
    grams = grams.withColumn("head_size", F.least("size", F.lit(HEAD)))
    known = cut(grams.select("head_size", "size", *[F.get("gram", F.lit(j)).alias(f"w{j}") for j in range(HEAD)]).distinct())
    found = None
    for size in sorted(r[0] for r in known.select("head_size").distinct().collect()):  # HEAD values at most
        own = known.where(F.col("head_size") == size).select(F.xxhash64(*[f"w{j}" for j in range(size)]).alias("head"), "size")
        own = cut(own.groupBy("head").agg(F.collect_set("size").alias("sizes")))
        places = docs.select(F.col(id_col).alias("key_id"), F.col(text_col).alias("text")).withColumn("tokens", normalised(F.col("text")))
        places = places.select("key_id", F.xxhash64("text").alias("key_text"), F.posexplode(heads("tokens", size)).alias("pos", "head"))
        met = join_lookup(places, own, "head", own.count(), F.struct("key_id", "key_text", "pos"), "inner").select("key_id", "key_text", "pos", F.explode("sizes").alias("size"))
        found = met if found is None else found.unionByName(met)
    if found is None:
        kind = docs.select(F.col(id_col).alias("key_id"), F.xxhash64(text_col).alias("key_text")).where(F.lit(False))
        return kind.select("key_id", "key_text", F.array().cast("array<struct<pos:int,size:int>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    likely = cut(found.groupBy("key_id", "key_text").agg(F.collect_set(F.struct("pos", "size")).alias("likely")))
    texts = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), likely, "id", "text", "inner")
    texts = texts.select("key_id", "key_text", "likely", normalised(F.col("text")).alias("tokens"))
    inside = F.filter("likely", lambda w: w["pos"] + w["size"] <= F.size("tokens"))
    windows = texts.select("key_id", "key_text", F.explode(F.transform(inside, lambda w: F.struct(w["pos"].alias("pos"), w["size"].alias("size"), F.slice(F.col("tokens"), w["pos"] + 1, w["size"]).alias("gram")))).alias("w"))
    windows = windows.select("key_id", "key_text", "w.*").distinct().withColumn("hash", F.xxhash64("gram"))
    whole = cut(grams.groupBy("gram").agg(F.collect_set("item_id").alias("item_ids")).select(F.col("gram").alias("of_item"), "item_ids"))
    lookup = whole.groupBy(F.xxhash64("of_item").alias("hash")).agg(F.collect_list(F.struct("of_item", "item_ids")).alias("known"))
    same = F.filter("known", lambda k: k["of_item"] == F.col("gram"))
    hits = join_lookup(windows, lookup, "hash", whole.count(), F.struct("key_id", "pos"), "inner").withColumn("same", same).where(F.size("same") > 0)
    return hits.groupBy("key_id", "key_text").agg(F.collect_set(F.struct("pos", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set(F.get("same", F.lit(0))["item_ids"]))).alias("items"))


def with_key(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` joined to a table of (key_id, key_text, ...), whatever columns it has; broadcast if it has few rows and array entries.

    The key columns may be renamed; they come first. Beyond the bound one key's rows are repeated rows of one document. For an inner
    join the keys alone are then broadcast while their rows are few, so that only the documents they name are shuffled.
    """
    key_id, key_text = found.columns[:2]
    if how == "left_anti":
        found = found.select(key_id, key_text)
    cells = [F.size(c) for c, t in found.dtypes if t.startswith("array")]
    total, count = found.agg(F.sum(sum(cells, F.lit(1))), F.count("*")).first()
    same = lambda of: docs[id_col].eqNullSafe(of[key_id]) & (F.xxhash64(docs[text_col]) == of[key_text])
    if how == "inner" and count <= common.BROADCAST_ROWS < (total or 0):
        docs = docs.join(F.broadcast(found.select(key_id, key_text)), same(found), "left_semi")
    right = F.broadcast(found) if (total or 0) <= common.BROADCAST_ROWS else found
    return docs.join(right, same(found), how)


def hit_positions(hits: Column) -> Column:
    """The distinct word positions that the windows cover."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["size"] - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", mode: str = "report") -> DataFrame:
    """Find (``report``) or remove (``documents``, ``spans``) what the corpus shares with test items.

    Texts are ASCII lower-cased; words are runs of ASCII letters, digits and non-ASCII characters. A window is ``n``
    consecutive words of an item, or the whole of a shorter one. A document word inside any occurrence of a window is hit.

    ``report``: id, n_words, n_hit, n_items, items (ids as strings, sorted as strings) per row of ``docs``.
    ``documents``: the rows of ``docs`` without any hit. ``spans``: all rows; in those with hits the text is the remaining
    normalised words joined by spaces.

    Null and empty texts have no words and are never hit. The words of a text, very long ones included, are an array of one row;
    all steps are linear in it. Repeated rows and repeated ids are judged each by their own text; ties don't occur. Items without
    words match nothing; repeated items count each. Empty tables give empty or hit-free results. All columns of ``docs`` are
    kept as they are, whatever their names.
    """
    found = cut(find_windows(docs, benchmark, n=n, id_col=id_col, text_col=text_col))
    names = {c: column_name(docs, f"_{c}") for c in found.columns}
    renamed = found.select(*[F.col(c).alias(x) for c, x in names.items()])
    if mode == "documents":
        return with_key(docs, renamed, id_col, text_col, "left_anti")
    if mode == "spans":
        tokens, hits = normalised(docs[text_col]), F.col(names["hits"])
        left = F.array_except(F.sequence(F.lit(0), F.size(tokens) - 1), hit_positions(hits))  # with hits there are words
        text = F.array_join(F.transform(left, lambda i: F.get(tokens, i)), " ")
        joined = with_key(docs, renamed, id_col, text_col, "left")
        return joined.select(*[F.when(hits.isNull(), docs[c]).otherwise(text).alias(c) if c == text_col else docs[c] for c in docs.columns])
    counts = found.select("key_id", "key_text", F.size(hit_positions(F.col("hits"))).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text"), word_count(ascii_lower(text), NOT_ALNUM).alias("n_words"))
    joined = with_key(rows, counts.withColumn("key_text", F.xxhash64("key_text")), "id", "text", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
