"""Substring deduplication by relative Lempel-Ziv parsing over words.

The reference is the corpus itself, cut into blocks that follow from content alone (see ``repeats``) and indexed by anchor.
A document is parsed block by block against all other indexed blocks with the anchor, which lie under it word for word: from a
position on, the longest match with any of them is a factor (reference, place, length), and the next factor begins where it
ends. A block that occurs again as a whole is one factor. Factors of at least a window's words are duplicate spans; where
factors meet, the windows across the boundary are checked one by one for a reference of their own.
"""

from __future__ import annotations

import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted
from .repeats import Block, Windows, as_often, find_repeats, match_blocks
from .symbols import Words

COLUMNS = (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()))


def word_values(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(texts)
    return w.hashes(seed), w.bounds


def count_words(text: bytes) -> int:
    return len(text.split())


def block_words(text: bytes, ranges: list[tuple[int, int]], size: int) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a : b + size - 1]) for a, b in ranges]


def part_of_words(body: bytes, first: int, last: int) -> bytes:
    return b" ".join(body.split()[first:last])


def longest_matches(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column: how many columns the row agrees with another row of its group from there on, and with which.

    ``words`` has one row for each block, aligned by the anchor, and -1 where a block has no word. From the last column to the
    first the rows' suffixes are put in order by (word, order of the suffix after it); the longest match is with a neighbour in
    this order, and is measured word by word.
    """
    n, width = words.shape
    symbols = np.where(words < 0, -1 - np.arange(n, dtype=np.int32)[:, None], words)  # what is missing equals nothing
    length, other, rank = np.zeros((n, width), np.int32), np.zeros((n, width), np.int32), np.zeros(n, np.int64)
    for c in range(width - 1, -1, -1):
        order = np.lexsort((rank, symbols[:, c], group))
        above, below = order[:-1], order[1:]
        near = (group[above] == group[below]) & (symbols[above, c] == symbols[below, c])
        steps = np.concatenate([[0], np.cumsum(~near | (rank[above] != rank[below]))]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = steps
        above, below = above[near], below[near]
        differ = symbols[above, c:] != symbols[below, c:]
        run = np.where(differ.any(axis=1), differ.argmax(axis=1), width - c).astype(np.int32)
        length[above, c], other[above, c] = run, below
        longer = run > length[below, c]
        length[below[longer], c], other[below[longer], c] = run[longer], above[longer]
    return length, other


def parse_blocks(blocks: list[Block], size: int) -> tuple[list[np.ndarray], list[list[tuple[int, int, int, int]]]]:
    """Of each open block the offsets of its windows that another block has, and its factors of at least a window's words.

    Windows inside a factor agree with its reference; a window across a boundary counts if its own longest match is as long.
    """
    split = [b.body.split() for b in blocks]
    known: dict[bytes, int] = {}
    before = max(b.at for b in blocks)
    words = np.full((len(blocks), before + max(len(x) - b.at for b, x in zip(blocks, split, strict=True))), -1, np.int32)
    first = before - np.array([b.at for b in blocks])
    for k, x in enumerate(split):
        words[k, first[k] : first[k] + len(x)] = [known.setdefault(w, len(known)) for w in x]
    length, other = longest_matches(words, np.unique([b.part for b in blocks], return_inverse=True)[1])
    found, factors = [], []
    for k, b in enumerate(blocks):
        found.append(np.flatnonzero(length[k, first[k] : first[k] + b.windows] >= size) if b.open else np.zeros(0, np.int64))
        own, at, end = [], int(first[k]), int(first[k]) + len(split[k])
        while b.open and len(found[k]) and at <= end - size:
            n = int(length[k, at])
            if n >= size:
                ref = int(other[k, at])
                own.append((at - int(first[k]), n, ref, at - int(first[ref])))
            at += max(n, 1)
        factors.append(own)
    return found, factors


def without_factors(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = text.split()
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def windows(min_words: int, gram: int) -> Windows:
    return Windows(min_words, min(gram, min_words), word_values, count_words, block_words, part_of_words, parse_blocks, without_factors, COLUMNS)


def parse(docs: DataFrame, *, min_words: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256): the words of each document that aren't in a factor of ``min_words`` or more.

    A word is removed if a window of ``min_words`` consecutive words that covers it also starts anywhere else in the corpus,
    the same document included; all is judged on the input. Words are split at ASCII white space and compared as they are.
    ``kept_sha256`` is that of the kept words joined by a space, in UTF-8.

    Null and empty texts have no words; very long texts are parsed in parts and finished in one task's memory. Repeated rows are
    copies of each other and lose all windows, whatever their ids (no copy is preferred, so ties don't occur); texts of fewer
    words than a window lose nothing. An empty table gives an empty result. Other columns are ignored.
    """
    return find_repeats(docs, windows(min_words, gram), id_col, text_col)


def factors(docs: DataFrame, *, min_words: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ref_id, ref_start): the factors of ``min_words`` or more of each document, places in words from 0.

    A factor lies within one block, so a longer repeated passage is several factors that overlap or follow each other; which of
    several equal references is given isn't specified. Repeated rows have a factor's rows each, and one that is the whole text of a copy. Nulls, long texts and empty
    tables as in ``parse``.
    """
    w, seed = windows(min_words, gram), secrets.randbits(62) + 1
    met, repeated, found = match_blocks(docs, w, id_col, text_col, seed)
    place = F.struct("row_key", "row_check", "start", "at")
    kinds = repeated.groupBy("anchor", "content", "content_2").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")).where("n > 1")
    whole = join_counted(repeated, kinds, ["anchor", "content", "content_2"]).withColumn("ref", F.when(F.col("one") == place, F.col("other")).otherwise(F.col("one")))
    whole = whole.select("row_key", "row_check", "start", (F.col("end") - F.col("start") + min_words - 1).alias("length"), F.col("ref.row_key").alias("ref_key"), F.col("ref.row_check").alias("ref_check"), F.col("ref.start").alias("ref_start"))
    parts = found.select("row_key", "row_check", F.explode("factors").alias("f")).select("row_key", "row_check", F.col("f.at").alias("start"), "f.length", "f.ref_key", "f.ref_check", F.col("f.ref_at").alias("ref_start"))
    copies = met.where((F.col("repeats") > 1) & (F.col("n_words") >= min_words)).select("row_key", "row_check", F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"), F.col("row_key").alias("ref_key"), F.col("row_check").alias("ref_check"), F.lit(0).alias("ref_start"))
    ids = met.select("id", "row_key", "row_check", "repeats")
    refs = ids.select(F.col("id").alias("ref_id"), F.col("row_key").alias("ref_key"), F.col("row_check").alias("ref_check"))
    whole = whole.unionByName(parts).unionByName(copies)
    return as_often(whole.join(refs, ["ref_key", "ref_check"]).join(ids, ["row_key", "row_check"]).select("id", "start", "length", "ref_id", "ref_start", "repeats"))
