"""Substring deduplication by sorting suffixes: multikey sorting to a shallow depth, then blind tries.

Only suffixes that could share a window with another one are sorted: those in blocks whose anchor occurs with different
surroundings, one block of each kind (see ``repeats``). They are dealt by anchor, so equal windows meet in one task; a hot
anchor's suffixes are dealt by more bytes around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Block, Windows, find_repeats
from .symbols import BYTE_VALUES, text_buffers

#: Bytes by which suffixes are sorted before what is still equal goes into blind tries.
SHALLOW = 32


def byte_values(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(texts)
    return BYTE_VALUES[data], offsets


def part_of_bytes(body: bytes, first: int, last: int) -> bytes:
    return body[first:last]


def block_bytes(text: bytes, ranges: list[tuple[int, int]], size: int) -> list[bytes]:
    return [text[a : b + size - 1] for a, b in ranges]


def shallow_sort(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes, and the group of equals that each is in (numbered in that order).

    Multikey sorting over eight bytes at a time: after each key only groups that are still equal are sorted on.
    """
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    n = len(data) + depth
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys |= padded[k : n + k] << np.uint64(56 - 8 * k)
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for at in range(0, depth, 8):
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        key = keys[starts[order[tied]] + at]
        by = np.lexsort((key, group[tied]))
        order[tied], key, of = order[tied][by], key[by], group[tied][by]
        new = np.zeros(len(order), np.int64)
        new[0] = 0
        new[1:] = group[1:] != group[:-1]
        split = np.flatnonzero((of[1:] == of[:-1]) & (key[1:] != key[:-1])) + 1
        new[tied[split]] = 1
        group = np.cumsum(new)
    return order, group


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Texts of one length in order: lists of the numbers of equal ones.

    Inner nodes know only at which byte their texts differ. A text goes down by these bytes alone to some leaf, is compared
    with it once, and branches off where they first differ.
    """
    size = len(texts[0])
    root: list = [size, None, [0]]  # a leaf: (size, None, numbers); an inner node: (byte, children, None)
    for n in range(1, len(texts)):
        text = texts[n]
        node = root
        while node[1] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = texts[node[2][0]]
        if text == other:
            node[2].append(n)
            continue
        differ = size - ((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() + 7) // 8
        above, node = None, root
        while node[1] is not None and node[0] < differ:
            above, node = node, node[1][text[node[0]]]
        leaf = [size, None, [n]]
        if node[1] is not None and node[0] == differ:
            node[1][text[differ]] = leaf
            continue
        inner = [differ, {other[differ]: node, text[differ]: leaf}, None]
        if above is None:
            root = inner
        else:
            above[1][text[above[0]]] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out.append(node[2])
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def sort_suffixes(blocks: list[Block], size: int) -> tuple[list[np.ndarray], list[list]]:
    """Offsets of each open block's windows whose suffix agrees with a neighbour in the order of all suffixes for ``size`` bytes."""
    joined = b"".join(b.body for b in blocks)
    data = np.frombuffer(joined, np.uint8)
    is_open = np.array([b.open for b in blocks], bool)
    counts = np.array([b.windows for b in blocks])
    block = np.repeat(np.arange(len(blocks)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = np.concatenate([[0], np.cumsum([len(b.body) for b in blocks])])
    starts = np.arange(len(block)) - first[block] + begin[block]
    order, group = shallow_sort(data, starts, min(SHALLOW, size // 8 * 8))
    twice = np.zeros(len(block), bool)
    cuts = np.flatnonzero(np.diff(group)) + 1
    lows, highs = np.concatenate([[0], cuts]), np.append(cuts, len(order))
    wanted = np.add.reduceat(is_open[block[order]].astype(np.int64), lows) > 0 if len(order) else np.zeros(0, bool)
    deep = wanted & (highs - lows > 1)
    for low, high in zip(lows[deep].tolist(), highs[deep].tolist(), strict=True):
        members = order[low:high]
        at = starts[members].tolist()
        for equal in blind_trie([joined[a : a + size] for a in at]):
            if len(equal) > 1:
                twice[members[equal]] = True
    found = [np.flatnonzero(twice[first[k] : first[k + 1]]) if o else np.zeros(0, np.int64) for k, o in enumerate(is_open)]
    return found, [[] for _ in blocks]


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    kept, at, digest = 0, 0, hashlib.sha256()
    for a, b in [*spans, (len(text), len(text))]:
        digest.update(text[at:a])
        kept += a - at
        at = b
    return len(text), len(text) - kept, len(spans), digest.hexdigest()


def dedup(docs: DataFrame, *, min_bytes: int = 200, gram: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): the bytes of each text that aren't in a repeated string of ``min_bytes``.

    A byte is removed if a string of ``min_bytes`` bytes of the text's UTF-8 that covers it also starts anywhere else in the
    corpus, overlaps and the same text included; strings never cross texts, and all is judged on the input. Spans are maximal
    runs of removed bytes.

    Null and empty texts have no bytes; very long texts are looked at in parts and finished in one task's memory. Repeated rows
    are copies of each other, whatever their ids, and all lose what is repeated (no copy is preferred, so ties don't occur);
    texts shorter than ``min_bytes`` lose nothing. An empty table gives an empty result. Other columns are ignored.
    """
    columns = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))
    return find_repeats(docs, Windows(min_bytes, min(gram, min_bytes), byte_values, len, block_bytes, part_of_bytes, sort_suffixes, without_spans, columns), id_col, text_col)
