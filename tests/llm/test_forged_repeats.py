"""Texts built so that they share the public polynomial hashes, in few and in many surroundings; and rows that are repeated thousands of times."""

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

GROUPS, EACH, HEAD = 8, 8, 64


def merged(a, b, mask):
    """(sums, index of a, index of b) of pairs whose sums are 0 under the mask."""
    order = np.argsort(b & mask)
    keys = (b & mask)[order]
    wanted = (np.uint64(0) - a) & mask
    low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    left = np.repeat(np.arange(len(a)), high - low)[: 1 << 19]
    right = order[(np.arange(len(left)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)[: len(left)]) + np.repeat(low, high - low)[: len(left)]]
    return a[left] + b[right], left, right


def forged(seed=1):
    """Two different heads of 64 letters with one polynomial hash modulo 2**64, by a generalised birthday search (Wagner)."""
    from siftwell.llm.symbols import BASE, BYTE_VALUES

    rng = np.random.default_rng(seed)
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(HEAD)], np.uint64)
    base = rng.integers(97, 123, HEAD)
    options = rng.integers(97, 123, (GROUPS, 1 << 17, EACH))
    sums = [(BYTE_VALUES[options[g]] * powers[g * EACH : (g + 1) * EACH]).sum(axis=1, dtype=np.uint64) for g in range(GROUPS)]
    sums[-1] = sums[-1] - (BYTE_VALUES[base] * powers).sum(dtype=np.uint64)
    first = [merged(sums[k], sums[k + 1], np.uint64(0xFFFF)) for k in range(0, GROUPS, 2)]
    second = [merged(first[k][0], first[k + 1][0], np.uint64(0xFFFFFFFF)) for k in (0, 2)]
    _, left, right = merged(second[0][0], second[1][0], np.uint64(0xFFFFFFFFFFFFFFFF))
    picks = []
    for k, at in ((0, left[0]), (2, right[0])):
        _, a, b = second[k // 2]
        for j, one in ((k, a[at]), (k + 1, b[at])):
            _, x, y = first[j]
            picks += [x[one], y[one]]
    other = np.concatenate([options[g][n] for g, n in enumerate(picks)])
    return bytes(base.astype(np.uint8)).decode(), bytes(other.astype(np.uint8)).decode()


def without_repeats(rows, split, join, size):
    """(id, symbols, removed, hash of what is kept) of each row, by hand."""
    texts = [split(t) for _, t in rows]
    places = Counter(tuple(w[k : k + size]) for w in texts for k in range(len(w) - size + 1))
    out = Counter()
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {j for k in range(len(w) - size + 1) if places[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out[i, len(w), len(gone), hashlib.sha256(join([x for k, x in enumerate(w) if k not in gone])).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def heads():
    from siftwell.llm.symbols import BYTE_VALUES, Rolling

    one, other = forged()
    hashes = {Rolling(BYTE_VALUES[np.frombuffer(h.encode(), np.uint8)]).of(np.array([0]), np.array([HEAD]))[0] for h in (one, other)}
    assert one != other and len(hashes) == 1
    return one, other


@pytest.mark.parametrize("group", [500, 3])
def test_forged_bytes(spark, heads, monkeypatch, group):
    """Different strings with one hash stay, alone and among more surroundings than one task compares."""
    from siftwell.llm import repeats
    from siftwell.llm.suffixes import dedup

    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for k in range(6):  # the anchor must lie in the tail
        tail = letters(200 - HEAD)
        rows += [(10 * k, heads[0] + tail), (10 * k + 1, heads[1] + tail)]
    rows += [(100 + k, letters(90) + heads[k % 2] + rows[0][1][HEAD:] + letters(90)) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = Counter((r["id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in dedup(docs).collect())
    assert found == without_repeats(rows, lambda t: list(t.encode()), bytes, 200)


def test_forged_words(spark, heads):
    """Words whose spellings collide bytewise in the polynomial are words of their own."""
    from siftwell.llm.lempel_ziv import factors, parse

    tail = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{heads[0]} {tail}"), (2, f"{heads[1]} {tail}"), (3, f"x {heads[0]} {tail} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in parse(docs).collect())
    assert found == without_repeats(rows, str.split, lambda w: " ".join(w).encode(), 35)
    assert {(r["id"], r["ref_id"]) for r in factors(docs).collect()} == {(1, 3), (3, 1)}


def test_repeated_rows_are_linear(spark):
    from pyspark.sql import functions as F

    from siftwell.llm.lempel_ziv import parse
    from siftwell.llm.simhash import drop_near_duplicates
    from siftwell.llm.suffixes import dedup

    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(2)]
    part = " ".join(texts[0].split()[100:160])
    once = spark.createDataFrame([(3, "before " + part + " after"), (4, "of its own"), (5, None), (5, None)], "doc_id long, text string")
    docs = spark.range(10_000).select((F.col("id") % 2).alias("doc_id"), F.when(F.col("id") % 2 == 0, texts[0]).otherwise(texts[1]).alias("text")).unionByName(once)
    empty = hashlib.sha256(b"").hexdigest()
    began = time.time()
    found = Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in parse(docs).collect())
    assert found == Counter({(0, 300, 300, empty): 5000, (1, 300, 300, empty): 5000, (3, 62, 60, hashlib.sha256(b"before after").hexdigest()): 1, (4, 3, 0, hashlib.sha256(b"of its own").hexdigest()): 1, (5, 0, 0, empty): 2})
    cut = {r["id"]: (r["n_removed"], r["n_spans"]) for r in dedup(docs).distinct().collect()}
    assert cut == {0: (len(texts[0]), 1), 1: (len(texts[1]), 1), 3: (len(part) + 2, 1), 4: (0, 0), 5: (0, 0)}
    assert sorted(r["doc_id"] for r in drop_near_duplicates(docs).select("doc_id").collect()) == [0, 1, 3, 4, 5]
    assert time.time() - began < 120


def test_near_copies_split_into_few_rows(spark, monkeypatch):
    """Halves of near copies' blocks that are equal as a whole go on as one row, and all lose what they share."""
    from siftwell.llm import repeats
    from siftwell.llm.suffixes import dedup

    made, split = spark.sparkContext.accumulator(0), repeats._split

    def counted(batches, w, seed):
        for batch in split(batches, w, seed):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(repeats, "GROUP", 5)
    monkeypatch.setattr(repeats, "_split", counted)
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghij") for _ in range(500))
    rows = [(k, text[: (at := 170 + 2 * k)] + "#" + text[at + 1 :]) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = Counter((r["id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in dedup(docs).collect())
    assert found == without_repeats(rows, lambda t: list(t.encode()), bytes, 200)
    assert made.value < 2500
