"""Byte-level BPE, spelling variants and the prefix trie against plain versions, with nulls, empty and long texts, ties, repeated rows,
clashing column names and empty tables; and beyond the bounds at which they change their ways."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import pytest

DOCS = "doc_id long, text string, ids string, word string, n string"
TURNS = "conv_id long, turn int, role string, text string, pos string, class string, n string"


def bag(found, *names):
    return Counter(tuple(r[n] for n in names) for r in found.collect())


@pytest.fixture(scope="module")
def public():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, public):
    from siftwell.llm.bpe import decode_bpe, encode_bpe

    path, pattern, library = public
    rng = random.Random(3)
    letters = "aAbéß'sdmtlrve 1２½ \n\t\r\x0b\x0c\x1c\x00\x85\xa0 　.,!?<|>😀‍́‍中文"
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "a" * 30_000, "ab" * 20_000, " " * 20_000 + "x", "it's we'll\n\n don't  x ", "zqxj" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(2000)] + ["same words here"] * 3
    rows = [(n if n % 50 else None, t, "ids", "w", "n") for n, t in enumerate(texts)] + [(3, "\n\n", "", "", "")] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    expected = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)
    tokens = encode_bpe(docs, path, pattern)
    assert Counter((r["id"], tuple(r["ids"]), bytes(r["decoded"])) for r in decode_bpe(tokens, path, pattern).collect()) == expected
    assert encode_bpe(docs.where("false"), path, pattern).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [104, 72])], "id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in decode_bpe(odd, path, pattern).orderBy("id").collect()] == [b"", b"", library.decode_bytes([104, 72])]
    with pytest.raises(Exception, match="no entry has the id"):
        decode_bpe(spark.createDataFrame([(1, [50_256])], "id long, ids array<int>"), path, pattern).collect()


def test_bpe_merges_and_forgets(public, monkeypatch):
    from siftwell.llm import bpe

    path, pattern, library = public
    own = bpe.Bpe(path, pattern)
    entries = list(own.ranks)
    assert sorted(own.index.slots(bpe.word_hashes(entries)).tolist()) == list(range(len(entries)))
    assert own.resolve([" the", "zqxj"]) == [array("i", [own.ranks[b" the"]]).tobytes(), array("i", own.merge(b"zqxj")).tobytes()]
    assert all(own.decode(own.merge(entry)) == entry for entry in entries[::50])
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    texts = [" ".join(random.Random(k).choices(["alpha", "be", "gamma", "qqzx", "the"] + [f"w{k}x" for k in range(40)], k=30)) for k in range(40)]
    for _ in range(2):
        for k in range(0, 40, 7):
            assert [len(x) // 4 for x in own.encode(texts[k : k + 7])] == [len(library.encode_ordinary(t)) for t in texts[k : k + 7]]
        assert all(len(x) <= 4 for x in own.known)


def test_bpe_at_once(monkeypatch):
    """Short pre-tokens merge in a list as they do with the heap, and many texts' ids are decoded together, not one by one."""
    import time

    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from siftwell.llm import bpe

    own = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(11)
    parts = ["".join(rng.choice("aeinrst zé漢0") for _ in range(rng.randrange(1, 40))).encode() for _ in range(3000)] + [b"a" * n for n in range(1, 60)]
    found = [own.merge(x) for x in parts]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert found == [own.merge(x) for x in parts]
    assert own.decode_lists(pa.array([found[0], None, [], found[1]], pa.list_(pa.int32())).slice(1)).to_pylist() == [b"", b"", parts[1]]
    for wrong in ([1 << 30], [-1], [None]):
        with pytest.raises(ValueError, match="no entry has the id"):
            own.decode_lists(pa.array([wrong], pa.list_(pa.int32())))
    lists = pa.array([np.arange(50_000) % 50_000] * 40, pa.list_(pa.int32()))
    entries = dict(zip(own.ids.tolist(), own.entries.to_pylist(), strict=True))
    began = time.process_time()
    plain = [b"".join(map(entries.__getitem__, x)) for x in lists.to_pylist()]
    middle = time.process_time()
    assert own.decode_lists(lists).to_pylist() == plain and time.process_time() - middle < (middle - began) / 2



def words_by_hand(rows, respell):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = respell(i, run.translate({c: c + 32 for c in range(65, 91)}))
            if len(word) >= 6:
                counts[word] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_by_hand(counts, ratio):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, x) for x, m in counts.items() if distance_one(w, x))
        is_form = near and n > 0 and -near[0][0] >= ratio * n
        out[w] = [n, len(near), near[0][1] if is_form else None, -near[0][0] if is_form else None]
    for w in out:
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        out[w].append(root)
    return Counter((w, *x) for w, x in out.items())


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


@pytest.mark.parametrize("group", [64, 1])
def test_spelling_variants(spark, monkeypatch, group):
    from siftwell.llm import common, spelling
    from siftwell.llm.queries import without_a_letter

    monkeypatch.setattr(spelling, "GROUP", group)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 200_000 if group > 1 else 0)
    rng = random.Random(9)
    base = ["Éternité", "mountain", "mountains", "aabbaabb", "aabbaab", "aabaabb", "gardener", "ñandúes", "straße", "×÷×÷×÷", "letters", "lettersz"]
    texts = [None, "", "12 34", "a" * 3000, "short words only here"]
    for word in base:
        for variant, n in [(word, 700)] + [(word[:k] + rng.choice("abzé") + word[k + rng.randrange(2) :], rng.choice([5, 6, 40, 140])) for k in range(0, len(word), 2)]:
            texts += [" ".join([variant] * 10)] * (n // 10) + [variant.upper() if variant.isascii() else variant] * (n % 10)
    texts += [" ".join("".join(p) for p in itertools.permutations("abcdef"))] * 5  # 720 anagrams
    texts += [" ".join(x + "aaaaaaaa" for x in "abcdefghijklmnopqrstuvwxyzéàü")] * 6  # one place, all letters
    rows = [(n if n % 40 else None, t, "i", "w", "n") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)

    def respell(i, run):
        h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run

    counts = words_by_hand([r[:2] for r in rows], respell)
    found = spelling.count_words(docs, respell=without_a_letter)
    assert bag(found, "word", "n") == Counter(counts.items())
    assert bag(spelling.group_variants(found), *COLUMNS) == variants_by_hand(counts, 5)
    plain = words_by_hand([r[:2] for r in rows], lambda i, run: run)
    assert bag(spelling.count_words(docs), "word", "n") == Counter(plain.items())
    assert spelling.group_variants(spelling.count_words(docs.where("false"))).collect() == []


def test_spelling_odd_counts(spark):
    from siftwell.llm.spelling import group_variants, near_words

    long = "xy" * 5000
    rows = [("a", 1), ("b", 2), ("ab", 4), (None, 9), ("ab", 4), ("𝒳b", None), ("𝒳𝒳b", 3), (long, 100), (long + "z", 2), (long[:-1], 7), ("中文", 1), ("中字", 50), ("", 5)]
    words = spark.createDataFrame([(*r, "x") for r in rows], "word string, n long, root string")
    counts = Counter()
    for w, n in rows:
        counts[w] += n or 0
    del counts[None]
    assert bag(group_variants(words, ratio=2), *COLUMNS) == variants_by_hand(counts, 2)
    assert bag(near_words(words), "word", "near") == Counter((a, b) for a in counts for b in counts if distance_one(a, b))
    with pytest.raises(ValueError, match="more frequent"):
        group_variants(words, ratio=1)


def turns_by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}


def trie_by_hand(turns):
    members, ends = defaultdict(set), defaultdict(list)
    for c, x in turns.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].add(c)
        ends[tuple(x)].append(c)
    out, children, leaves, saved = [], Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    for p, m in members.items():
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(-3, 260):
        said = [(rng.choice(["user", "assistant", None]), rng.choice(["hi", "Éa", "", None, "tell me more", "x" * 50])) for _ in range(rng.randrange(1, 7))]
        rows += [(c, n if n else rng.choice([None, 0]), r, t) for n, (r, t) in enumerate(said)]
    common = [("user", "the same"), ("assistant", "yes, the same"), ("user", "and on")]
    for c in range(1000, 1120):  # a third of all
        rows += [(c, n, r, t) for n, (r, t) in enumerate(common[: rng.randrange(4)] if c % 3 == 0 else common)] or [(c, 0, "user", "x")]
    long = [("user", f"turn {k % 7}") for k in range(300)]
    rows += [(2000, n, r, t) for n, (r, t) in enumerate(long)] + [(2001, n, r, t) for n, (r, t) in enumerate(long)] + [(2002, n, r, t) for n, (r, t) in enumerate(long[:299] + [("user", "other")])]
    rows += [(3000, 1, "user", "tie"), (3000, 1, "assistant", "tie"), (3000, 1, "user", "tie"), (3000, None, None, None), (None, 0, "user", "lost"), (1 << 60, 0, "user", "hi"), (-(1 << 60), 0, "user", "z" * 100_000)]
    return [(*r, "pos", "class", "n") for r in rows]


@pytest.mark.parametrize("local", [2000, 40, 0])
def test_prefix_trie(spark, monkeypatch, local):
    from siftwell.llm import common, trie
    from siftwell.llm.queries import rebuilt

    monkeypatch.setattr(trie, "LOCAL", local)
    if local < 2000:
        for module, name, value in ((common, "HOT_ROWS", 50), (trie, "BLOCK", 3), (trie, "CHUNK", 16), (trie, "TURNS_AT_ONCE", 100)):
            monkeypatch.setattr(module, name, value)
    rows = conversations() if local else [r for r in conversations() if r[0] is None or not 2000 <= r[0] < 2003]
    table = spark.createDataFrame(rows, TURNS).repartition(3)
    by_hand = turns_by_hand(rows)
    numbered = trie.number_turns(table)
    assert bag(trie.prefix_trie(numbered), *TRIE) == trie_by_hand(by_hand)
    if local == 40:
        return

    def mod(a, b):
        return a - b * int(a / b) if abs(a) < 1 << 52 else (abs(a) % b) * (1 if a > 0 else -1)

    again = {}
    for c, own in by_hand.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = by_hand.get(c - mod(c, 100), [])[:h] + own[h:]
    assert bag(trie.prefix_trie(*rebuilt(numbered)), *TRIE) == trie_by_hand(again)


def test_prefix_trie_small_tables(spark):
    from siftwell.llm import trie

    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.number_turns(empty)).collect() == []
    ids = spark.createDataFrame([(5,), (7,), (5,), (None,)], "conv_id long")
    assert bag(trie.prefix_trie(trie.number_turns(empty), ids), *TRIE) == trie_by_hand({5: [], 7: []})
    one = spark.createDataFrame([(9, 0, "user", "a", "", "", ""), (9, 1, "assistant", "b", "", "", "")], TURNS)
    assert bag(trie.prefix_trie(trie.number_turns(one)), *TRIE) == trie_by_hand({9: [("user", "a"), ("assistant", "b")]})
