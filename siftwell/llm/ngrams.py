"""Language-model scoring with an Elias-Fano trigram trie that is built by Spark tasks and mapped into memory by them.

Level one holds the words (as 64-bit hashes, whose rank is a word's id) and their counts. Level two holds for every word its
successors, by id; level three holds for every pair its successors, each numbered by its place among the successors of the
pair's second word (its context-relative id). A level is a number of files, each for a range of contexts: monotone pointers
say where each context's successors begin, the successors themselves are one monotone sequence (each context goes on where
the one before ended), searched between the pointers of the context. Stored are discounted shares, quantised to 16 bits, and
for pairs the weight of the shorter context; all orders are interpolated by absolute discounting.

Counts are combined in every task before they are shuffled, as packed arrays. Files are written to a folder that all executors
share; where it is a mounted file system tasks map them in place, otherwise they read them. Either way a worker has a bounded size
of them at a time, since mapped pages count as a process's memory too.
Nothing of the model goes through the driver but a line for each file.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let_go, new_folder, small_batches
from .elias_fano import EliasFano
from .symbols import Words, pieces, spelled, word_hashes
from .tokens import _read, _write

#: The end of a text is a token of its own; it also is the context of a text's first word.
END = np.uint64(0x5A17E11D0E17D0C5)
#: Absolute discounts of the three levels.
DISCOUNT = (0.5, 0.75, 0.75)
#: Tokens whose pairs are in one file of levels two and three, about.
FILE_TOKENS = 4_000_000
#: Counts that a task holds before it combines them and hands them on.
AT_ONCE = 1_500_000
#: The smallest logarithm that quantised shares can have, in 65,535 steps.
LOWEST = -16.0
#: Bytes of text that are looked up at once: a file is visited once for all of them.
TEXT_AT_ONCE = 8 << 20
#: Bytes of model files that a worker maps or holds at a time.
HELD_BYTES = 128 << 20
PACKED = "part bigint, counts binary"


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a line of names, types, sizes and places, then the arrays at multiples of 8 bytes."""
    lines, at = {}, 0
    for name, x in arrays.items():
        lines[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(lines).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays.values())


def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int(np.flatnonzero(data[: 1 << 14] == 10)[0]) + 1
    lines = json.loads(data[:size].tobytes())
    return {k: data[size + at : size + at + n * np.dtype(t).itemsize].view(t) for k, (t, n, at) in lines.items()}


class Held:
    """Files' arrays by URI: mapped if their folder is mounted, else in memory. Those used last stay, up to HELD_BYTES of whole files."""

    def __init__(self):
        self.files: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()
        self.bytes = 0

    def __getitem__(self, uri: str) -> dict[str, np.ndarray]:
        if uri in self.files:
            self.files.move_to_end(uri)
        else:
            mapped = uri.startswith("file:")
            data = np.memmap(uri.removeprefix("file://").removeprefix("file:"), np.uint8, "r").view(np.ndarray) if mapped else np.frombuffer(_read(uri), np.uint8)
            self.files[uri] = unpack(data), len(data)
            self.bytes += len(data)
            while len(self.files) > 1 and self.bytes > HELD_BYTES:
                self.bytes -= self.files.popitem(last=False)[1][1]
            keep(self.clear)
        return self.files[uri][0]

    def clear(self) -> None:
        self.files.clear()
        self.bytes = 0


_held = Held()


def nested(arrays: dict[str, np.ndarray], prefix: str) -> EliasFano:
    return EliasFano({k.removeprefix(prefix): v for k, v in arrays.items() if k.startswith(prefix)})


def _by_file(files: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Which queries belong to which file."""
    order = np.argsort(files, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(files[order])) + 1):
        if len(part) and files[part[0]] >= 0:
            yield int(files[part[0]]), part


# --- counts on their way: sorted keys and their counts, packed


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts in few bytes: differences, written byte plane by byte plane, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (steps, counts)]
    data = b"".join(planes)
    return len(keys).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    plain = np.frombuffer(pa.decompress(data[8:], decompressed_size=16 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, n)
    steps, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in plain)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def combined(parts: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (part, key) added up, in order."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(parts[order], kind="stable")]
    parts, keys = parts[order], keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))[: len(keys)])
    return parts[first], keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def hand_on(counted: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(part, key, count) arrays -> PACKED: what a task has counted, combined over up to AT_ONCE entries."""
    waiting, n = [], 0

    def packed() -> pa.RecordBatch:
        entries = [np.concatenate([x[k] for x in waiting]) for k in range(3)]
        waiting.clear()
        part, key, count = combined(*entries)
        del entries
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        blobs = [pack_counts(key[a:b], count[a:b]) for a, b in zip(edges, [*edges[1:], len(part)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[edges]), pa.array(blobs, pa.binary())], ["part", "counts"])

    for entry in counted:
        waiting.append(entry)
        n += len(entry[0])
        if n >= AT_ONCE:
            yield packed()
            n = 0
    if waiting:
        yield packed()


def merged_parts(batches: Iterator[pa.RecordBatch], made: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED in order of part -> what is made of each part's keys and counts. In memory are one part's distinct keys and AT_ONCE more:
    ``made`` is called here, so that nothing of a part stands beside the next one."""
    part, waiting, n, limit = None, [], 0, AT_ONCE

    def whole() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([x[k] for x in waiting]) for k in (0, 1))
        waiting.clear()
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        del order
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    for batch in batches:
        for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part is not None and own != part:
                yield made(part, *whole())
                n, limit = 0, AT_ONCE
            part = own
            waiting.append(unpack_counts(blob.as_py()))
            n += len(waiting[-1][0])
            if n >= limit:
                waiting.append(whole())
                n = len(waiting[0][0])
                limit = n + AT_ONCE
    if waiting:
        yield made(part, *whole())


# --- the levels


def monotone(children: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending children of each context as one ascending sequence: every context goes on after the last child of the one before."""
    last = children[np.maximum(begins[1:] - 1, 0)]
    used = np.where(begins[1:] > begins[:-1], last.astype(np.uint64) + np.uint64(1), np.uint64(0))
    values = np.repeat(np.concatenate([[np.uint64(0)], np.cumsum(used, dtype=np.uint64)[:-1]]), np.diff(begins))
    values += children.view(np.uint64)
    return values


def encode_level(children: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    values = monotone(children, begins)
    arrays = {f"children.{k}": v for k, v in EliasFano.encode(values, int(values[-1]) + 1 if len(values) else 1).items()}
    arrays |= {f"pointers.{k}": v for k, v in EliasFano.encode(begins.astype(np.uint64), int(begins[-1]) + 1).items()}
    return arrays | {"last": values[-1:] if len(values) else np.zeros(1, np.uint64)}


def children_of(arrays: dict[str, np.ndarray], contexts: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, number) of each query: where the context's children are, and which of them all the child is, -1 if none."""
    pointers, sequence = nested(arrays, "pointers."), nested(arrays, "children.")
    own, of = np.unique(contexts, return_inverse=True)
    begin, end = pointers.get(own).astype(np.int64), pointers.get(own + 1).astype(np.int64)
    offset = np.zeros(len(own), np.uint64)
    later = begin > 0
    offset[later] = sequence.get(begin[later] - 1) + np.uint64(1)
    value = offset[of] + children.astype(np.uint64)
    begin, end = begin[of], end[of]
    found = sequence.find(np.minimum(value, arrays["last"][0]), begin, end)
    return begin, end, np.where(value <= arrays["last"][0], found, -1)


def encode(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(np.log10(p) / LOWEST * 65535), 0, 65535).astype(np.uint16)


def encode_shares(counts: np.ndarray, discount: float, totals: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Of each count, less the discount, its share of a total (``of``: which), encoded some at once."""
    codes, some = np.zeros(len(counts), np.uint16), 1 << 18
    for k in (slice(a, a + some) for a in range(0, len(counts), some)):
        codes[k] = encode((counts[k] - discount) / totals[of[k]])
    return codes


def decode(code: np.ndarray) -> np.ndarray:
    return 10 ** (code * (LOWEST / 65535))


class Vocabulary:
    """Level one. Lines of its files: (file, first key, words, tokens, last key less the first), in order."""

    def __init__(self, folder: str, lines: list[tuple]):
        self.folder, self.lines = folder, lines
        self.firsts = np.array([x[1] for x in lines], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum([x[2] for x in lines], dtype=np.int64)])
        self.befores = np.concatenate([[0], np.cumsum([x[3] for x in lines], dtype=np.int64)])
        self.words, self.tokens = int(self.starts[-1]), int(self.befores[-1])

    def _file(self, k: int) -> dict[str, np.ndarray]:
        return _held[f"{self.folder}/{self.lines[k][0]}"]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words the ids (-1 for unknown ones), how often they occur, and how many tokens words with smaller ids have (both
        0 for unknown ones). Each file is visited once."""
        ids, counts, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for k, at in _by_file(np.searchsorted(self.firsts, hashes, "right") - 1):
            arrays, own, most = self._file(k), hashes[at] - self.firsts[k], np.uint64(self.lines[k][4])
            found = nested(arrays, "keys.").find(np.minimum(own, most))
            known = (found >= 0) & (own <= most)
            at, found = at[known], found[known]
            ids[at], counts[at], before[at] = found + self.starts[k], arrays["counts"][found], arrays["before"][found] + self.befores[k]
        return ids, counts, before

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """How often words occur; 0 for id -1."""
        out = np.zeros(len(ids), np.int64)
        for k, at in _by_file(np.searchsorted(self.starts[:-1], ids, "right") - 1):
            out[at] = self._file(k)["counts"][ids[at] - self.starts[k]]
        return out

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """The discounted share of a word, plus what the discounts free, dealt evenly to all words and the unknown one."""
        free = DISCOUNT[0] * self.words / max(self.tokens, 1)
        return np.maximum(counts - DISCOUNT[0], 0) / max(self.tokens, 1) + free / (self.words + 1)


class Pairs:
    """Level two. Lines of its files: (number, first context, first word, pairs, last context, successors of the first context,
    of the last), in order."""

    def __init__(self, folder: str, lines: list[tuple]):
        self.folder, self.lines = folder, lines
        self.firsts = np.array([(x[1] << 32) | x[2] for x in lines], np.int64)
        self.names = [x[0] for x in lines]
        edge: dict[int, int] = {}
        self.ahead = []  # successors that the first context of a file has in the files before
        for _, low, _, _, high, low_types, high_types in lines:
            self.ahead.append(edge.get(low, 0))
            for context, types in {(low, low_types), (high, high_types)}:
                edge[context] = edge.get(context, 0) + types
        self.edges = np.array(sorted(edge), np.int64)
        self.edge_types = np.array([edge[c] for c in sorted(edge)], np.int64)

    def find(self, context: np.ndarray, word: np.ndarray) -> dict[str, np.ndarray]:
        """For pairs of known ids: ``file`` and ``node`` of the pair (-1 if unseen), its stored ``share``, the context's number of
        successors ``types``, and the place of the pair among these, ``relative``."""
        n = len(word)
        out = {"file": np.full(n, -1), "node": np.full(n, -1), "share": np.zeros(n), "types": np.zeros(n, np.int64), "relative": np.full(n, -1)}
        for k, at in _by_file(np.searchsorted(self.firsts, (context << 32) | word, "right") - 1):
            arrays = _held[f"{self.folder}/pairs-{self.names[k]:010d}.bin"]
            low, high = self.lines[k][1], self.lines[k][4]
            inside = np.flatnonzero(context[at] <= high)
            own = at[inside]
            begin, end, found = children_of(arrays, context[own] - low, word[own])
            out["types"][own] = end - begin
            hit = found >= 0
            own, found, begin = own[hit], found[hit], begin[hit]
            out["file"][own], out["node"][own] = k, found
            out["share"][own] = decode(arrays["codes"][found])
            out["relative"][own] = found - begin + np.where(context[own] == low, self.ahead[k], 0)
        if len(self.edges):
            e = np.minimum(np.searchsorted(self.edges, context), len(self.edges) - 1)
            out["types"] = np.where(self.edges[e] == context, self.edge_types[e], out["types"])
        return out


class Model:
    """All levels, as (vocabulary, pairs, numbers of the files of level three)."""

    def __init__(self, words: Vocabulary, pairs: Pairs, triples: frozenset[int]):
        self.words, self.pairs, self.triples = words, pairs, triples

    def successors(self, found: dict[str, np.ndarray], first: np.ndarray, second: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """The probability of the last word of two overlapping pairs (numbers in ``found``), given that of the shorter context."""
        out = shorter.copy()
        for k, at in _by_file(np.where(found["node"][first] >= 0, found["file"][first], -1)):
            if self.pairs.names[k] not in self.triples:
                continue
            arrays = _held[f"{self.pairs.folder}/triples-{self.pairs.names[k]:010d}.bin"]
            node, relative = found["node"][first[at]], found["relative"][second[at]]
            begin, end, number = children_of(arrays, node, np.maximum(relative, 0))
            number = np.where(relative >= 0, number, -1)
            share = np.where(number >= 0, decode(arrays["codes"][np.maximum(number, 0)]), 0)
            out[at] = np.where(end > begin, share + decode(arrays["back"][node]) * shorter[at], shorter[at])
        return out


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The distinct tokens' hashes in order, each token's number among these, that of END, and the tokens of each text (END included)."""
    w = Words(texts, lower=True)
    codes, dictionary = w.codes()
    own, rank = np.unique(np.append(word_hashes(spelled(dictionary)), END), return_inverse=True)
    return own, np.insert(rank[codes], w.bounds[1:], rank[-1]), int(rank[-1]), w.counts + 1


def pairs_of(at: np.ndarray, end: int) -> np.ndarray:
    """The pair of each token with the one before it (END before a text's first), as one number."""
    return (np.concatenate([[end], at[:-1]]) << 32) | at


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    for batch in batches:
        for a, b in pieces(batch.column(0), TEXT_AT_ONCE):
            yield batch.column(0).slice(a, b - a)


def _count_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    let_go()

    def counted():
        for texts in _texts(batches):
            own, at, _, _ = tokens_of(texts)
            n = np.bincount(at, minlength=len(own))
            yield ((own >> np.uint64(64 - bits)).astype(np.int64)[n > 0], own[n > 0], n[n > 0])

    return hand_on(counted())


def _write_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    def made(part: int, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        own = hashes - hashes[0]
        arrays = {f"keys.{k}": v for k, v in EliasFano.encode(own, int(own[-1]) + 1).items()}
        arrays |= {"counts": n.astype(np.uint32) if n.max() < 1 << 32 else n, "before": np.cumsum(n) - n}
        file = f"words-{part:010d}.bin"
        _write(f"{folder}/{file}", [pack(arrays)])
        line = [file, str(hashes[0]), len(n), int(n.sum()), str(own[-1])]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in line], ["file", "first", "words", "tokens", "span"])

    return merged_parts(batches, made)


def _count_pairs(batches: Iterator[pa.RecordBatch], words: Vocabulary, parts: int) -> Iterator[pa.RecordBatch]:
    def counted():
        for texts in _texts(batches):
            own, at, end, n = tokens_of(texts)
            if not len(n):
                continue
            ids, counts, before = words.find(own)  # none is unknown (but END, if there is no text); ascending, as ids follow the hashes
            pair, n = np.unique(pairs_of(at, end), return_counts=True)
            context, word = pair >> 32, pair & 0xFFFFFFFF
            # where the pair stands among all tokens, if words were independent: grows with the key, and deals pairs evenly
            place = before[context] + counts[context] * (before[word] / words.tokens)
            part = np.minimum((place * (parts / words.tokens)).astype(np.int64), parts - 1)
            yield np.maximum.accumulate(part), ((ids[context] << 32) | ids[word]).astype(np.uint64), n

    return hand_on(counted())


def _write_pairs(batches: Iterator[pa.RecordBatch], folder: str, words: Vocabulary) -> Iterator[pa.RecordBatch]:
    def made(part: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        low, high = int(context[0]), int(context[-1])
        context -= low
        types = np.bincount(context)
        arrays = encode_level(word, np.concatenate([[0], np.cumsum(types)]))
        arrays["codes"] = encode_shares(n, DISCOUNT[1], words.counts(np.arange(low, high + 1)), context)
        _write(f"{folder}/pairs-{part:010d}.bin", [pack(arrays)])
        line = [part, low, int(word[0]), len(key), high, int(types[0]), int(types[-1])]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in line], ["part", "low", "word", "pairs", "high", "low_types", "high_types"])

    return merged_parts(batches, made)


def look_up(at: np.ndarray, end: int, ids: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of each token its pair's number, the distinct pairs, and what level two knows of these (pairs with unknown words: nothing)."""
    pair, of = np.unique(pairs_of(at, end), return_inverse=True)
    context, word = ids[pair >> 32], ids[pair & 0xFFFFFFFF]
    both = np.flatnonzero((context >= 0) & (word >= 0))
    known = pairs.find(context[both], word[both])
    found = {k: np.zeros(len(pair), v.dtype) if k in ("share", "types") else np.full(len(pair), -1) for k, v in known.items()}
    for k, v in known.items():
        found[k][both] = v
    half = np.flatnonzero((context >= 0) & (word < 0))  # the number of successors counts for unknown words as well
    if len(half):
        own, back = np.unique(context[half], return_inverse=True)
        found["types"][half] = pairs.find(own, np.zeros(len(own), np.int64))["types"][back]
    return of, pair, found


def triples_of(of: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The tokens that have two tokens of their text, or END and one, before them."""
    later = np.ones(len(of), bool)
    later[begins] = False
    return np.flatnonzero(later)


def _count_triples(batches: Iterator[pa.RecordBatch], words: Vocabulary, pairs: Pairs) -> Iterator[pa.RecordBatch]:
    def counted():
        for texts in _texts(batches):
            own, at, end, n = tokens_of(texts)
            if not len(n):
                continue
            of, _, found = look_up(at, end, words.find(own)[0], pairs)
            later = triples_of(of, np.cumsum(n) - n)
            both, counts = np.unique((of[later - 1] << 32) | of[later], return_counts=True)
            first, second = both >> 32, both & 0xFFFFFFFF
            yield found["file"][first], (found["node"][first].astype(np.uint64) << np.uint64(32)) | found["relative"][second].astype(np.uint64), counts

    return hand_on(counted())


def _write_triples(batches: Iterator[pa.RecordBatch], folder: str, lines: list[tuple]) -> Iterator[pa.RecordBatch]:
    def made(part: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        node, child = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        nodes = lines[part][3]
        types, total = np.bincount(node, minlength=nodes), np.bincount(node, n, minlength=nodes)
        arrays = encode_level(child, np.concatenate([[0], np.cumsum(types)]))
        back = np.where(types > 0, DISCOUNT[2] * types / np.maximum(total, 1), 1)
        arrays |= {"codes": encode_shares(n, DISCOUNT[2], total, node), "back": encode(back)}
        _write(f"{folder}/triples-{lines[part][0]:010d}.bin", [pack(arrays)])
        return pa.RecordBatch.from_arrays([pa.array([lines[part][0]])], ["part"])

    return merged_parts(batches, made)


def train(texts: DataFrame, text_col: str, folder: str) -> Model:
    """The model of all texts of a table, its files under ``folder``. Three scans, one for each level."""
    spark = texts.sparkSession
    rows = texts.select(F.col(text_col).cast("string").alias("text"))
    bits = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())

    def built(count, write, schema: str) -> list[tuple]:
        dealt = rows.mapInArrow(count, PACKED).repartition("part").sortWithinPartitions("part")
        return [tuple(r) for r in dealt.mapInArrow(write, schema).collect()]  # one line for each file

    lines = built(lambda b: _count_words(b, bits), lambda b: _write_words(b, folder), "file string, first string, words bigint, tokens bigint, span string")
    words = Vocabulary(folder, sorted(((f, int(first), w, t, int(span)) for f, first, w, t, span in lines), key=lambda x: x[1]))
    if not words.tokens:
        return Model(words, Pairs(folder, []), frozenset())
    parts = max(1, -(-words.tokens // FILE_TOKENS))
    lines = built(lambda b: _count_pairs(b, words, parts), lambda b: _write_pairs(b, folder, words), "part bigint, low bigint, word bigint, pairs bigint, high bigint, low_types bigint, high_types bigint")
    pairs = Pairs(folder, sorted(lines, key=lambda x: x[:3]))
    lines = built(lambda b: _count_triples(b, words, pairs), lambda b: _write_triples(b, folder, pairs.lines), "part bigint")
    return Model(words, pairs, frozenset(x[0] for x in lines))


def score_texts(texts: pa.Array, model: Model) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known tokens, add-one unigram score, model score (log10 probabilities)."""
    words = model.words
    own, at, end, n = tokens_of(texts)
    ids, counts, _ = words.find(own)
    base = np.log10((counts + 1) / (words.tokens + words.words + 1))[at]
    begins = np.cumsum(n) - n
    if words.tokens:
        of, pair, found = look_up(at, end, ids, model.pairs)
        context, word = pair >> 32, pair & 0xFFFFFFFF
        one = words.probability(counts)[word]
        total = counts[context]
        two = np.where(total > 0, found["share"] + DISCOUNT[1] * found["types"] / np.maximum(total, 1) * one, one)
        later = triples_of(of, begins)
        both, back = np.unique((of[later - 1] << 32) | of[later], return_inverse=True)
        first, second = both >> 32, both & 0xFFFFFFFF
        p = two[of]
        p[later] = model.successors(found, first, second, two[second])[back]
        score = np.log10(p)
    else:
        score = np.zeros(len(at))
    return n, np.add.reduceat((counts > 0)[at], begins, dtype=np.int64), np.add.reduceat(base, begins), np.add.reduceat(score, begins)


def held_out(id_value: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is in the fold that isn't learned from, by its id as text; a null id's text is empty."""
    return F.pmod(F.crc32(F.coalesce(id_value.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; the model is learned from those not held out.

    A-Z are lower-cased, words are split at ASCII white space, and each text ends with an end token. ``base_score`` is that of
    add-one unigrams. ``score`` interpolates trigrams, pairs and words by absolute discounting; words not learned share one
    unknown word's probability.

    Null and empty texts are their end token alone; a very long text is scored at once, in one task's memory. Repeated rows are
    learned from each time (ties don't occur). Documents with a null id count as learned from. Without any document to learn
    from both scores are 0 (nothing is known, and there is one possible token). An empty table gives an empty result. Other
    columns are ignored. Words are told apart by 64-bit hashes. The model's files stay in the shared folder (``clean_up``). Sets the
    session's bound of batches for Python (``small_batches``).
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = held_out(docs[id_col]) if held is None else held
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    model = train(docs.where(~held), text_col, new_folder(spark, "ngrams"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2), TEXT_AT_ONCE):
                own = batch.slice(a, b - a)
                n, known, base, found = score_texts(own.column(2), model)
                total = pa.array(np.full(b - a, model.words.tokens, np.int64))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n.astype(np.int64)), pa.array(known), total, pa.array(base), pa.array(found)],
                                                 ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scored, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
