"""Token ids as raw binary shards with a minimal perfect hash index, written and read by Spark tasks.

A shard holds the documents of one range of ids, in ascending order, about SHARD_BYTES at most:

    magic "SWTOK01\\n" | id width, documents, tokens, keys (4 x u64) | token ids, raw, little-endian |
    where each document ends (documents x u64) | document ids (documents x i64) | 1 where the id isn't null (documents x u8) |
    per slot of the index: fingerprint (u32), first document (u32), number of documents with the key (u32) |
    the minimal perfect hash

The ids of shards ascend (only the documents of one repeated id can be in two shards), so the manifest (one line per shard) leads
from an id to its shard, the index from there to the document's tokens: an opened shard gives any document in constant time
and reads nothing but its tokens.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mph
from .common import cut, keep
from .symbols import pieces

MAGIC = b"SWTOK01\n"
HEAD = len(MAGIC) + 32
SLOT = np.dtype([("fingerprint", "<u4"), ("first", "<u4"), ("count", "<u4")])
#: A task closes a shard and begins another when its token ids are so many bytes.
SHARD_BYTES = 128 << 20
#: Parts of texts whose ids a worker remembers.
REMEMBERED = 600_000
MANIFEST = "shard long, file string, docs long, tokens long, first_id long, last_id long"


class Encoder:
    """The ids of whole texts by a tokenizer file, as little-endian numbers of ``width`` bytes, with an end id after each text.

    A byte-level tokenizer splits texts by a pattern in which a blank before a visible character always begins a new part,
    so its ids are those of the parts between such blanks; each distinct part is encoded once. The pattern also parts letters
    from marks after them and from a single line feed, so letters go to the tokenizer's model directly; parts of other shapes
    go through the whole tokenizer.
    Texts that hold the name of an added token, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.end = np.array([end_id], self.kind).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_parts = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}  # parts after a blank, without it
        self.firsts: dict[str, bytes] = {}  # words after a line feed
        self.runs: dict[str, bytes] = {"": b""}
        self.code = {2: "H", 4: "I"}[self.width]
        self.shape = re.compile(r"(\w+)([^\w\s']*)(?:\n(\w+)([^\w\s']*))?")
        self.odd = re.compile(r" (?=\s|$)")
        self.cut = re.compile(r" (?=\S)")
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
        others = [b for b in range(256) if b not in printed]
        self.written = {b: b for b in printed} | {b: 256 + k for k, b in enumerate(others)}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, part: str) -> bytes:
        """The ids of letters, with or without a blank before them."""
        spelled = part.encode().decode("latin-1").translate(self.written)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def simple(self, part: str) -> bytes | None:
        """The ids of a part (after a blank) of letters and marks after them, once or twice with a line feed between; else None."""
        found = self.shape.fullmatch(part)
        if not found or not found[1].isalpha() or not (found[3] or "a").isalpha():
            return None
        out = self.known.get(found[1])
        if out is None:
            out = self.known[found[1]] = self.letters(f" {found[1]}")
        out += self.marks(found[2])
        if found[3]:
            first = self.firsts.get(found[3])
            if first is None:
                self.firsts = {} if len(self.firsts) > REMEMBERED // 4 else self.firsts
                first = self.firsts[found[3]] = self.letters(found[3])
            out += self.marks("\n") + first + self.marks(found[4])
        return out

    def marks(self, run: str) -> bytes:
        if run not in self.runs:
            self.runs = {"": b""} if len(self.runs) > 10_000 else self.runs
            self.runs[run] = self.raw([run])[0]
        return self.runs[run]

    def learn(self, parts: list[str]) -> None:
        """Adds the ids of parts after a blank to the known ones. If these get too many, those met last go: frequent ones are met first."""
        if len(self.known) + len(parts) > REMEMBERED:
            self.known = dict(islice(self.known.items(), REMEMBERED // 4))
            parts = [x for x in parts if x not in self.known]
        rest = []
        for x in parts:
            ids = self.simple(x)
            if ids is None:
                rest.append(x)
            else:
                self.known[x] = ids
        self.known.update(zip(rest, self.raw([f" {x}" for x in rest]), strict=True))

    def forget(self) -> None:
        """What a worker holds between tasks: the parts met first, which are frequent."""
        if len(self.known) > REMEMBERED // 2:
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [not self.by_parts or any(x in t for x in self.added) for t in texts]
        split = [[t] if w else self.cut.split(t) if self.odd.search(t) else t.split(" ") for t, w in zip(texts, whole, strict=True)]
        met = {x for s in split for x in s[1:]}
        new = [x for x in met if x not in self.known]
        if new:
            self.learn(new if len(self.known) + len(new) <= REMEMBERED else list(met))
        heads = self.raw([s[0] for s in split])
        of = self.known.__getitem__
        return [b"".join([head, *map(of, s[1:]), self.end]) for head, s in zip(heads, split, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def _write(uri: str, chunks: list) -> None:
    """A file that is whole or absent: written beside its place, then moved there. A second attempt writes the same bytes."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(own) as f:
        for chunk in chunks:
            f.write(chunk)
    where.move(own, path)


def _read(uri: str) -> pa.Buffer:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        return f.read_buffer()


def _write_shards(batches: Iterator[pa.RecordBatch], out_dir: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """(id, key, text) in order -> lines of the manifest. In memory are the ids of one shard, the texts of one piece, and the parts known."""
    enc, number = encoder(tokenizer, end_id), 0
    ids, keys, payload, lengths, held = [], [], [], [], 0

    def written() -> pa.RecordBatch:
        shard = (TaskContext.get().partitionId() << 24) + number
        return _write_shard(shard, f"{out_dir}/shard-{shard:014d}.bin", pa.concat_arrays(ids), np.concatenate(keys), payload, lengths, enc.width)

    for batch in batches:
        texts = pc.fill_null(batch.column(2), "")
        for a, b in pieces(texts, 4 << 20):
            found = enc.encode(texts.slice(a, b - a).to_pylist())
            ids.append(batch.column(0).slice(a, b - a))
            keys.append(np.asarray(batch.column(1).slice(a, b - a)).astype(np.int64))
            lengths.extend(len(x) // enc.width for x in found)
            payload.append(b"".join(found))
            held += len(payload[-1])
            if held >= SHARD_BYTES:
                yield written()
                ids, keys, payload, lengths, held, number = [], [], [], [], 0, number + 1
    if lengths:
        yield written()
    enc.forget()
    keep(encoder.cache_clear)


def _write_shard(shard: int, uri: str, ids: pa.Array, keys: np.ndarray, payload: list[bytes], lengths: list[int], width: int) -> pa.RecordBatch:
    valid = np.asarray(ids.is_valid())
    values = np.asarray(ids.fill_null(0)).astype("<i8")
    key, first, count = np.unique(keys[valid].view(np.uint64), return_index=True, return_counts=True)
    first = np.flatnonzero(valid)[first] if len(first) else first
    index = mph.build(key)
    slots = np.zeros(len(key), SLOT)
    at = mph.Mph(index).slots(key)
    slots["fingerprint"][at], slots["first"][at], slots["count"][at] = mph.fingerprint(key), first, count
    ends = np.cumsum(np.array(lengths, np.int64)).astype("<u8")
    head = MAGIC + struct.pack("<4Q", width, len(lengths), int(ends[-1]), len(key))
    _write(uri, [head, *payload, ends.tobytes(), values.tobytes(), valid.astype(np.uint8).tobytes(), slots.tobytes(), index])
    known = values[valid]
    line = [[shard], [uri.rsplit("/", 1)[1]], [len(lengths)], [int(ends[-1])], [int(known[0]) if len(known) else None], [int(known[-1]) if len(known) else None]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(line, kinds, strict=True)], ["shard", "file", "docs", "tokens", "first_id", "last_id"])


def keys_of(ids: np.ndarray) -> np.ndarray:
    """The keys of ids: ``xxhash64`` as Spark gives it."""
    from xxhash import xxh64_intdigest

    data = ids.astype("<i8").tobytes()
    return np.fromiter((xxh64_intdigest(data[k : k + 8], 42) for k in range(0, len(data), 8)), np.uint64, len(ids))


class Shard:
    """An opened shard: its index in memory, its tokens read as they are asked for."""

    def __init__(self, uri: str):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(uri)
        self.file = where.open_input_file(path)
        head = self.file.read_at(HEAD, 0)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.width, docs, tokens, keys = struct.unpack_from("<4Q", head, len(MAGIC))
        at = HEAD + self.width * tokens
        view = memoryview(self.file.read_at(self.file.size() - at, at))
        self.ends = np.frombuffer(view, "<u8", docs).astype(np.int64)
        self.ids = np.frombuffer(view, "<i8", docs, 8 * docs)
        self.valid = np.frombuffer(view, np.uint8, docs, 16 * docs).astype(bool)
        self.slots = np.frombuffer(view, SLOT, keys, 17 * docs)
        self.index = mph.Mph(view[17 * docs + SLOT.itemsize * keys :])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first document, number of documents) of each key, (-1, 0) for foreign ones."""
        first, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        slot = self.index.slots(keys) if len(self.slots) else first
        known = np.flatnonzero(slot >= 0)
        known = known[self.slots["fingerprint"][slot[known]] == mph.fingerprint(keys[known])]
        first[known], count[known] = self.slots["first"][slot[known]], self.slots["count"][slot[known]]
        return first, count

    def tokens(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.width * (end - begin), HEAD + self.width * begin), f"<u{self.width}")

    def document(self, n: int) -> np.ndarray:
        return self.tokens(int(self.ends[n - 1]) if n else 0, int(self.ends[n]))

    def documents(self, key: int) -> list[np.ndarray]:
        """The tokens of the documents with a key; none if the key is foreign."""
        first, count = (int(x[0]) for x in self.find(np.array([key], np.int64).view(np.uint64)))
        return [self.document(n) for n in range(first, first + count)]


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as shards under ``out_dir``, a URI that all executors reach; the manifest, one row per shard.

    Documents are dealt by ranges of their id (null first) and sorted inside, those with one id by text, so the shards in
    order hold all documents in order. Null and empty texts are the end id alone; a very long text is encoded whole and makes a
    shard larger than SHARD_BYTES if need be. A repeated id's documents (ties) stand one after the other and share a key. Documents with a null id are in no index. Ids must be whole numbers. An empty table gives no
    shard. Other columns are ignored. A task that is run again writes the same file.
    """
    tie = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie, "text")
    return cut(rows.mapInArrow(lambda batches: _write_shards(batches, out_dir, tokenizer, end_id), MANIFEST))


def read_tokens(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, read back from the shards; ``start`` counts the ids of all documents before it.

    Documents are found by their key through each shard's index, those with a null id by their place; every document must be
    found once.
    """
    lines = manifest.orderBy("shard").select("file", "tokens").collect()  # one for each shard
    starts = np.concatenate([[0], np.cumsum([r["tokens"] for r in lines])]).tolist()
    rows = spark.createDataFrame([(r["file"], s) for r, s in zip(lines, starts, strict=False)], "file string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = Shard(f"{out_dir}/{file}")
                ids = np.unique(shard.ids[shard.valid])
                first, count = shard.find(keys_of(ids))
                numbers = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                numbers = np.concatenate([np.flatnonzero(~shard.valid), numbers])
                owners = np.repeat(ids, count)
                if (first < 0).any() or (np.sort(numbers) != np.arange(len(shard.ids))).any() or (shard.ids[numbers[len(numbers) - len(owners) :]] != owners).any():
                    raise ValueError(f"the index of {file} doesn't lead to its documents")
                begins, ends = np.where(numbers > 0, shard.ends[numbers - 1], 0), shard.ends[numbers]
                tokens = shard.tokens(0, int(shard.ends[-1]))
                sums = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.ids[numbers], mask=~shard.valid[numbers]), pa.array(begins + start), pa.array(ends - begins), pa.array(sums, pa.int64())],
                    ["id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(max(1, len(lines))).mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


@lru_cache(maxsize=64)
def opened(uri: str) -> Shard:
    return Shard(uri)


def lookup(out_dir: str, manifest: list, doc_id: int) -> list[np.ndarray]:
    """The tokens of the documents with an id, by manifest (rows in order of their shard) and index."""
    ranges = [r for r in manifest if r["last_id"] is not None]
    at = bisect_left([r["last_id"] for r in ranges], doc_id)
    found, key = [], int(keys_of(np.array([doc_id])).view(np.int64)[0])
    while at < len(ranges) and ranges[at]["first_id"] <= doc_id:
        found += opened(f"{out_dir}/{ranges[at]['file']}").documents(key)
        at += 1
    return found
