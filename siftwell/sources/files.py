"""A data source of files that knows sizes before it reads: ``spark.read.format("sized_files")``.

Folders are walked on the driver, where only names and sizes are seen; the files are packed into tasks by their bytes. A task opens
the files of its part that are within the budget and pass the filters that Spark pushed down; the others are rows without bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

COLUMNS = "position long, kind string, source string, name string, parts array<string>, length long, data binary"
#: What opening a file costs, in bytes, when files are packed into tasks; and the bytes of a task.
OPEN_COST, TASK_BYTES = 1 << 20, 64 << 20
#: A batch of rows is handed to Spark when it holds so many bytes.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Entry:
    """A file (or a link that isn't followed), where it is and how large; ``parts`` is its path below the folder that was named."""

    kind: str
    source: str
    parts: tuple[str, ...]
    length: int

    @property
    def name(self) -> str:
        return self.parts[-1]


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _extension(name: str) -> str:
    return os.path.splitext(name)[1][1:].lower()


def walk(path: str, extensions: Iterable[str]) -> list[Entry]:
    """The files below a folder (or the file itself, whatever its extension), depth first, ordered by the parts of their paths.

    On a local disk a link that leads out of the folder is a ``skipped_symlink``, and no folder is entered twice; other file systems have no
    links. What can't be listed is an ``io_error``.
    """
    from pyarrow import fs

    wanted = {e.lower() for e in extensions}
    where, root = _place(path)
    info = where.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        return [Entry("io_error", path, (path.rstrip("/").rsplit("/", 1)[-1],), 0)]
    if info.type == fs.FileType.File:
        return [Entry("file", path, (info.base_name,), info.size)]
    if isinstance(where, fs.LocalFileSystem):
        found = list(_walk_disk(root, os.path.realpath(root), (), wanted, set()))
    else:
        base = root.rstrip("/") + "/"
        before = path.rstrip("/").removesuffix(root.rstrip("/"))  # scheme and host
        files = where.get_file_info(fs.FileSelector(root, recursive=True))
        found = [Entry("file", before + f.path, tuple(f.path[len(base) :].split("/")), f.size) for f in files if f.type == fs.FileType.File and _extension(f.base_name) in wanted]
    return sorted(found, key=lambda e: e.parts)


def _walk_disk(folder: str, root: str, above: tuple[str, ...], wanted: set[str], seen: set[str]) -> Iterator[Entry]:
    own = os.path.realpath(folder)
    if own in seen:
        return
    seen.add(own)
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        yield Entry("io_error", folder, (*above, ""), 0)
        return
    for e in entries:
        target = os.path.realpath(e.path)
        if e.is_symlink() and os.path.commonpath([root, target]) != root:
            yield Entry("skipped_symlink", e.path, (*above, e.name), 0)
        elif e.is_dir():
            yield from _walk_disk(e.path, root, (*above, e.name), wanted, seen)
        elif _extension(e.name) in wanted:
            try:
                yield Entry("file", e.path, (*above, e.name), e.stat().st_size)
            except OSError:
                yield Entry("io_error", e.path, (*above, e.name), 0)


def _read(source: str, most: int) -> bytes | None:
    """A file's bytes; None where it has grown over ``most`` since it was listed."""
    where, path = _place(source)
    with where.open_input_stream(path) as f:
        data = f.read(most + 1)
    return data if len(data) <= most else None


@dataclass
class FilePart(InputPartition):
    entries: list[tuple[int, Entry]]


#: The filters that listing alone decides.
_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
}


class SizedFilesReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.extensions = [e.strip() for e in options.get("extensions", "html,htm").split(",")]
        self.most = int(options.get("maxBytes", 10 << 20))
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.kept: list[tuple[str, type, object]] = []

    def passes(self, position: int, entry: Entry) -> bool:
        of = lambda name: position if name == "position" else getattr(entry, name)
        return all(_TESTS[kind](of(name), value) for name, kind, value in self.kept)

    def partitions(self) -> list[FilePart]:
        entries = enumerate(e for path in self.paths for e in walk(path, self.extensions))
        parts, own, held = [], [], 0
        for position, e in entries:
            if self.passes(position, e):
                own.append((position, e))
                held += OPEN_COST + (e.length if e.length <= self.most else 0)
                if held >= self.task_bytes:
                    parts.append(FilePart(own))
                    own, held = [], 0
        return [*parts, FilePart(own)] if own or not parts else parts

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for position, e in partition.entries:
            kind, data = e.kind, None
            if e.kind == "file" and e.length <= self.most:
                try:
                    data = _read(e.source, self.most)
                except OSError:
                    kind = "io_error"
            rows.append((position, kind, e.source, e.name, list(e.parts), e.length, data))
            held += len(data or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


class PushingFilesReader(SizedFilesReader):
    """With the option ``pushdown``: filters that listing alone decides are taken from Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("kind", "source", "name", "length", "position"):
                self.kept.append((f.attribute[0], type(f), f.value))
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in COLUMNS.split(", ")])


class SizedFiles(DataSource):
    """Files as rows (COLUMNS), in order of ``position``: those of ``path`` (or of the JSON list ``paths``), each
    folder walked in order of its paths.

    Options: ``extensions`` (html,htm) for the files of folders; ``maxBytes``: larger files have their length and no bytes, and are never opened;
    ``taskBytes``: what a task reads. ``kind`` is file, skipped_symlink or io_error. With ``pushdown`` (and
    ``spark.sql.python.filterPushdown.enabled``, which Spark then asks for) filters on kind, source, name, length and position that compare with
    a constant are decided before any file is opened; in Spark 4.1 such a filter stays with the loaded table, so load it anew for each.
    """

    @classmethod
    def name(cls) -> str:
        return "sized_files"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> SizedFilesReader:
        return (PushingFilesReader if self.options.get("pushdown", "false") == "true" else SizedFilesReader)(self.options)
