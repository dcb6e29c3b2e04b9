"""Outputs and assets in a few container files: ``df.write.format("packs")``, rows (name, output).

A container is a ZIP archive without compression, so that any tool can open it, and its directory is the index: one name is read with
its own bytes alone. A task writes containers of about PACK_BYTES under names that no other attempt has and tells the driver what it
wrote; the driver's commit writes the list of the winning attempts' containers, and only what is on the list counts. So a task that
was killed and repeated leaves each output once.
"""

from __future__ import annotations

import json

import uuid
import zipfile
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage

from .files import _place

COLUMNS = "name string, output binary"
PACK_BYTES = 256 << 20
LISTS = "_packs"


@dataclass
class Packed(WriterCommitMessage):
    """Containers that a task has written: (file, entries, first name, last name)."""

    packs: list[tuple[str, int, str, str]]


class PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        packs, pack, stream, names, held = [], None, None, [], 0

        def close() -> None:
            pack.close()
            stream.close()
            packs.append((file, len(names), min(names), max(names)))

        for batch in iterator:
            for name, output in zip(batch.column("name").to_pylist(), batch.column("output").to_pylist(), strict=True):
                if name is None or output is None:
                    continue
                if pack is None:
                    file = f"pack-{self.job}-{uuid.uuid4().hex}.zip"
                    stream = where.open_output_stream(f"{root}/{file}")
                    pack, names, held = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, strict_timestamps=False), [], 0
                pack.writestr(zipfile.ZipInfo(name), output)
                names.append(name)
                held += len(output)
                if held >= PACK_BYTES:
                    close()
                    pack = None
        if pack is not None:
            close()
        return Packed(packs)

    def commit(self, messages: list[Packed | None]) -> None:
        """The list of this job's containers is written beside and moved to its place; what is on no list is removed."""
        from pyarrow import fs

        where, root = _place(self.path)
        packs = sorted((p for m in messages if m for p in m.packs), key=lambda p: p[2])
        older = [] if not self.overwrite else [f.path for f in where.get_file_info(fs.FileSelector(f"{root}/{LISTS}", allow_not_found=True))]
        where.create_dir(f"{root}/{LISTS}", recursive=True)
        with where.open_output_stream(f"{root}/{self.job}.tmp") as f:
            f.write(json.dumps(packs).encode())
        where.move(f"{root}/{self.job}.tmp", f"{root}/{LISTS}/{self.job}.json")  # from here on the outputs are there, all at once
        gone = [f"{root}/{p[0]}" for old in older for p in json.loads(where.open_input_stream(old).read())]
        listed = {p[0] for p in packs}
        lost = [f.path for f in where.get_file_info(fs.FileSelector(root)) if f.base_name.startswith(f"pack-{self.job}-") and f.base_name not in listed]
        for path in [*older, *gone, *lost]:
            where.delete_file(path)

    def abort(self, messages: list[Packed | None]) -> None:
        from pyarrow import fs

        where, root = _place(self.path)
        for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"pack-{self.job}-"):
                where.delete_file(f.path)


def listed(path: str) -> list[tuple[str, int, str, str]]:
    """The containers that count, in order of their first names."""
    from pyarrow import fs

    where, root = _place(path.rstrip("/"))
    lists = where.get_file_info(fs.FileSelector(f"{root}/{LISTS}", allow_not_found=True))
    return sorted((tuple(p) for f in lists for p in json.loads(where.open_input_stream(f.path).read())), key=lambda p: p[2])


@dataclass
class PackPart(InputPartition):
    file: str


class PackReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path.rstrip("/"), None

    def partitions(self) -> list[PackPart]:
        found = [PackPart(f) for f, _, first, last in listed(self.path) if self.wanted is None or first <= self.wanted <= last]
        return found or [PackPart("")]

    def read(self, partition: PackPart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, root = _place(f"{self.path}/{partition.file}")
        with where.open_input_file(root) as f, zipfile.ZipFile(f) as pack:
            for info in pack.infolist() if self.wanted is None else [i for i in pack.infolist() if i.filename == self.wanted]:
                yield pa.RecordBatch.from_arrays([pa.array([info.filename]), pa.array([pack.read(info)], pa.binary())], ["name", "output"])


class PushingPackReader(PackReader):
    """With the option ``pushdown``: one name is read from the containers that may have it."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) is EqualTo and f.attribute == ("name",) and self.wanted is None:
                self.wanted = f.value
            else:
                yield f


class Packs(DataSource):
    """Containers of (name, output) below ``path``. Written are rows that have both; a name that is written twice is read twice.

    With the option ``pushdown`` a filter ``name = ...`` is decided by the index (see ``files.SizedFiles``).
    """

    @classmethod
    def name(cls) -> str:
        return "packs"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> PackReader:
        return (PushingPackReader if self.options.get("pushdown", "false") == "true" else PackReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], overwrite)


def write_packs(outputs: DataFrame, path: str, assets: DataFrame | None = None) -> None:
    """(name, output) of the reports, and of their assets, dealt by ranges of names, so that a container holds a range. Rows without output
    aren't written. An existing folder's outputs are replaced once the new ones are whole."""
    rows = outputs.select("name", "output")
    if assets is not None:
        rows = rows.unionByName(assets.select("name", "output"))
    rows = rows.where(F.col("name").isNotNull() & F.col("output").isNotNull())
    rows.sparkSession.dataSource.register(Packs)
    rows.repartitionByRange("name").sortWithinPartitions("name").write.format("packs").mode("overwrite").save(path)


class Opened:
    """The outputs of a folder by name: a container's directory is read when a name may be in it, and then that name's bytes alone."""

    def __init__(self, path: str):
        self.path, self.packs, self.open = path.rstrip("/"), listed(path), {}
        self.ends = [max(p[3] for p in self.packs[: k + 1]) for k in range(len(self.packs))]

    def read(self, name: str) -> list[bytes]:
        """The outputs with a name; several if it was written several times."""
        found = []
        at = bisect_right([p[2] for p in self.packs], name) - 1
        while at >= 0 and self.ends[at] >= name:
            file, _, _, last = self.packs[at]
            if last >= name:
                if file not in self.open:
                    where, root = _place(f"{self.path}/{file}")
                    self.open[file] = zipfile.ZipFile(where.open_input_file(root))
                found += [self.open[file].read(i) for i in self.open[file].infolist() if i.filename == name] if self.open[file].NameToInfo.get(name) else []
            at -= 1
        return found
