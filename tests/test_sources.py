"""The data source that reads sizes before bytes, and the sink of containers with its commit protocol."""

import json
import os
import zipfile

import pytest

from siftwell.plans import pipeline
from siftwell.plans.fetch import process_all
from siftwell.policy import Policy
from siftwell.sources import files, inputs, packs


@pytest.fixture
def tree(tmp_path):
    outside = tmp_path / "outside.html"
    outside.write_bytes(b"secret")
    root = tmp_path / "in"
    for name, size in {"b.html": 10, "a/z.HTM": 20, "a/c/d.html": 3000, "a.html": 0, "x.txt": 5, "a-b/e.html": 30, "é.html": 7}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"<" * size)
    (root / "link.html").symlink_to(outside)
    (root / "loop").symlink_to(root / "a")
    return root


def test_walk_in_order_of_parts(tree):
    found = files.walk(str(tree), ("html", "htm"))
    assert [("/".join(e.parts), e.kind, e.length) for e in found] == [
        ("a/c/d.html", "file", 3000), ("a/z.HTM", "file", 20), ("a-b/e.html", "file", 30), ("a.html", "file", 0), ("b.html", "file", 10), ("link.html", "skipped_symlink", 0), ("é.html", "file", 7)]
    assert [e.kind for e in files.walk(str(tree / "none"), ("html",))] == ["io_error"] and [e.source for e in files.walk(f"file://{tree}/x.txt", ("html",))] == [f"file://{tree}/x.txt"]


def test_only_files_within_the_budget_are_opened(tree, monkeypatch):
    opened = []
    own = files._read
    monkeypatch.setattr(files, "_read", lambda source, most: opened.append(os.path.basename(source)) or own(source, most))
    reader = files.SizedFilesReader({"path": str(tree), "maxBytes": "100", "taskBytes": str(2 * files.OPEN_COST)})
    parts = reader.partitions()
    assert len(parts) > 2 and opened == []
    rows = {r["name"]: r["data"] for p in parts for b in reader.read(p) for r in b.to_pylist()}
    assert sorted(opened) == ["a.html", "b.html", "e.html", "z.HTM", "é.html"] and rows["d.html"] is None and rows["link.html"] is None and rows["z.HTM"] == b"<" * 20
    opened.clear()
    reader = files.PushingFilesReader({"path": str(tree)})
    left = list(reader.pushFilters([files.LessThanOrEqual(("length",), 20), files.StringEndsWith(("name",), "html"), files.GreaterThan(("data",), b"x")]))
    assert len(left) == 1 and [r["name"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["a.html", "b.html", "link.html", "é.html"]
    assert sorted(opened) == ["a.html", "b.html", "é.html"]
    (tree / "b.html").write_bytes(b"<" * 500)  # grown since it was listed
    reader = files.SizedFilesReader({"path": str(tree), "maxBytes": "100"})
    parts = reader.partitions()
    (tree / "é.html").write_bytes(b"<" * 500)
    (tree / "a.html").unlink()
    rows = {r["name"]: (r["kind"], r["data"]) for p in parts for b in reader.read(p) for r in b.to_pylist()}
    assert rows["é.html"] == ("file", None) and rows["a.html"] == ("io_error", None)


def test_sized_files_by_spark(spark, tree):
    from test_plans import lists

    rows = inputs.read_sized(spark, [str(tree), str(tree / "x.txt"), str(tree / "none.html")], 100)
    found = {(r.position, r.name): (r.kind, r.length, r.data) for r in rows.collect()}
    assert [n for _, n in sorted(found)] == ["d.html", "z.HTM", "e.html", "a.html", "b.html", "link.html", "é.html", "x.txt", "none.html"] and found[0, "d.html"] == ("file", 3000, None) and found[1, "z.HTM"][2] == b"<" * 20
    for pushed in (True, False):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", str(pushed).lower())
        small = inputs.read_sized(spark, [str(tree)], 100, pushdown=pushed).where("length BETWEEN 6 AND 20 AND kind = 'file'")
        assert {r.name for r in small.collect()} == {"z.HTM", "b.html", "é.html"}
    reports = process_all(inputs.sized_inputs(rows), Policy(), *lists(spark)).orderBy("id").collect()
    assert [r.status for r in reports] == ["budget_exceeded", "clean", "clean", "clean", "clean", "skipped_symlink", "clean", "clean", "io_error"]
    listed = {r.name: r.data for r in inputs.read_files(spark, [str(tree)], 15).collect()}
    assert listed["b.html"] == b"<" * 10 and listed["é.html"] == b"<" * 7 and set(listed) == {"b.html", "é.html", "link.html", "x.txt"}


def test_packs_round_trip(spark, tmp_path):
    spark.dataSource.register(packs.Packs)
    path = str(tmp_path / "out")
    rows = [(f"{n}-page.html", f"page {n}".encode() * n) for n in range(200)] + [("7-gone.html", None), (None, b"x")]
    assets = [("3-page.html.assets/asset-0.css", b"p{}"), ("3-page.html.assets/asset-1.png", bytes(range(256)))]
    packs.write_packs(spark.createDataFrame(rows, "name string, output binary").repartition(5), path, spark.createDataFrame(assets, "name string, output binary"))
    expected = dict([r for r in rows if None not in r] + assets)
    again = spark.read.format("packs").load(path)
    assert {r.name: bytes(r.output) for r in again.collect()} == expected and again.count() == len(expected)
    for pushed in ("true", "false"):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
        load = lambda: spark.read.format("packs").option("pushdown", pushed).load(path)
        assert [bytes(r.output) for r in load().where("name = '42-page.html'").collect()] == [expected["42-page.html"]] and load().where("name = 'x'").collect() == []
    opened = packs.Opened(path)
    assert all(opened.read(n) == [x] for n, x in expected.items()) and opened.read("0") == [] and opened.read("zz") == []
    for file, *_ in packs.listed(path):
        assert zipfile.ZipFile(f"{path}/{file}").testzip() is None
    packs.write_packs(spark.createDataFrame(rows[:3], "name string, output binary"), path)  # replaces all
    assert {r.name for r in spark.read.format("packs").load(path).collect()} == {r[0] for r in rows[:3]} and len([f for f in os.listdir(path) if f.endswith(".zip")]) == len(packs.listed(path))
    packs.write_packs(spark.createDataFrame([], "name string, output binary"), path)
    assert spark.read.format("packs").load(path).collect() == []


def test_one_name_is_one_range(tmp_path, spark):
    spark.dataSource.register(packs.Packs)
    path = str(tmp_path / "out")
    packs.write_packs(spark.createDataFrame([(f"{n:03}", bytes([n]) * 10_000) for n in range(100)], "name string, output binary").coalesce(1), path)
    opened = packs.Opened(path)
    opened.read("050")
    pack = next(iter(opened.open.values()))
    ranges, own = [], pack.fp.read

    class Counted:
        def __getattr__(self, name):
            return getattr(pack_file, name)

        def read(self, *n):
            at = pack_file.tell()
            data = own(*n)
            ranges.append((at, at + len(data)))
            return data

    pack_file, pack.fp = pack.fp, Counted()
    name = next(n for n in pack.namelist() if n != "050")
    assert opened.read(name) == [bytes([int(name)]) * 10_000]
    begin = pack.NameToInfo[name].header_offset
    assert min(a for a, _ in ranges) == begin and max(b for _, b in ranges) <= begin + 10_000 + 4096


def test_a_repeated_task_leaves_each_output_once(tmp_path):
    """Attempts that were killed or came second wrote containers, but only what the driver commits is there."""
    import pyarrow as pa

    path = str(tmp_path / "out")
    writer = packs.PackWriter(path, False)
    batch = lambda *names: iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array([n.encode() for n in names], pa.binary())], ["name", "output"])])

    def dies():
        yield next(batch("a", "b"))
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    slow, good, other = writer.write(batch("a", "b")), writer.write(batch("a", "b")), writer.write(batch("c"))
    assert packs.listed(path) == [] and len(list(tmp_path.glob("out/*.zip"))) == 4
    writer.commit([good, other, None])
    assert {p[0] for p in packs.listed(path)} == {good.packs[0][0], other.packs[0][0]} and len(list(tmp_path.glob("out/*.zip"))) == 2 and slow.packs[0][0] not in os.listdir(path)
    opened = packs.Opened(path)
    assert [opened.read(n) for n in "abc"] == [[b"a"], [b"b"], [b"c"]]
    failed = packs.PackWriter(path, False)
    failed.write(batch("d"))
    failed.abort([None])
    assert len(list(tmp_path.glob("out/*.zip"))) == 2 and opened.read("d") == []


def test_reports_and_responses_with_assets(spark):
    rows = spark.createDataFrame([(1, "p.html", "sanitised", 5, 6, None, "text/html", [], b"x", [(0, "http://h/a", "clean", None, 3)]), (2, "q.html", "ssrf_blocked", 5, 0, None, None, [], None, None)],
                                 "id long, name string, status string, bytes_in long, bytes_out long, declared_mime string, sniffed_mime string, actions array<" + pipeline.ACTION + ">, output binary, "
                                 "subresources array<struct<slot:int,url:string,status:string,rule:string,bytes:long>>")
    reports = {r.id: json.loads(r.report) for r in pipeline.report_json(rows).collect()}
    assert reports[1]["subresources"] == [{"slot": 0, "url": "http://h/a", "status": "clean", "rule": None, "bytes": 3}] and "subresources" not in reports[2] and reports[2]["actions"] == []
    assets = spark.createDataFrame([(1, "1-p.html.assets/asset-1.png", b"\x00"), (1, "1-p.html.assets/asset-0.css", b"p{}")], "id long, name string, output binary")
    found = {r.id: (r.http_code, json.loads(r.body)) for r in pipeline.responses(rows, assets).collect()}
    assert found[1][0] == 200 and [a["path"] for a in found[1][1]["assets"]] == ["1-p.html.assets/asset-0.css", "1-p.html.assets/asset-1.png"] and found[1][1]["assets"][0]["content"] == "cHt9" and "error" not in found[1][1]
    assert found[2][0] == 403 and found[2][1]["error"] == "ssrf_blocked" and "assets" not in found[2][1]
