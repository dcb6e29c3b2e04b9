import os

from pyspark.sql import functions as F

from siftwell.functions import netaddr, sniff
from siftwell.operators import urls
from siftwell.plans import evaluate, guard, pipeline, subresources
from siftwell.policy import Policy, SubresourceRules
from siftwell.sources.inputs import gather, read_files, safe_name, write_table

NETWORKS = [("8.8.8.8", None), ("10.0.0.0", "ssrf.private"), ("10.255.255.255", "ssrf.private"), ("11.0.0.0", None), ("169.254.169.254", "ssrf.link_local"), ("::1", "ssrf.loopback"),
            ("fd00:ec2::254", "ssrf.unique_local"), ("::ffff:127.0.0.1", "ssrf.loopback"), ("64:ff9b::a00:1", "ssrf.private"), ("2002:7f00:1::", "ssrf.loopback"), ("2600::1", None)]


def lists(spark, blocked=("evil.com",), protected=("paypal.com", "microsoft.com")):
    lines = spark.createDataFrame([("# list",), ("",), *[(f"0.0.0.0 {b} # x",) for b in blocked]], "value string")
    return urls.blocklist_rows(lines), urls.protected_table(spark, list(protected)), netaddr.deny_table(spark)


def test_networks(spark):
    import ipaddress

    rows = [(a, ipaddress.ip_address(a).version, f"{int(ipaddress.ip_address(a)):032x}") for a, _ in NETWORKS]
    found = netaddr.classify(spark.createDataFrame(rows, "a string, f int, d string"), netaddr.deny_table(spark), "a", "f", "d")
    assert {r.a: r.rule for r in found.collect()} == {a: r for a, r in NETWORKS if r}


def test_url_verdicts(spark):
    cases = {
        "http://a.evil.com/x": ("blocked", None), "http://notevil.com/": ("clean", None), "http://login.pаypal.com": ("homograph", None), "http://rnicrosoft.com": ("homograph", None),
        "http://paypal.com/": ("clean", None), "https://u:p@x.org/a": ("userinfo", "https://x.org/a"), "http://127.0.0.1/": ("internal", None), "http://[::ffff:10.0.0.1]/": ("internal", None),
        "http://x.org:99999/": ("malformed", None), "http://a\u0001b/": ("malformed", None), "/a/b": ("clean", None), "mailto:x@y": ("clean", None), "//evil.com/x": ("blocked", None),
        "http://X.org:80/": ("clean", "http://x.org/"), "http://xn--mnchen-3ya.de/": ("idn", None), "http://münchen.de/": ("idn", "http://xn--mnchen-3ya.de/"),
    }
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    found = {r.url: (r.label, r.canonical) for r in urls.classify_urls(rows, *lists(spark)).collect()}
    assert found == cases


def test_sanitised_page(spark):
    page = (b'<!DOCTYPE html>\n<p onclick="x()">a</p>\n<script>alert(1)</script><a href="java&#115;cript:x">b</a><iframe src="http://x.org"><b></b></iframe>'
            b'<meta http-equiv="Refresh" content="0"><img src="http://evil.com/a.png"><a href="https://u:p@x.org/">c</a><link rel="Stylesheet" href="s.css">')
    rows = spark.createDataFrame([(1, "a.html", page, None), (2, "b.html", b"<!DOCTYPE html><p>ok</p>", None), (3, "c.html", None, None), (4, "d.png", b"GIF89a", None), (5, "e.js", b"x", None),
                                  (6, "f.bin", b"x" * 50, None), (7, "g.svg", b"<svg onload='x'/>", None)], "id long, name string, data binary, declared_header string")
    from siftwell.policy import Budgets

    found = {r.id: r for r in pipeline.process(rows, Policy(budgets=Budgets(max_input_bytes=1000)), *lists(spark)).collect()}
    rules = [(a.rule_id, a.action) for a in found[1].actions]
    assert rules == [("html.attr.event_handler", "remove"), ("html.script.disallowed", "remove"), ("html.attr.dangerous_scheme", "rewrite"), ("html.frame.disallowed", "placeholder"),
                     ("html.meta.refresh", "remove"), ("url.blocklist", "rewrite"), ("url.userinfo", "rewrite")]
    out = bytes(found[1].output).decode()
    assert out == ('<!DOCTYPE html>\n<p>a</p>\n<a href="#blocked">b</a><div class="sanitized-placeholder"></div><img src="#blocked"><a href="https://x.org/">c</a><link rel="Stylesheet" href="s.css">')
    assert [(r.raw, r.kind) for r in found[1].references] == [("#blocked", "image"), ("s.css", "css")]
    assert found[1].actions[0].location.line == 2 and found[1].actions[1].location.line == 3
    assert [found[k].status for k in (1, 2, 3, 4, 5, 6, 7)] == ["sanitised", "clean", "clean", "sanitised", "refused", "clean", "refused"]
    assert bytes(found[2].output) == b"<!DOCTYPE html><p>ok</p>" and found[5].output is None
    assert found[4].actions[0].original == "declared=image/png sniffed=image/gif"
    tight = pipeline.process(rows, Policy(budgets=Budgets(max_input_bytes=10)), *lists(spark))
    assert {r.id for r in tight.where("status = 'budget_exceeded'").collect()} == {1, 2, 6, 7}


def test_subresources(spark):
    reports = spark.createDataFrame([(1, "http://h/a/p.html", None, [("x.css", "css"), ("./x.css", "css"), ("/y.png", "image"), ("#f", "image"), ("data:x", "image"), ("z.png", "image"), ("w.png", "image")])],
                                    "id long, page_url string, base string, references array<struct<raw:string,kind:string>>")
    asked = subresources.slots(reports, 3)
    rows = {r.slot: (r.url, r.raw, r.over) for r in asked.collect()}
    assert rows == {0: ("http://h/a/x.css", "x.css", False), 1: ("http://h/y.png", "/y.png", False), 2: ("http://h/a/z.png", "z.png", False), 3: ("http://h/a/w.png", "w.png", True)}
    png = b"\x89PNG\r\n\x1a\n"
    responses = spark.createDataFrame([("http://h/a/x.css", 200, "text/css", b"a" * 5, None), ("http://h/y.png", 200, "image/png", png, None), ("http://h/a/z.png", 200, "image/png", png + b"1", None)], "url string, status int, content_type string, body binary, failure string")
    found = subresources.outcomes(asked, responses, Policy(subresources=SubresourceRules(max_total_bytes=14)))
    assert [(r.slot, r.status, r.asset) for r in found.orderBy("slot").collect()] == [(0, "clean", "asset-0.css"), (1, "clean", "asset-1.png"), (2, "budget_exceeded", None), (3, "budget_exceeded", None)]
    assert subresources.rewrites(found, Policy()).first().rewrites == {"x.css": "asset-0.css", "/y.png": "asset-1.png", "z.png": "#blocked", "w.png": "#blocked"}


def test_guard(spark):
    dns = spark.createDataFrame([("ok", 0, 4, f"{0x08080808:032x}"), ("mixed", 0, 4, f"{0x08080808:032x}"), ("mixed", 1, 4, f"{0x0A000001:032x}"), ("own", 0, 4, f"{0x7F000001:032x}")], "host string, ord int, family int, digits string")
    own = f"{0x7F000001:032x}:80"
    requests = spark.createDataFrame([(1, "ok", 80, None), (2, "mixed", 80, None), (3, "own", 80, own), (4, "own", 81, own), (5, "none", 80, None)], "request_id long, host string, port int, endpoint string")
    found = {r.request_id: (r.allowed, r.rule) for r in guard.decide(requests, dns, netaddr.deny_table(spark)).collect()}
    assert found == {1: (True, None), 2: (False, "ssrf.private"), 3: (True, None), 4: (False, "ssrf.loopback"), 5: (False, None)}


def test_guard_of_addresses_and_networks(spark):
    dns = spark.createDataFrame([("in", 0, 4, f"{0x0A000001:032x}"), ("far", 0, 4, f"{0xC0A80001:032x}")], "host string, ord int, family int, digits string")
    requests = spark.createDataFrame([(1, "127.0.0.1", 80, None), (2, "8.8.8.8", 80, None), (3, "[::1]", 80, None), (4, "in", 80, None), (5, "far", 80, None), (6, "0x7f.1", 80, None)], "request_id long, host string, port int, endpoint string")
    found = {r.request_id: (r.allowed, r.rule) for r in guard.decide(requests, dns, netaddr.deny_table(spark), ("10.0.0.0/8",)).collect()}
    assert found == {1: (False, "ssrf.loopback"), 2: (True, None), 3: (False, "ssrf.loopback"), 4: (True, None), 5: (False, "ssrf.private"), 6: (False, "ssrf.loopback")}


def test_redirects(spark):
    answers = spark.createDataFrame([("http://h/a/b", 302, "../c?x"), ("http://h/c?x", 301, "//g/"), ("http://g/", 200, None), ("http://h/f", 302, "file:///etc"), ("http://h/e", 302, " "), ("http://h/l", 307, "l"), ("http://h/x", 500, None)], "url string, status int, location string")
    asked = spark.createDataFrame([(n, f"http://h/{u}") for n, u in enumerate(("a/b", "f", "e", "l", "x", "none"))], "request_id long, url string")
    found = {r.request_id: (r.outcome, r.hops, r.final_url) for r in guard.follow(asked, answers, 3).collect()}
    assert found == {0: ("fetched", 2, "http://g/"), 1: ("bad_scheme", 0, "http://h/f"), 2: ("bad_redirect", 0, "http://h/e"), 3: ("too_many", 3, "http://h/l"), 4: ("http_error", 0, "http://h/x"), 5: ("no_response", 0, "http://h/none")}


def test_inputs_by_url(spark):
    from siftwell.plans.fetch import acquired, process_all
    from siftwell.policy import FetchRules

    names = {0: ("url", "http://ok/a.html"), 1: ("url", "ftp://ok/a"), 2: ("malformed_url", "http://"), 3: ("file", "/in/b.html"), 4: ("file", "/in/none.html"), 5: ("url", "http://127.0.0.1/"), 6: ("url", "http://ok/in"),
             7: ("url", "http://ok/gone"), 8: ("url", "http://ok/coded"), 9: ("url", "http://ok/large"), 10: ("skipped_symlink", "/in/z")}
    rows = spark.createDataFrame([(n, k, s, s.rsplit("/", 1)[-1]) for n, (k, s) in names.items()], "input_index long, kind string, source string, name string")
    files = spark.createDataFrame([("/in/b.html", b"<!DOCTYPE html><p onclick=x>")], "source string, data binary")
    page = b"<!DOCTYPE html><p>"
    responses = spark.createDataFrame([("http://ok/a.html", 302, "b", None, None, None, None), ("http://ok/b", 200, None, "text/html", None, None, page), ("http://ok/in", 302, "http://far/", None, None, None, None),
                                       ("http://far/", 200, None, "text/html", None, None, page), ("http://ok/coded", 200, None, None, "gzip", None, page), ("http://ok/large", 200, None, None, None, 10**6, page)],
                                      "url string, status int, location string, content_type string, content_encoding string, content_length long, body binary")
    dns = spark.createDataFrame([("ok", 0, 4, f"{0x08080808:032x}"), ("far", 0, 4, f"{0x0A000001:032x}")], "host string, ord int, family int, digits string")
    policy = Policy(fetch=FetchRules(max_response_bytes=1000))
    found = process_all(acquired(rows, files, responses, dns, netaddr.deny_table(spark), policy), policy, *lists(spark)).orderBy("id").collect()
    assert [r.status for r in found] == ["clean", "unsupported_scheme", "malformed_url", "sanitised", "io_error", "ssrf_blocked", "ssrf_blocked", "fetch_error", "fetch_error", "fetch_error", "skipped_symlink"]
    assert bytes(found[0].output) == page and found[5].output is None


def test_whole_pages(spark):
    """A page with its references: bodies are sanitised like inputs, and the page leads to what was kept."""
    page = b'<!DOCTYPE html><link rel=stylesheet href="s.css"><img src="i.svg"><img src=/p.png><img src=bad.svg><img src="gone.png"><img src="p.png#x">'
    png = b"\x89PNG\r\n\x1a\n"
    rows = spark.createDataFrame([(1, "http://h/d/p.html", page, "text/html"), (2, "http://h/q.html", b"<!DOCTYPE html><p>", None)], "id long, name string, data binary, declared_header string")
    responses = spark.createDataFrame([("http://h/d/s.css", 200, "text/css", b"p{color:red}", None), ("http://h/d/i.svg", 200, "image/svg+xml", b"<svg><path d='x'/></svg>", None), ("http://h/p.png", 200, "image/png", png, None),
                                       ("http://h/d/bad.svg", 200, "image/svg+xml", b"<svg onload='x()'/>", None), ("http://h/d/p.png", 200, "text/css", b"@import url(x);", None)], "url string, status int, content_type string, body binary, failure string")
    reports, assets = subresources.sanitise_whole(rows, responses, Policy(), *lists(spark))
    found = {r.id: r for r in reports.collect()}
    assert [(x.slot, x.status) for x in found[1].subresources] == [(0, "clean"), (1, "clean"), (2, "clean"), (3, "refused"), (4, "fetch_error"), (5, "refused")] and found[2].subresources is None
    assert bytes(found[1].output) == (b'<!DOCTYPE html><link rel=stylesheet href="asset-0.css"><img src="asset-1.svg"><img src="asset-2.png"><img src="#blocked"><img src="gone.png"><img src="#blocked">')
    assert [a.rule_id for a in found[1].actions] == ["subresource.refused"] * 2 and found[1].status == "sanitised" and found[2].status == "clean"
    assert {(r.id, r.name): bytes(r.output) for r in assets.collect()} == {(1, "asset-0.css"): b"p{color:red}", (1, "asset-1.svg"): b"<svg><path d='x'/></svg>", (1, "asset-2.png"): png}


def test_unreadable_pages_are_refused(spark):
    rows = spark.createDataFrame([(1, "a", b"<!DOCTYPE html><svg><p><style><a>", None), (2, "b", b"<!DOCTYPE html><!--><script>x</script>-->", None)], "id long, name string, data binary, declared_header string")
    found = {r.id: r for r in pipeline.process(rows, Policy(), *lists(spark)).collect()}
    assert found[1].status == "refused" and found[1].output is None and bytes(found[2].output) == b"<!DOCTYPE html><!-->-->"


def test_streamed_batches(spark, tmp_path):
    from siftwell.streaming.streams import sanitise_batches, submissions

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rows.write.parquet(str(tmp_path / "in"))
    query = sanitise_batches(submissions(spark, str(tmp_path / "in"), "id long, name string"), lambda batch: batch.select("id"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in found.collect()) == [1, 2] and found.columns == ["id", "batch"]


def test_types(spark):
    rows = spark.createDataFrame([(b"\xff\xd8\xff", "image/jpg; q=1", "a"), (b"", None, "x/.bashrc"), (b"....ftyp", None, "a.tar.GZ"), (b"xxxxxxxxWAVE", None, "m.mp3?x=.png")], "d binary, h string, n string")
    found = [(r.s, r.c) for r in rows.select(sniff.sniffed(F.col("d")).alias("s"), sniff.declared(F.col("h"), F.col("n")).alias("c")).collect()]
    assert found == [("image/jpeg", "image/jpeg"), (None, None), ("video/mp4", None), ("audio/wav", "audio/mpeg")]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("b.html", "a.HTM", "c.txt", "sub/d.html"):
        (tmp_path / "in" / name).write_text("x" * len(name))
    os.symlink("/etc/hostname", tmp_path / "in" / "z.html")
    rows = gather(spark, [str(tmp_path / "in"), "http://x/y.html?q", "http://"]).orderBy("input_index").collect()
    assert [(r.kind, r.name) for r in rows] == [("file", "a.HTM"), ("file", "b.html"), ("file", "d.html"), ("skipped_symlink", "z.html"), ("url", "y.html"), ("malformed_url", "http:")]
    files = read_files(spark, [r.source for r in rows if r.kind == "file"], 6)
    assert {r.name: r.data is None for r in files.collect()} == {"a.HTM": False, "b.html": False, "d.html": True}
    assert spark.range(1).select(safe_name(F.lit(3), F.lit("http://x/..")).alias("n")).first().n == "3-input"
    write_table(spark.createDataFrame([(1, ["a", "b"])], "n int, rules array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().rules == "a b"


def test_evaluation(spark):
    truth = spark.createDataFrame([("malicious", "a", "x", ["refused"], ["r"], [], [], ["evil"], []), ("benign", "b", "x", ["clean"], [], [], ["q"], [], ["keep"])],
                                  "kind string, name string, category string, status array<string>, rules array<string>, allowed array<string>, forbidden_rules array<string>, forbidden array<string>, preserved array<string>")
    results = spark.createDataFrame([("malicious", "a", "refused", ["r", "r"], None), ("benign", "b", "clean", ["q"], "KEEP")], "kind string, name string, status string, fired array<string>, output string")
    measured = evaluate.measure(truth, results)
    assert {r.name: r.verdict for r in measured.collect()} == {"a": "detected", "b": "false_positive"}
    assert {r.rule: (r.precision, r.recall) for r in evaluate.rule_confusion(measured).collect()} == {"r": ("1.0000", "1.0000"), "q": ("0.0000", "n/a")}
    odd = spark.createDataFrame([("k", v) for v in (4, 1, 3, 2)], "k string, v int")
    assert evaluate.middle(odd, "k", "v").first().middle == 3
    import random

    rng = random.Random(2)
    many = [(rng.choice("ab"), rng.randrange(9)) for _ in range(500)] + [("c", None), ("d", 5)]
    found = {r.k: (r.n, r.low, r.middle, r.high) for r in evaluate.middle(spark.createDataFrame(many, "k string, v int").repartition(7), "k", "v").collect()}
    own = {k: sorted(v for x, v in many if x == k and v is not None) for k in "abd"}
    assert found == {k: (len(v), v[0], v[len(v) // 2], v[-1]) for k, v in own.items()}
    cells = spark.createDataFrame([("x y",), ("y",), ("",), (None,)], "c string")
    assert {r.word: r.n for r in evaluate.words_by_cell(cells, "c").collect()} == {"x": 1, "y": 2}


def test_labelled_corpus(spark, tmp_path):
    import pytest
    from siftwell.sources.truth import corpus, parse_truth, read_truth

    (tmp_path / "truth.toml").write_text("""[corpus]\nbenign_dir = "x"\n[[sample]]\nname = "a.html"\nset = "malicious"\ncategory = "xss"\nstatus = ["sanitised"]\nrules = ["html.script.disallowed"]\nforbidden = ["alert"]
[[sample]]\nname = "b.html"\nset = "benign"\ncategory = "plain"\nstatus = ["clean"]\n[sample.fetch]\nallowed = []\n[[sample]]\nname = "gone.html"\nset = "benign"\ncategory = "plain"\n""")
    for kind, name, text in (("malicious", "a.html", "<!DOCTYPE html><script>alert(1)</script>"), ("benign", "b.html", "<!DOCTYPE html><p>"), ("benign", "new.html", " ")):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_text(text)
    truth, files = read_truth(spark, str(tmp_path / "truth.toml")), corpus(spark, {k: str(tmp_path / k) for k in ("benign", "malicious")})
    reports = pipeline.process(files, Policy(), *lists(spark)).withColumn("kind", F.split("id", "/")[0])
    measured = evaluate.measure(truth, reports.select("kind", "name", "status", F.transform("actions", lambda a: a["rule_id"]).alias("fired"), F.col("output").cast("string").alias("output")))
    assert {r.name: r.verdict for r in measured.collect()} == {"a.html": "detected", "b.html": "clean"}
    assert {tuple(r) for r in evaluate.agreement(truth, files, "name").collect()} == {("gone.html", "missing"), ("new.html", "unlabelled")}
    assert [r.name for r in evaluate.by_category(truth).collect()] == ["b.html", "gone.html", "a.html"]
    for bad in ('[[sample]]\nname = "a"\nset = "odd"', '[[sample]]\nname = "a"\nset = "benign"\nx = 1', '[[sample]]\nname = "a"\nset = "benign"\n' * 2):
        with pytest.raises(ValueError):
            parse_truth(bad)


def test_orders_and_rounding(spark):
    runs = spark.createDataFrame([("custom", "a"), ("fetch", "b"), ("nofetch", "d"), ("nofetch", "c")], "kind string, slug string")
    assert [r.slug for r in evaluate.run_order(runs).collect()] == ["c", "d", "b", "a"]
    counts = spark.createDataFrame([("a", 2), ("b", 1), ("c", 2)], "name string, n int")
    assert [r.name for r in evaluate.by_count(counts).collect()] == ["b", "c", "a"]
    rows = spark.createDataFrame([("k", 1, 3.0, 10.0), ("k", 2, 1.7, 10.0)], "run string, workers int, seconds double, mib double")
    assert [tuple(r)[2:] for r in evaluate.scaling(rows, "run", (4, 1, 3, 3)).orderBy("workers").collect()] == [(3.0, 3.3, 1.0, 1.0), (1.7, 5.9, 1.765, 0.882)]


def test_streams(spark, tmp_path):
    from siftwell.streaming.streams import resolve_verdicts, submissions, typed_stream

    rows = spark.createDataFrame([(1, "a.png", b"GIF89a", None), (2, "b", b"%PDF-", "text/html")], "id long, name string, data binary, declared_header string")
    rows.write.parquet(str(tmp_path / "in"))
    query = typed_stream(submissions(spark, str(tmp_path / "in"), rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))).writeStream.format("memory").queryName("typed").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("typed").collect()} == {(1, "image/png", "image/gif", "image/gif"), (2, "text/html", "application/pdf", "application/pdf")}
    looks = spark.sql("SELECT * FROM VALUES ('a', timestamp_millis(0), true), ('a', timestamp_millis(500), false), ('a', timestamp_millis(2000), false), ('a', timestamp_millis(9000), true) t(key, at, allowed)")
    looks.coalesce(1).write.parquet(str(tmp_path / "looks"))
    query = resolve_verdicts(spark.readStream.schema(looks.schema).parquet(str(tmp_path / "looks")), 1000).writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.at_ms, r.allowed, r.hit) for r in spark.table("verdicts").orderBy("at_ms").collect()] == [(0, True, False), (500, True, True), (2000, False, False), (9000, False, True)]


def test_rewritten_references(spark):
    from siftwell.operators.html import rewrite_references

    page = b"<link rel=stylesheet href=' x.css '><img src=y.png><source srcset='y.png 2x, z.png'><a href=y.png>"
    rows = spark.createDataFrame([(1, page, {"x.css": "asset-0.css", "y.png": "#blocked"}), (2, page, {})], "id long, data binary, rewrites map<string,string>")
    found = {r.id: bytes(r.output) for r in rewrite_references(rows).collect()}
    assert found == {1: b'<link rel=stylesheet href="asset-0.css"><img src="#blocked"><source srcset="#blocked 2x, z.png"><a href=y.png>', 2: page}


def test_responses_and_scenarios(spark):
    import base64
    import json

    reports = spark.createDataFrame([(1, "clean", 2, 2, b"ok", []), (2, "refused", 2, 0, None, [("r",)]), (3, "budget_exceeded", 9, 0, None, [])], "id long, status string, bytes_in long, bytes_out long, output binary, actions array<struct<rule_id:string>>")
    found = {r.id: (r.http_code, json.loads(r.body)) for r in pipeline.responses(reports).collect()}
    assert found[1][0] == 200 and found[3][0] == 413 and base64.b64decode(found[1][1]["content"]) == b"ok" and found[2][0] == 200 and found[2][1]["rules"] == ["r"] and "content" not in found[2][1]
    outcomes = spark.createDataFrame([("a", 200, "sanitised", ["r"], "fine", 5), ("b", 500, "clean", [], "EVIL", 50)], "name string, http int, status string, fired array<string>, output string, wall_ms long")
    expected = spark.createDataFrame([("a", [200], "sanitised", ["r"], ["evil"], 10), ("b", [200], "sanitised", ["r", "s"], ["evil"], 10), ("c", None, None, None, None, None)], "name string, http array<int>, status string, rules array<string>, forbidden array<string>, max_wall_ms long")
    assert {r.name: r.reasons for r in evaluate.judge(outcomes, expected).collect()} == {"a": [], "b": ["http code", "status", "missing r s", "leaked", "too slow"], "c": ["no outcome"]}


def test_registered_functions(spark):
    from siftwell.functions.register import register

    register(spark)
    assert spark.sql("SELECT parsed_host('MÜNCHEN.de').ascii AS a, decode_references('&#97;&colon;') AS b").first() == ("xn--mnchen-3ya.de", "a:")
    assert [r.rule for r in spark.sql("SELECT * FROM css_findings('@import \"x\"; a{width:expression(1)}')").collect()] == ["scan.css.import", "scan.css.expression"]
    assert spark.sql("SELECT * FROM html_tags(CAST('<p id=a>' AS BINARY))").first().attrs == {"id": "a"}


def folded(rows, total, most, count_refused):
    """The byte budget by hand: (state, length) of one page's references in order."""
    used, out = 0, []
    for state, length in rows:
        if count_refused and state != "budget_exceeded" and used >= total:
            state = "budget_exceeded"
        elif state in ("clean", "sanitised", "refused") and length:
            if length > min(total - used, most):
                state = "budget_exceeded"
            elif count_refused or state != "refused":
                used += length
        out.append(state)
    return out


def test_byte_budget_is_one_pass():
    import random
    import time

    import pyarrow as pa

    rng = random.Random(2)
    rows = [(rng.choice(["clean", "sanitised", "refused", "fetch_error", "budget_exceeded", "ssrf_blocked"]), rng.choice([0, 1, 3, 50, 400])) for _ in range(100_000)]
    for total, most, count_refused in ((20_000_000, 1 << 62, False), (5_000, 300, True), (0, 10, True), (900, 400, False)):
        batches = [pa.RecordBatch.from_arrays([pa.array(["p"] * 10_000), pa.array(range(k, k + 10_000), pa.int32()), pa.array([s for s, _ in rows[k : k + 10_000]]), pa.array([n for _, n in rows[k : k + 10_000]], pa.int64())],
                                              ["id", "slot", "state", "length"]) for k in range(0, 100_000, 10_000)]
        began = time.process_time()
        found = [s for b in subresources._spend(iter(batches), total, most, count_refused) for s in b.column(2).to_pylist()]
        assert time.process_time() - began < 2 and found == folded(rows, total, most, count_refused)


def test_a_page_with_many_references(spark):
    """One page holds most references; each page has a budget of its own."""
    from pyspark.sql import functions as F

    rows = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(7).alias("id"), F.col("id").cast("int").alias("slot"), F.concat(F.lit("http://h/"), (F.col("id") % 50).cast("string")).alias("url"),
                                      F.lit("x").alias("raw"), F.lit("image").alias("kind"), F.lit(None).cast("string").alias("refusal"), F.lit(False).alias("over"))
    png = b"\x89PNG\r\n\x1a\n"
    responses = spark.createDataFrame([(f"http://h/{k}", 200, "image/png", png + b"x" * k, None) for k in range(50)], "url string, status int, content_type string, body binary, failure string")
    found = subresources.outcomes(rows, responses, Policy(subresources=SubresourceRules(max_total_bytes=20_000)))
    by_hand = {}
    for k in range(30_000):
        by_hand.setdefault(k % 7 if k % 10 == 0 else 7, []).append(("clean", 8 + k % 50))
    for page, refs in by_hand.items():
        assert [r.status for r in found.where(F.col("id") == page).orderBy("slot").select("status").collect()] == folded(refs, 20_000, 1 << 62, False)


def test_guard_by_origin_and_scope(spark):
    from siftwell.policy import SsrfRules

    assert [guard.guarded(o, Policy(ssrf=SsrfRules(guard_input_urls=s))) for s in ("always", "server", "never") for o in ("subresource", "server", "cli")] == [True] * 5 + [False] + [True, False, False]
    dns = spark.createDataFrame([("pub.x", 0, 4, f"{0x08080808:032x}"), ("own.x", 0, 4, f"{0x0A000001:032x}"), ("own.x", 1, 4, f"{0x08080808:032x}"), ("in.x", 0, 4, f"{0x7F000001:032x}")], "host string, ord int, family int, digits string")
    own = f"{0x0A000001:032x}:80"
    asked = spark.createDataFrame([("http://PUB.x/a", None), ("http://own.x/", own), ("http://own.x:81/", own), ("http://own.x/", None), ("https://in.x/", None), ("http://none.x/", None), ("http://[::1]/", None), ("http://10.0.0.1/", own), ("http://pub.x/a", own)], "url string, endpoint string")
    found = {(r.url, r.endpoint): (r.rule, r.reached) for r in guard.vet(asked, dns, netaddr.deny_table(spark), Policy()).collect()}
    assert found == {("http://PUB.x/a", None): (None, f"{0x08080808:032x}:80"), ("http://own.x/", own): (None, own), ("http://own.x:81/", own): ("ssrf.private", None), ("http://own.x/", None): ("ssrf.private", None),
                     ("https://in.x/", None): ("ssrf.loopback", None), ("http://none.x/", None): ("unresolved", None), ("http://[::1]/", None): ("ssrf.loopback", None), ("http://10.0.0.1/", own): (None, own), ("http://pub.x/a", own): (None, f"{0x08080808:032x}:80")}
    strict = {r.rule for r in guard.vet(asked.where("endpoint IS NOT NULL AND url LIKE '%own.x/'"), dns, netaddr.deny_table(spark), Policy(ssrf=SsrfRules(same_origin_exemption=False))).collect()}
    assert strict == {"ssrf.private"}
    literal = {r.url: r.rule for r in guard.vet(asked.where("endpoint IS NULL"), None, netaddr.deny_table(spark), Policy()).collect()}
    assert literal["http://[::1]/"] == "ssrf.loopback" and literal["http://none.x/"] is None
    answers = spark.createDataFrame([("http://pub.x/1", 302, "/2"), ("http://pub.x/2", 302, "http://in.x/3"), ("http://in.x/3", 302, "http://pub.x/4"), ("http://pub.x/4", 200, None)], "url string, status int, location string")
    for origin, scope, expected in (("subresource", "never", ("blocked", "ssrf.loopback", 2)), ("server", "server", ("blocked", "ssrf.loopback", 2)), ("cli", "server", ("fetched", None, 3)), ("server", "never", ("fetched", None, 3))):
        way = guard.fetched(spark.createDataFrame([("http://pub.x/1", None)], "url string, endpoint string"), answers, dns, netaddr.deny_table(spark), Policy(ssrf=SsrfRules(guard_input_urls=scope)), origin).first()
        assert (way.outcome, way.rule, way.hops) == expected


def test_only_asked_bodies_are_read(spark):
    """Bodies that nobody asked for, or behind a denied address, are neither sanitised nor kept; a body without a type is taken for what
    the reference claims; of two responses for a URL one counts."""
    from siftwell.policy import UrlRules

    page = b'<!DOCTYPE html><link rel=stylesheet href="s"><link rel=stylesheet href="http://u:p@h/t"><img src="http://127.0.0.1/x.png"><img src="twice"><script src="j"></script>'
    png = b"\x89PNG\r\n\x1a\n"
    rows = spark.createDataFrame([(1, "http://h/d/p.html", page, "text/html")], "id long, name string, data binary, declared_header string")
    responses = spark.createDataFrame([("http://h/d/s", 200, None, b"@import 'x';"), ("http://127.0.0.1/x.png", 200, "image/png", png), ("http://h/d/twice", 200, "image/png", png + b"1"), ("http://h/d/twice", 404, "image/png", png),
                                       ("http://h/else", 200, "text/css", b"@import 'x';")], "url string, status int, content_type string, body binary")
    policy = Policy(urls=UrlRules(action_userinfo="allow", action_internal="allow"))
    reports, assets = subresources.sanitise_whole(rows, responses, policy, *lists(spark), folders=True)
    found = reports.first()
    assert [(x.slot, x.status) for x in found.subresources] == [(0, "refused"), (1, "refused"), (2, "ssrf_blocked"), (3, "clean")]
    assert {r.name: bytes(r.output) for r in assets.collect()} == {"1-p.html.assets/asset-3.png": png + b"1"} and b'src="1-p.html.assets/asset-3.png"' in bytes(found.output)
