"""Allowed active content is taken out of style sheets, TIFF and PDF by ``process``; other rows keep their bytes."""

import struct
import zlib

from siftwell.functions import css, netaddr
from siftwell.operators import scanners, urls
from siftwell.plans import pipeline
from siftwell.policy import Policy, SubresourceRules


def packed(objects):
    body = zlib.compress(objects, 9)
    return b"3 0 obj << /Type /ObjStm /Filter /FlateDecode /Length %d >>\nstream\n" % len(body) + body + b"endstream\nendobj\n"


def test_allowed_findings_are_rewritten(spark):
    objects = b"1 0 << /OpenAction 2 0 R >> << /S /JavaScript /JS (app.alert(1)) >> " + b" ".join(b"%d" % (k * k) for k in range(200))
    image = zlib.compress(b"pixels" * 50)
    inputs = {
        "a.css": b"@import url(x.css);\na{width:expression(1)}\np{color:red}\xff",
        "b.css": b"a{color:red}",
        "a.tiff": b"II*\0" + struct.pack("<I", 8) + struct.pack("<HI", 0, 14) + struct.pack("<HI", 0, 8),
        "a.pdf": b"%PDF-1.4\n1 0 obj << /OpenAction 2 0 R /Kids [3 0 R] >> endobj\n",
        "b.pdf": b"%PDF-1.5\n2 0 obj << /Filter /FlateDecode >>\nstream\n" + image + b"\nendstream\nendobj\n" + packed(objects),
        "c.pdf": b"%PDF-1.4\n1 0 obj << /Kids [3 0 R] >> endobj\n",
        "a.js": b"alert(1)",
    }
    kinds = {"css": "text/css", "tiff": "image/tiff", "pdf": "application/pdf", "js": "text/javascript"}
    rows = spark.createDataFrame([(n, n, bytearray(d), kinds[n.split(".")[1]]) for n, d in inputs.items()], "id string, name string, data binary, declared_header string")
    lists = urls.blocklist_rows(spark.createDataFrame([], "value string")), urls.protected_table(spark, ["paypal.com"]), netaddr.deny_table(spark)
    found = {r.id: r for r in pipeline.process(rows, Policy(subresources=SubresourceRules(active_content_rule="allow")), *lists).collect()}
    out = {n: bytes(r.output) for n, r in found.items()}
    assert {n: r.status for n, r in found.items()} == {n: "clean" if n in ("b.css", "c.pdf") else "sanitised" for n in inputs}
    assert all(a.action == "allow" for r in found.values() for a in r.actions if a.category == "active_content")
    assert css.css_findings(out["a.css"].decode("utf-8", "replace")) == [] and b"p{color:red}\xff" in out["a.css"]
    assert scanners.tiff_break(inputs["a.tiff"]) is not None and scanners.tiff_break(out["a.tiff"]) is None
    for n in ("a.pdf", "b.pdf"):
        assert scanners.pdf_active(inputs[n]) is not None and scanners.pdf_active(out[n]) is None and len(out[n]) == len(inputs[n])
    assert b"/Kids [3 0 R]" in out["a.pdf"] and image in out["b.pdf"]
    body = out["b.pdf"].split(b"/ObjStm")[1].split(b"stream\n")[1]
    assert len(zlib.decompressobj().decompress(body)) == len(objects)
    assert all(out[n] == inputs[n] for n in ("b.css", "c.pdf", "a.js"))
    refused = pipeline.process(rows, Policy(), *lists).where("status = 'refused'").collect()
    assert {r.id for r in refused} == {"a.css", "a.tiff", "a.pdf", "b.pdf", "a.js"} and all(r.output is None for r in refused)
