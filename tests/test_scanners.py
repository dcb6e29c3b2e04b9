import struct
import time
import zlib

import pytest

from siftwell.functions import css
from siftwell.functions.hosts import parse_host
from siftwell.functions.markup import Unreadable, decode_references, find_elements
from siftwell.functions.netaddr import deny_rows
from siftwell.operators import scanners
from siftwell.policy import Policy, XmlBudget, ZipBudget, parse_policy


def archive(*entries):
    """A central directory of (name, packed, size) with no files before it."""
    body = b"".join(b"PK\1\2" + bytes(16) + struct.pack("<IIHHH", packed, size, len(name), 0, 0) + bytes(12) + name for name, packed, size in entries)
    return b"PK\3\4" + body + b"PK\5\6" + bytes(4) + struct.pack("<HHIIH", len(entries), len(entries), len(body), 4, 0)


def tiff(*links, count=0):
    """Directories at 8, 8 + 6 and so on, each with the given link."""
    return b"II*\0" + struct.pack("<I", 8) + b"".join(struct.pack("<HI", count, link) for link in links)


def test_archives():
    data = archive((b"a.txt", 10, 500), (b"word/document.xml", 1, 5))
    assert [n for n, *_ in scanners.zip_entries(data)] == [b"a.txt", b"word/document.xml"]
    assert scanners.zip_risk(data, ZipBudget()) is None
    assert scanners.zip_folder(data) == "word"
    assert scanners.zip_risk(archive((b"x", 1, 101)), ZipBudget()) == 4 + 46
    assert scanners.zip_risk(archive((b"x", 6, 600), (b"y", 6, 600)), ZipBudget(max_total_uncompressed_bytes=1000)) == 0
    assert scanners.zip_risk(b"PK\3\4", ZipBudget()) == 0 and scanners.zip_risk(b"PK", ZipBudget()) == 0
    assert scanners.scan_file(archive((b"w/vbaProject.bin", 1, 1)), "application/zip", Policy())[0][0] == "scan.zip.macro_present"


def test_entities():
    bomb = b'<!DOCTYPE r [<!ENTITY a "xxxxxxxxxx">' + b"".join(b'<!ENTITY %c "%s">' % (98 + k, b"&%c;" % (97 + k) * 10) for k in range(8)) + b"]>"
    assert scanners.xml_risk(bomb, XmlBudget())
    assert not scanners.xml_risk(b'<!ENTITY a "x"><!ENTITY b "&a;&a;">', XmlBudget())
    assert scanners.xml_risk(b'<!ENTITY a "&b;"><!ENTITY b "&a;">', XmlBudget())
    assert scanners.xml_risk(b'<!ENTITY a "&a;">', XmlBudget())
    assert scanners.scan_file(b'<?xml?><!ENTITY a SYSTEM "file:///x">', "application/xml", Policy())[0][0] == "scan.xml.xxe"
    assert scanners.scan_file(b"<?xml?><r/>", "application/xml", Policy()) == []


@pytest.mark.parametrize(("mime", "data", "size"), [
    ("image/png", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 4), (3, 4, 16)),
    ("image/gif", b"GIF89a" + struct.pack("<HH", 5, 6), (5, 6, 6)),
    ("image/jpeg", b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08" + struct.pack(">HH", 7, 8) + bytes(4), (8, 7, 13)),
    ("image/webp", b"RIFF....WEBPVP8X" + bytes(8) + b"\x09\0\0\x0a\0\0", (10, 11, 24)),
    ("image/tiff", b"II*\0\x08\0\0\0\2\0" + struct.pack("<HHIHH", 256, 3, 1, 9, 0) + struct.pack("<HHII", 257, 4, 1, 12) + bytes(4), (9, 12, 18)),
    ("image/png", b"\x89PNG", None), ("image/jpeg", b"\xff\xd8\xff\xd9", None), ("image/webp", b"RIFF", None), ("image/gif", b"GIF89a", None), ("text/css", b"", None),
])
def test_image_sizes(mime, data, size):
    assert scanners.image_size(data, mime) == size


def test_tiff_chains():
    assert scanners.tiff_break(tiff(0)) is None
    assert scanners.tiff_break(tiff(14, 8)) == (8, 16)
    assert scanners.tiff_break(tiff(999)) == (999, 10)
    assert scanners.tiff_break(tiff(0, count=9)) == (10, 4)
    assert scanners.tiff_break(scanners.rewritten_tiff(tiff(14, 8))) is None
    assert scanners.tiff_break(b"xx") == (0, 4)


def test_documents():
    assert scanners.pdf_active(b"%PDF-1.4 << /OpenAction 1 0 R >>") == 12
    assert scanners.pdf_active(b"%PDF-1.4 << /JSX 1 >>") is None
    packed = b"%PDF-1.5 << /Type /ObjStm >> stream\n" + zlib.compress(b"<< /AA 1 >>") + b"endstream"
    assert scanners.pdf_active(packed) == 0


@pytest.mark.parametrize(("sheet", "rules"), [
    ("a{color:red}", []), ("@import url(x.css);", ["scan.css.import"]), ("a{width:expression(1)}", ["scan.css.expression"]),
    ("a{width:exp/**/ression(1)}", ["scan.css.expression"]), (r"a{width:\65xpression(1)}", ["scan.css.expression"]),
    ("a{background:url('javascript:x')}", ["scan.css.dangerous_scheme"]), ("input[value^=a]{background:url(//x)}", ["scan.css.exfiltration"]),
    ("a{background:url(data:image/png;base64,x)}", []),
    (r"a{background:url('\6a\61 vascript:alert(1)')}", ["scan.css.dangerous_scheme"]), (r"a{x:\75 rl(javascript:x)}", ["scan.css.dangerous_scheme"]), ("a{x:url(javascript:a'b)}", ["scan.css.dangerous_scheme"]),
    ('a{x:url("javascript:a\nb)}', ["scan.css.dangerous_scheme"]), ("a{x:url( java\tscript:a)}", ["scan.css.dangerous_scheme"]), ("a{x:url('java\tscript:a')}", ["scan.css.dangerous_scheme"]), ('a{x:"data: text/html,x"}', ["scan.css.dangerous_scheme"]),
    ("a{-moz-binding:url(x)}", ["scan.css.expression"]), ("a{behavior:url(x)}", ["scan.css.expression"]), ("a{width:1expression}", ["scan.css.expression"]), ("@import 'javascript:x';", ["scan.css.import", "scan.css.dangerous_scheme"]),
    ('a{content:"/*"} b{width:expression(1)} c{content:"*/"}', ["scan.css.expression"]), ('a{content:"/*"} input[value^=a]{background:url(//e)} c{content:"*/"}', ["scan.css.exfiltration"]),
    ("@media x{input[a^=b]{color:red} p{background:url(x)}}", []), ("@media x{input[a^=b]{color:url(x)}}", ["scan.css.exfiltration"]), ("@layer a; input[a*=b]{--x:image-set('y')}", ["scan.css.exfiltration"]),
    ("@font-face{src:url(x)} a[b$=c]{color:red}", []), ("<!-- @import 'x'; -->", ["scan.css.import"]), (r"@\69mport 'x'", ["scan.css.import"]), ("a{b:'\\\n'; c:url(", []), ("} a{b:expression(", ["scan.css.expression"]),
    ("a{b:'x\n} c{width:expression(1)}", ["scan.css.expression"]), ("/* @import 'x'; */ a{color:red}", []), ("a{b:'@import x'}", []), ("", []), (" \n", []),
])
def test_stylesheets(sheet, rules):
    assert [r for r, *_ in css.css_findings(sheet)] == rules
    assert css.css_findings(css.rewritten_css(sheet)) == []


def test_markup():
    page = b'<!-- <b> --><p ID=a onclick="x>y">t</p><script src=x>"<i>"</script><img src=\'q\' SRC=r><object data=d><b></b></object>'
    found = find_elements(page)
    assert [e["tag"] for e in found] == ["p", "script", "img", "object", "b"]
    assert [(a["name"], a["value"]) for a in found[0]["attrs"]] == [("id", "a"), ("onclick", "x>y")]
    assert page[found[1]["start"] : found[1]["until"]].endswith(b"</script>")
    assert [a["value"] for a in found[2]["attrs"]] == ["q"]
    assert page[found[3]["start"] : found[3]["until"]].endswith(b"</object>")
    assert find_elements(b"") == [] and find_elements(b"<") == [] and find_elements(b"<a") == []
    assert decode_references("j&#97;va&#x73;cript&colon;&amp;lt; &amp=1 &#xD800;") == "javascript:&lt; &amp=1 &#xD800;"


@pytest.mark.parametrize(("page", "tags"), [
    (b"<!--><script>alert(1)</script>-->", ["script"]), (b"<!---><img src=x onerror=a>-->", ["img"]), (b"<!-- a --!><b>", ["b"]), (b"<!-- <b>", []), (b"<!---->\n<b>", ["b"]),
    (b"<a href=x/><b>", ["a", "b"]), (b"<IMG/src=q>", ["img"]), (b"<p title='<b>'>", ["p"]), (b"<a b=\"><i>", []), (b"</p a='>'><b>", ["b"]), (b"</ <b>", []), (b"<?x <b>", []), (b"<3<b>", ["b"]),
    (b"<script><!--<script></script><i>--></script><img>", ["script", "img"]), (b"<script><!--></script><img>", ["script", "img"]), (b"<textarea></textareas></textarea ><b>", ["textarea", "b"]),
    (b"<svg><style><img src=x></style></svg><style><b></style>", ["svg", "style", "img", "style"]), (b"<svg><![CDATA[><a title=\"]]><img src=x>\">", ["svg", "img"]), (b"<plaintext><b>", ["plaintext"]),
    (b"<svg><p><style><a>", None), (b"<svg><desc><![CDATA[<b>", None), (b"<noscript><p title='</noscript><img>'>", None),
])
def test_tokens(page, tags):
    if tags is None:
        with pytest.raises(Unreadable):
            find_elements(page)
    else:
        assert [e["tag"] for e in find_elements(page)] == tags


def test_lines_and_attributes():
    found = find_elements(b"\n<p\n a=1 A=2 =c='d e' f>\n\n<b g=&#97;&amp;>")
    assert [e["line"] for e in found] == [2, 5]
    assert [(a["name"], a["value"]) for a in found[0]["attrs"]] == [("a", "1"), ("=c", "d e"), ("f", "")]
    assert found[1]["attrs"][0]["plain"] == "a&" and found[0]["attrs"][0]["plain"] is None


@pytest.mark.parametrize("unit", [b"<a" + b' x=""' * 100, b"<!", b"<", b"<!--", b"</a", b"<style>", b"<script><!--<script>", b"<a b='", b"<svg><![CDATA[", b"\n<p>", b" x=\"\"", b"<a ", b"<svg>", b"<title>"])
def test_hostile_pages_take_linear_time(unit):
    def seconds(size):
        page, began = b"<a" + unit * (size // len(unit)), time.process_time()
        try:
            find_elements(page)
        except Unreadable:
            pass
        return time.process_time() - began

    assert seconds(1 << 19) < 2 + 6 * seconds(1 << 17)


@pytest.mark.parametrize("unit", ["[", "@import ", "url(", " ", "'", "data: ", "{", "\\", "/*", "a[b^=c]{url(", "expression(", "a[b^=c]{url(x);", "javascript:", "}{;"])
def test_hostile_stylesheets_take_linear_time(unit):
    def seconds(size):
        began = time.process_time()
        css.css_findings("url(" + unit * (size // len(unit)))
        return time.process_time() - began

    assert seconds(1 << 19) < 2 + 6 * seconds(1 << 17)


def test_hostile_documents():
    assert scanners.pdf_active(b"%PDF << /J#61vaScript 1 >>") == 8 and scanners.pdf_active(b"%PDF /#4a#53X") is None and scanners.pdf_active(b"%PDF /#4a#53") == 5
    packed = lambda data: b"%PDF-1.5 << /Type /Obj#53tm >> stream\n" + data + b"endstream"
    assert scanners.pdf_active(packed(zlib.compress(b" " * (20 << 20) + b"/JS 1"))) == 0
    assert scanners.pdf_active(packed(zlib.compress(b" " * (65 << 20)))) == 0 and scanners.pdf_active(packed(b"not packed")) == 0
    assert scanners.pdf_active(packed(zlib.compress(b" " * (1 << 20) + b"/Kids"))) is None
    assert b"61vaScript" not in scanners.rewritten_pdf(b"%PDF << /J#61vaScript 1 >>")
    began = time.process_time()
    scanners.pdf_active(b"%PDF" + b"/ObjStm stream " * 60_000)
    scanners.xml_risk(b'<!ENTITY a "' + b"&" * 1_000_000 + b'">', XmlBudget())
    assert time.process_time() - began < 5


def test_a_sheet_is_rewritten_rule_by_rule():
    sheet = "body{width:expression(1);height:expression(2)}\n@import 'x';p{color:red} @media a{b{x:url(javascript:y)} c{d:e}} q{"
    assert css.rewritten_css(sheet) == "\np{color:red} @media a{ c{d:e}} q{"
    assert css.rewritten_css("a{width:expression(1)} b{c:exp/**/ression(1)}") == "" and css.rewritten_css("a{color:red}") == "a{color:red}"
    line, at = "body {\n  color: red;\n  width: expression(1);\n}", 30
    assert css.css_findings(line) == [("scan.css.expression", at, (0, len(line)))]
    assert css.sheet_places("é{} a{b:expression(1)}".encode()) == [("scan.css.expression", 9)]
    for encoding, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        data = mark + "é{} a{b:expression(1)} c{}".encode(encoding)
        assert css.sheet_places(data) == [("scan.css.expression", 18)] and css.rewritten_sheet(data) == mark + "é{}  c{}".encode(encoding) and css.rewritten_sheet(data + b"x") == css.rewritten_sheet(data)


@pytest.mark.parametrize("unit", [*"([{}-\\'\"*@#1+;é\0e/.~", "url(", "@media{", "a{", "^=", "-->", "a:b;", "@imp@import 'x';ort 'x';", "expr/**/ession", "'javascript:' "])
def test_large_sheets(unit):
    sheet = unit * ((1 << 20) // len(unit))
    began = time.process_time()
    css.css_findings(sheet)
    assert time.process_time() - began < 3
    assert css.css_findings(css.rewritten_css(sheet)) == []


def test_nested_style_rules():
    assert [r for r, *_ in css.css_findings("input[value^=a]{color:red; &:hover{background:url(//x)}} p{background:url(y)}")] == ["scan.css.exfiltration"]
    assert css.css_findings("input[value=a]{background:url(//x)} a[b^=c]{color:red} p{background:url(y)}") == []
    assert [r for r, *_ in css.css_findings("p{x:url( ' javascript:a')} q{y:'javascript:b'} r{z:javascript:c}")] == ["scan.css.dangerous_scheme"] * 2


@pytest.mark.parametrize(("text", "host"), [
    ("Example.COM", ("domain", "example.com")), ("münchen.de", ("domain", "xn--mnchen-3ya.de")), ("0x7f.1", ("ipv4", "127.0.0.1")), ("2130706433", ("ipv4", "127.0.0.1")),
    ("[::1]", ("ipv6", "[::1]")), ("a b", None), ("1.2.3.999", None), ("ex%61mple.com", ("domain", "example.com")), ("ｅxample．com", ("domain", "example.com")), ("[x]", None),
])
def test_hosts(text, host):
    found = parse_host(text)
    assert (found and found[:2]) == host


def test_policy():
    assert parse_policy("").html.action_script == "remove"
    assert parse_policy("[subresources.zip_budget]\nmax_compression_ratio = 5").subresources.zip_budget.max_compression_ratio == 5.0
    for bad in ("[html]\nx = 1", "[html]\naction_script = 'explode'", "[budgets]\nmax_input_bytes = 'a'"):
        with pytest.raises(ValueError):
            parse_policy(bad)
    assert [r[1] for r in deny_rows(("10.1.2.3",))][-1] == 4
    with pytest.raises(ValueError):
        deny_rows(("nonsense",))


REFUSED = "refused"


@pytest.mark.parametrize(("page", "tags"), [
    # select: text-only elements count for some browsers only
    ("<select><xmp><script>a</script></xmp></select>", REFUSED), ("<select><title><b></title></select>", REFUSED), ("<select><style></style>", REFUSED), ("<select><plaintext><b>", REFUSED),
    ("<select><option><b></select><style><i></style>", "select option b style"), ("<select><input><style><i></style>", "select input style"), ("<select><textarea><i></textarea></select>", "select textarea"),
    ("<select><script><i></script></select><title><i></title>", "select script title"), ("<select><select><style><i></style>", "select select style"), ("<select><template></select></template><xmp><i></xmp>", REFUSED),
    ("<select><svg><![CDATA[><script>]]>", REFUSED), ("<select><svg><path></svg></select><p>", "select svg path p"),
    # frameset: all but frames is ignored after it
    ("<frameset><style><frame></style>", REFUSED), ("<frameset><frame><noframes><b></noframes></frameset>", "frameset frame noframes"), ("<frameset><svg><![CDATA[><frame>]]>", REFUSED), ("<style><frameset></style><title>", "style title"),
    # noscript: text where scripts run
    ("<noscript><b><i></i></b></noscript><style><u></style>", "noscript b i style"), ("<noscript><style></noscript><script></style>", REFUSED), ("<noscript><!-- </noscript><script> -->", REFUSED),
    ("<noscript><textarea></noscript><img></textarea>", REFUSED), ("<noscript><a title='</noscript><img>'>", REFUSED), ("<noscript><svg></noscript><![CDATA[><script>]]>", REFUSED), ("<noscript><select></noscript><p>", REFUSED),
    ("<noscript><style></style></noscript>", "noscript style"), ("<noscript><b>", "noscript b"), ("<noscript><noscript></noscript><b>", "noscript noscript b"), ("<noscript><!--</noscript>", REFUSED),
    # SVG and MathML
    ("<svg><style><b></style></svg>", "svg style b"), ("<svg><title><b></title></svg><title><b></title>", REFUSED), ("<svg><title>t</title><desc/><path/></svg><script><b></script>", "svg title desc path script"),
    ("<svg><![CDATA[<b>]]></svg><![CDATA[<b>]]>", "svg"), ("<svg><math></svg><![CDATA[><b>]]>", "svg math b"), ("<div><svg></div><![CDATA[><b>]]>", REFUSED), ("<h2><svg></h1><![CDATA[><b>]]>", REFUSED),
    ("<table><td><svg></tr><style><a title='</style><script>'>", REFUSED), ("<svg></path><style><b></style></svg>", "svg style b"), ("<svg><p><style><b></style>", REFUSED), ("<svg></p><style><b></style>", REFUSED),
    ("<svg><font><style><b></style></svg>", "svg font style b"), ("<svg><font size=1><style><b></style></svg>", REFUSED), ("<svg><desc><div></svg></div></desc><style><b></style>", REFUSED),
    ("<svg><foreignObject><div><style><b></style></div></foreignObject><style><b></style></svg>", "svg foreignobject div style style b"), ("<svg><foreignObject><p>a</foreignObject></svg><style></style>", REFUSED),
    ("<math><mi><style><b></style></mi></math>", "math mi style"), ("<math><mi><mglyph><style><b></style></mglyph></mi></math>", "math mi mglyph style b"), ("<math><style><b></style></math>", "math style b"),
    ("<math><annotation-xml><style><b></style>", REFUSED), ("<math><svg><desc><style><b></style></desc></svg></math>", "math svg desc style b"), ("<svg/><title><b></title>", "svg title"), ("<svg><plaintext><b>", "svg plaintext b"),
    ("<svg><title/><style><b></style></svg>", "svg title style b"), ("<svg><desc><svg><style><a></style></svg></desc></svg><style><a></style>", "svg desc svg style a style"),
    # template and text-only elements by themselves
    ("<template><style><b></style></template><p>", "template style p"), ("<template><svg></template><style><b></style>", REFUSED), ("<xmp><b></xmp><iframe><b></iframe><noembed><b></noembed><plaintext><b>", "xmp iframe noembed plaintext"),
])
def test_modes(page, tags):
    """Cases by hand for each mode of the tree builder that changes what the tokenizer does."""
    if tags == REFUSED:
        with pytest.raises(Unreadable):
            find_elements(page.encode())
    else:
        assert " ".join(e["tag"] for e in find_elements(page.encode())) == tags


def test_utf16_pages_are_unreadable():
    for encoding, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")):
        with pytest.raises(Unreadable):
            find_elements(mark + "<script>".encode(encoding))


@pytest.mark.parametrize("unit", ["<svg>", "<svg><x></y>", "<svg><noscript></noscript>", "<noscript>", "<svg><desc><div></x>", "<select>", "<math><mi>", "<svg></h1>", "<svg><title>"])
@pytest.mark.parametrize("before", ["", "<svg>" * 20_000])
def test_deep_markup_takes_linear_time(unit, before):
    began = time.process_time()
    try:
        find_elements((before + unit * (300_000 // len(unit))).encode())
    except Unreadable:
        pass
    assert time.process_time() - began < 6
