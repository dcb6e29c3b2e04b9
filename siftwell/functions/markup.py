"""Where a page's start tags, attributes and removable contents are: one Arrow function from bytes to places.

It follows the states of the HTML standard's tokenizer and looks at every byte a bounded number of times, whatever the page. Of the
tree it builds what the tokenizer depends on (``Modes``): whether text-only elements and CDATA count, which SVG, MathML, select,
frameset, noscript and template decide. Where browsers differ there, or only the whole tree would tell, a page is unreadable; such
pages are refused. All rules about the tags are column expressions and joins, in ``operators.html``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import in_pieces

ATTRIBUTES = "array<struct<name:string,value:string,plain:string,start:int,end:int>>"
ELEMENTS = f"array<struct<tag:string,start:int,end:int,until:int,line:int,attrs:{ATTRIBUTES}>>"
# Element names with a meaning of their own to the tokenizer.
#: Elements whose content is text up to their end tag.
_TEXT_ONLY = {b"script", b"style", b"textarea", b"title", b"xmp", b"iframe", b"noembed", b"noframes"}
_VOID = {b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"source", b"track", b"wbr"}
#: Elements in which the rules of XML-like content hold, and those inside them whose start tags follow the rules of HTML.
_FOREIGN = {b"svg", b"math"}
_SVG_WAY_OUT = {b"foreignobject", b"desc", b"title"}
_MATH_WAY_OUT = {b"mi", b"mo", b"mn", b"ms", b"mtext"}
#: Start tags that end SVG and MathML; of font those with one of the attributes below.
_BREAK_OUT = {
    b"b", b"big", b"blockquote", b"body", b"br", b"center", b"code", b"dd", b"div", b"dl", b"dt", b"em", b"embed", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6", b"head", b"hr", b"i", b"img",
    b"li", b"listing", b"menu", b"meta", b"nobr", b"ol", b"p", b"pre", b"ruby", b"s", b"small", b"span", b"strike", b"strong", b"sub", b"sup", b"table", b"tt", b"u", b"ul", b"var"}
_FONT = {b"color", b"face", b"size"}
#: Elements that may be open without a start tag of their name, or be closed by an end tag of another one.
_IMPLIED = {b"html", b"head", b"body", b"colgroup", b"tbody", b"tr", b"h1", b"h2", b"h3", b"h4", b"h5", b"h6"}
#: Start tags that end a select where browsers knew only options in it.
_NOT_IN_SELECT = {b"input", b"keygen", b"textarea", b"select"}
_NAME = re.compile(rb"[A-Za-z][^\t\n\f\r />]*")
_BETWEEN = re.compile(rb"[\t\n\f\r /]*")
_BLANKS = re.compile(rb"[\t\n\f\r ]*")
_ATTRIBUTE_NAME = re.compile(rb"=?[^\t\n\f\r />=]*")
_UNQUOTED = re.compile(rb"[^\t\n\f\r >]*")
_COMMENT_END = re.compile(rb"--!?>")
_SCRIPT_MARK = re.compile(rb"(<!--)|(-->)|<(/?)script(?=[\t\n\f\r />])", re.I)


class Unreadable(ValueError):
    """A page whose tags can't be told for sure."""


#: Named references that are decoded, with the semicolon only.
NAMED = {"colon": ":", "Tab": "\t", "NewLine": "\n", "sol": "/", "semi": ";", "lpar": "(", "rpar": ")", "num": "#", "period": ".", "comma": ",", "quot": '"', "apos": "'", "amp": "&"}
_REFERENCE = re.compile(rf"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|({'|'.join(NAMED)});)")


def _tag_end(page: bytes, at: int) -> tuple[int, bool, list[tuple[int, int, bytes, bytes]]] | None:
    """From behind a tag's name: (its end, whether it closes itself, attributes as (start, end, name, value)); None if the page ends before."""
    found = []
    while True:
        begin = at
        at = _BETWEEN.match(page, at).end()
        if at >= len(page):
            return None
        if page[at] == 0x3E:
            return at + 1, at > begin and page[at - 1] == 0x2F, found
        name = _ATTRIBUTE_NAME.match(page, at)
        end = name.end()
        at = _BLANKS.match(page, end).end()
        value = b""
        if page[at : at + 1] == b"=":
            at = _BLANKS.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in (b'"', b"'") and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1 : end], end + 1
            else:
                value = _UNQUOTED.match(page, at)[0]
                at += len(value)
            end = at
        else:
            at = end
        found.append((begin, end, name[0], value))


def _script_end(page: bytes, at: int) -> int:
    """Where the end tag of a script that begins at ``at`` begins; the page's end without one.

    After ``<!--`` a script tag inside hides the next end tag, until ``-->``.
    """
    commented = hidden = False
    while m := _SCRIPT_MARK.search(page, at):
        at = m.end()
        if m[1]:
            commented, at = True, m.start() + 2  # the dashes count for an end as well
            if page[m.end() : m.end() + 1] == b">" or page[m.end() : m.end() + 2] == b"->":
                commented, at = False, m.end()
        elif m[2]:
            commented = hidden = False
        elif not m[3]:
            hidden = commented
        elif hidden:
            hidden = False
        else:
            return m.start()
    return len(page)


class Modes:
    """What the tree builder's modes mean for the tokenizer. Tags are told to it in order; ``is_text`` and ``is_cdata`` answer.

    * SVG and MathML: a stack of the open elements from the outermost root on. A start tag that breaks out pops it, an end tag pops to
      its element; inside a way out start tags follow HTML. What depends on HTML elements below the root leaves it ``unsure``.
    * select: older browsers ignore all but options in it, newer ones don't; so no text-only element may stand there.
    * frameset: if it is honoured, all but frames are ignored after it, to the end of the page.
    * noscript: text where scripts run, tags where not; both must come to the same tags after it.
    * template: its end tag pops what is open in it, and inside a select it hides the select's end.
    """

    def __init__(self) -> None:
        self.foreign: list[tuple[bytes, bytes, bool]] = []  # (name, svg, math or html, whether start tags in it follow HTML)
        self.places: dict[bytes, list[int]] = {}  # of each name its places there
        self.html: list[int] = []  # the places of HTML elements there
        self.unsure = self.select = self.stuck = self.frames = False
        self.broken = 0  # roots that were broken out of and whose end tag didn't come yet
        self.noscript: tuple | None = None  # where its text would end, and the state before it
        self.lowest = 0  # the fewest open elements there since the noscript began

    def push(self, name: bytes, kind: bytes, way_out: bool) -> None:
        self.places.setdefault(name, []).append(len(self.foreign))
        if kind == b"html":
            self.html.append(len(self.foreign))
        self.foreign.append((name, kind, way_out))

    def pop(self) -> None:
        name, kind, _ = self.foreign.pop()
        self.places[name].pop()
        if kind == b"html":
            self.html.pop()
        self.lowest = min(self.lowest, len(self.foreign))

    def state(self) -> tuple:
        return len(self.foreign), self.unsure, self.broken, self.select, self.stuck, self.frames

    def begin_noscript(self, text_end: int) -> None:
        self.noscript, self.lowest = (text_end, self.state()), len(self.foreign)

    def end_noscript(self, at: int) -> None:
        """Where ``at`` isn't before the end of the noscript's text: it must be the end tag, and all as it was at the begin."""
        if at != self.noscript[0] or self.state() != self.noscript[1] or self.lowest != len(self.foreign):
            raise Unreadable("noscript that ends elsewhere where scripts run")
        self.noscript = None

    def start(self, name: bytes, closed: bool, attributes: list[tuple[int, int, bytes, bytes]]) -> bool:
        """A start tag; whether it is an SVG or MathML element."""
        top = self.foreign[-1] if self.foreign else None
        if top and top[1] != b"html" and not (top[2] and not (top[1] == b"math" and name in (b"mglyph", b"malignmark"))):
            if name not in _BREAK_OUT and not (name == b"font" and any(key.lower() in _FONT for _, _, key, _ in attributes)):
                self.unsure = self.unsure or name == b"annotation-xml"  # HTML or not by its encoding
                if not closed:
                    self.push(name, top[1], name in (_SVG_WAY_OUT if top[1] == b"svg" else _MATH_WAY_OUT))
                return True
            self.break_out()
        if name in _FOREIGN:
            self.unsure = self.unsure or self.select or self.frames
            if not closed:
                self.push(name, name, False)
            return True
        if self.foreign and name not in _VOID:
            self.push(name, b"html", True)
        if name == b"frameset":
            self.frames = True
        elif name == b"template":
            self.stuck = self.stuck or self.select
        elif self.select and name in _NOT_IN_SELECT:
            self.select = self.stuck
        elif name == b"select":
            self.select = True
        return False

    def end(self, name: bytes, is_open: bool) -> None:
        """An end tag; ``is_open`` tells that an element of the name may be open somewhere."""
        if name == b"select":
            self.select = self.stuck
        if not self.foreign:
            self.broken -= self.broken > 0 and name in _FOREIGN
            return
        if self.foreign[-1][1] == b"html":
            if self.foreign[-1][0] == name:
                self.pop()
            else:
                self.unsure = True  # elements that are closed by others, or an end tag without effect
            return
        if name in (b"p", b"br"):
            self.break_out()
            return
        if (at := self.places.get(name)) and at[-1] > (self.html[-1] if self.html else -1):
            for _ in range(len(self.foreign) - at[-1]):
                self.pop()
        else:
            self.unsure = self.unsure or is_open or name in _IMPLIED

    def break_out(self) -> None:
        """SVG and MathML end at a tag that breaks out. Some parsers stay inside, so all is unsure until the roots' end tags come as well."""
        while self.foreign and self.foreign[-1][1] != b"html" and not self.foreign[-1][2]:
            self.broken += self.foreign[-1][0] in _FOREIGN
            self.pop()
        self.unsure = self.unsure or bool(self.foreign)

    def check_text(self, name: bytes) -> None:
        """A text-only element: raises Unreadable where it can't be told whether its content is text."""
        if self.unsure or self.broken or (self.select and name not in (b"script", b"textarea")) or (self.frames and name != b"noframes"):
            raise Unreadable("text where there may be tags")

    def is_cdata(self) -> bool:
        if not self.foreign and not self.broken:
            return False
        if self.unsure or self.broken or self.select or self.frames or (self.foreign[-1][2] and self.foreign[-1][1] != b"html"):
            raise Unreadable("CDATA where it may be none")
        return self.foreign[-1][1] != b"html"


def find_elements(page: bytes) -> list[dict]:
    """Every start tag, in order; ``until`` is where its element ends (after the end tag; the end of the page if there is none).

    An attribute's ``plain`` is its value with references decoded, None where that is the same. Raises Unreadable, for pages that
    a byte order mark gives another encoding as well.
    """
    if page.startswith((b"\xff\xfe", b"\xfe\xff")):
        raise Unreadable("UTF-16")
    found: list[dict] = []
    open_tags: dict[bytes, list[dict]] = {}
    ends: dict[bytes, int] = {}  # where an end tag of a text-only element was looked for in vain
    modes = Modes()
    at, line, counted = 0, 1, 0

    def text_end(name: bytes, at: int) -> int:
        """Where the end tag of a text-only element begins; the page's end without one."""
        if at >= ends.get(name, len(page) + 1):
            return len(page)
        close = re.compile(rb"</" + name + rb"(?=[\t\n\f\r />])", re.I).search(page, at)
        if not close:
            ends[name] = at
        return close.start() if close else len(page)

    while (at := page.find(b"<", at)) >= 0:
        begin, kind = at, page[at + 1 : at + 2]
        if modes.noscript and begin >= modes.noscript[0]:
            modes.end_noscript(begin)
        if kind == b"!":
            if page.startswith(b"<!--", at):
                if page.startswith((b">", b"->"), at + 4):
                    at = page.index(b">", at) + 1
                else:
                    end = _COMMENT_END.search(page, at + 4)
                    at = end.end() if end else len(page)
            elif page.startswith(b"<![CDATA[", at) and modes.is_cdata():
                end = page.find(b"]]>", at)
                at = end + 3 if end >= 0 else len(page)
            else:
                end = page.find(b">", at)
                at = end + 1 if end >= 0 else len(page)
        elif kind == b"?" or (kind == b"/" and not page[at + 2 : at + 3].isalpha()):
            end = page.find(b">", at)
            at = end + 1 if end >= 0 else len(page)
        elif kind == b"/":
            name = _NAME.match(page, at + 2)
            tag = _tag_end(page, name.end())
            if tag is None:
                at = len(page)
                break
            at, name = tag[0], name[0].lower()
            modes.end(name, bool(open_tags.get(name)))
            if open_tags.get(name):
                open_tags[name].pop()["until"] = at
        elif name := _NAME.match(page, at + 1):
            tag = _tag_end(page, name.end())
            if tag is None:
                at = len(page)
                break
            at, closed, attributes = tag
            line += page.count(b"\n", counted, begin)
            counted, name = begin, name[0].lower()
            attrs, seen = [], set()
            for start, end, key, value in attributes:
                if (key := key.lower()) not in seen:
                    seen.add(key)
                    text = value.decode("utf-8", "replace")
                    plain = decode_references(text) if b"&" in value else text
                    attrs.append({"name": key.decode("utf-8", "replace"), "value": text, "plain": plain if plain != text else None, "start": start, "end": end})
            foreign = modes.start(name, closed, attributes)
            whole = name in _VOID or (closed and foreign)
            element = {"tag": name.decode("utf-8", "replace"), "start": begin, "end": at, "until": at if whole else len(page), "line": line, "attrs": attrs}
            found.append(element)
            if name == b"noscript" and not modes.noscript and (end := text_end(name, at)) < len(page):
                modes.begin_noscript(end)
            if name in _TEXT_ONLY or name == b"plaintext":
                modes.check_text(name)
                if not foreign and not whole:
                    at = len(page) if name == b"plaintext" else _script_end(page, at) if name == b"script" else text_end(name, at)
            if not whole:
                open_tags.setdefault(name, []).append(element)
        else:
            at += 1
    if modes.noscript:
        modes.end_noscript(len(page))
    return found


def _elements(pages: pa.Array) -> pa.Array:
    """The start tags of each page, null for unreadable ones."""
    attr = pa.struct([("name", pa.string()), ("value", pa.string()), ("plain", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.list_(pa.struct([("tag", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("until", pa.int32()), ("line", pa.int32()), ("attrs", pa.list_(attr))]))

    def found(some: list[bytes | None]) -> list:
        rows = []
        for page in some:
            try:
                rows.append(find_elements(page or b""))
            except Unreadable:
                rows.append(None)
        return rows

    return in_pieces(kind, found, pages)


def decode_references(text: str) -> str:
    """Character references decoded in one pass: numbers with or without a semicolon, a few names with it; others stay."""
    def one(m: re.Match) -> str:
        if m[3]:
            return NAMED[m[3]]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return _REFERENCE.sub(one, text)


def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else decode_references(t) for t in texts.to_pylist()], pa.string())


def dangerous_scheme(plain: Column) -> Column:
    """Whether a value, its references decoded, is a script or data URL once blanks and control characters are out."""
    bare = F.lower(F.regexp_replace(plain, r"[\s\p{Z}\p{Cc}]+", ""))
    return F.coalesce(bare.startswith("javascript:") | bare.startswith("data:"), F.lit(False))


def _splice(pages: list[bytes | None], edits: list) -> list[bytes | None]:
    rows = []
    for page, changes in zip(pages, edits, strict=True):
        out, at = [], 0
        for e in changes or []:
            if e["start"] >= at:
                out += [page[at : e["start"]], e["text"].encode()]
                at = e["end"]
        rows.append(None if page is None else b"".join(out) + page[at:])
    return rows


def _spliced(pages: pa.Array, edits: pa.Array) -> pa.Array:
    """Pages with edits (start, end, text) applied, in order; an edit inside an earlier one is dropped."""
    return in_pieces(pa.binary(), _splice, pages, edits)


def fragment(text: Column, most: int = 200) -> Column:
    """At most ``most`` bytes of a text, cut between characters."""
    data = F.encode(text, "UTF-8")
    head = F.make_valid_utf8(F.substring(data, 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(head, "�+$", ""))


def elements(pages: Column) -> Column:
    return F.arrow_udf(_elements, ELEMENTS)(pages)


def decoded(texts: Column) -> Column:
    return F.arrow_udf(_decoded, "string")(texts)


def spliced(pages: Column, edits: Column) -> Column:
    return F.arrow_udf(_spliced, "binary")(pages, edits)
