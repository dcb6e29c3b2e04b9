"""Content scanners for single files: small functions from bytes to (rule, offset) findings, behind one Arrow function.

Which scanner a row needs is decided by column expressions before; see ``scan``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrow import in_pieces
from ..functions.css import rewritten_sheet, sheet_places
from ..policy import Policy, XmlBudget, ZipBudget

FINDINGS = "array<struct<rule:string,category:string,offset:bigint,line:bigint>>"


def zip_entries(data: bytes, most: int = 65_535) -> list[tuple[bytes, int, int, int]] | None:
    """(name, offset of the name, packed size, size) of an archive's entries by its central directory; None if that is broken."""
    end = data.rfind(b"PK\5\6", max(0, len(data) - 22 - 65535))
    try:
        count, = struct.unpack_from("<H", data, end + 10) if end >= 0 else (-1,)
        if not 0 <= count <= most:
            return None
        at, = struct.unpack_from("<I", data, end + 16)
        out = []
        for _ in range(count):
            if data[at : at + 4] != b"PK\1\2":
                return None
            packed, size, *lengths = struct.unpack_from("<IIHHH", data, at + 20)
            name = data[at + 46 : at + 46 + lengths[0]]
            if len(name) < lengths[0]:
                return None
            out.append((name, at + 46, packed, size))
            at += 46 + sum(lengths)
    except struct.error:
        return None
    return out


def zip_risk(data: bytes, budget: ZipBudget) -> int | None:
    """Where an archive exceeds its budget; a broken one counts as exceeding at 0."""
    entries, total = zip_entries(data, budget.max_entry_count), 0
    if entries is None:
        return 0
    for _, at, packed, size in entries:
        total += size
        if size / max(packed, 1) > budget.max_compression_ratio:
            return at
        if total > budget.max_total_uncompressed_bytes:
            return 0
    return None


def zip_folder(data: bytes) -> str | None:
    """The folder (word, xl, ppt) of the first entry that tells an office file."""
    return next((n.split(b"/")[0].decode() for n, *_ in zip_entries(data) or [] if n.startswith((b"word/", b"xl/", b"ppt/"))), None)


_ENTITY = re.compile(rb"""<!ENTITY\s+([^\s]+)\s+(?!SYSTEM|PUBLIC)(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(rb"&([^;&]*);")


def xml_risk(data: bytes, budget: XmlBudget) -> bool:
    """Whether an internal entity expands beyond its budget, nests too deeply or refers to itself. Each entity is measured once."""
    entities = {m[1]: m[2] if m[2] is not None else m[3] for m in _ENTITY.finditer(data)}
    if len(entities) > budget.max_entity_count:
        return True
    measured: dict[bytes, tuple[int, int]] = {}  # size and height
    for root in entities:
        stack, open_names = [root], set()
        while stack:
            name = stack[-1]
            uses = [x for x in _REFERENCE.findall(entities[name]) if x in entities]
            waiting = [x for x in uses if x not in measured]
            if name in measured:
                stack.pop()
            elif waiting:
                open_names.add(name)
                if open_names & set(waiting):
                    return True
                stack += waiting[:1]
            else:
                own = len(_REFERENCE.sub(b"", entities[name])) + sum(measured[x][0] for x in uses)
                height = 1 + max((measured[x][1] for x in uses), default=-1)
                if own > budget.max_expanded_size or height > budget.max_entity_depth:
                    return True
                measured[name] = (own, height)
                open_names.discard(name)
                stack.pop()
    return False


def _jpeg_size(d: bytes) -> tuple[int, int, int]:
    at = 2
    while True:
        if d[at] != 0xFF or d[at + 1] == 0xFF:
            at += 1
        elif d[at + 1] == 1 or 0xD0 <= d[at + 1] <= 0xD9:
            at += 2
        elif 0xC0 <= d[at + 1] <= 0xCF and d[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", d, at + 5)
            return width, height, at + 5
        else:
            length, = struct.unpack_from(">H", d, at + 2)
            if length < 2:
                raise ValueError
            at += 2 + length


def _webp_size(d: bytes) -> tuple[int, int, int]:
    kind = d[12:16] if d[8:12] == b"WEBP" else b""
    if kind == b"VP8X":
        return 1 + int.from_bytes(d[24:27], "little"), 1 + int.from_bytes(struct.unpack_from("3s", d, 27)[0], "little"), 24
    if kind == b"VP8L" and d[20] == 0x2F:
        bits, = struct.unpack_from("<I", d, 21)
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 21
    if kind == b"VP8 " and d[23:26] == b"\x9d\x01\x2a":
        return *(x & 0x3FFF for x in struct.unpack_from("<HH", d, 26)), 26
    raise ValueError


def _tiff_size(d: bytes) -> tuple[int, int, int]:
    e = {b"II": "<", b"MM": ">"}[d[:2]]
    at, = struct.unpack_from(f"{e}I", d, 4)
    count, = struct.unpack_from(f"{e}H", d, at)
    found, offset = {}, at
    for k in range(count):
        tag, kind = struct.unpack_from(f"{e}HH", d, at + 2 + 12 * k)
        if tag in (256, 257) and kind in (3, 4):
            found[tag], = struct.unpack_from(f"{e}{'HI'[kind - 3]}", d, at + 10 + 12 * k)
            offset = at + 10 + 12 * k if tag == 256 else offset
    return found[256], found[257], offset


_SIZES = {
    "image/png": lambda d: (*struct.unpack_from(">II", d, 16), 16) if d[12:16] == b"IHDR" else None,
    "image/gif": lambda d: (*struct.unpack_from("<HH", d, 6), 6),
    "image/jpeg": _jpeg_size, "image/webp": _webp_size, "image/tiff": _tiff_size,
}


def image_size(data: bytes, mime: str) -> tuple[int, int, int] | None:
    """(width, height, offset of the size) by an image's headers alone; None if they don't tell."""
    try:
        return _SIZES[mime](data)
    except (KeyError, IndexError, ValueError, struct.error):
        return None


def tiff_break(data: bytes) -> tuple[int, int] | None:
    """(where the chain of directories is broken or returns to itself, the link field that leads there); None for a sound file."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order or len(data) < 8:
        return (4 if order else 0), 4
    field, seen = 4, set()
    while True:
        at, = struct.unpack_from(f"{order}I", data, field)
        if at == 0:
            return None
        if at in seen or at + 2 > len(data):
            return at, field
        seen.add(at)
        end = at + 2 + 12 * struct.unpack_from(f"{order}H", data, at)[0]
        if end > len(data):
            return at + 2, field
        if end + 4 > len(data):
            return end, field
        field = end


def rewritten_tiff(data: bytes) -> bytes:
    """The file with its chain of directories ended before the break."""
    broken = tiff_break(data)
    return data if broken is None or len(data) < 8 or data[:2] not in (b"II", b"MM") else data[: broken[1]] + bytes(4) + data[broken[1] + 4 :]


# Names in a PDF that start something.
_PDF_ACTIVE = {b"JavaScript", b"JS", b"OpenAction", b"AA", b"Launch"}
_PDF_NAME = re.compile(rb"/[^\x00\t\n\f\r ()<>\[\]{}/%]+")
_PDF_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_PDF_KEY = re.compile(rb"/(?:JavaScript|JS|OpenAction|AA|Launch)(?![A-Za-z0-9])")
#: An object stream that unpacks to more than this counts as active content, and is emptied where content is rewritten.
PDF_UNPACKED = 64 << 20


def _is_active(name: bytes) -> bool:
    """Whether a name (with its slash) starts something, however its letters are escaped."""
    if _PDF_KEY.match(name):
        return True
    return b"#" in name and _PDF_ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), name[1:]) in _PDF_ACTIVE


def pdf_key(data: bytes) -> int | None:
    if (found := _PDF_KEY.search(data)) is None and b"#" not in data:
        return None
    escaped = next((m.start() for m in _PDF_NAME.finditer(data) if b"#" in m[0] and _is_active(m[0])), None) if b"#" in data else None
    return min((x for x in (found and found.start(), escaped) if x is not None), default=None)


def _object_streams(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, body) of the packed object streams."""
    done = 0
    for m in _PDF_NAME.finditer(data):
        if m.start() >= done and (_PDF_ESCAPE.sub(lambda x: bytes([int(x[1], 16)]), m[0]) if b"#" in m[0] else m[0]) == b"/ObjStm":
            begin = data.find(b"stream", m.end())
            if begin < 0:
                return
            done = begin
            begin += 6
            begin += 2 if data.startswith(b"\r\n", begin) else 1 if data.startswith((b"\n", b"\r"), begin) else 0
            end = data.find(b"endstream", begin)
            yield m.start(), data[begin : end if end >= 0 else len(data)]


def pdf_active(data: bytes) -> int | None:
    """Where a PDF has a key that starts something, in plain objects or in packed object streams (then 0).

    Object streams are unpacked to their end, piece by piece; one that can't be read, or that unpacks to over PDF_UNPACKED, counts.
    """
    if (at := pdf_key(data)) is not None:
        return at
    left = PDF_UNPACKED
    for _, body in _object_streams(data):
        reader, tail = zlib.decompressobj(), b""
        try:
            while not reader.eof and (body or tail):
                plain = reader.decompress(body, 1 << 20)
                body = reader.unconsumed_tail
                left -= len(plain)
                if pdf_key(tail + plain) is not None or left < 0:
                    return 0
                if not plain and not body:
                    break
                tail = plain[-256:]
        except zlib.error:
            return 0
    return None


_PDF_BODY = re.compile(rb"stream\r?\n(.*?)endstream", re.S)


def _without_keys(data: bytes) -> bytes:
    """Keys that start something get a name of the same length that means nothing, so that all offsets stay."""
    return _PDF_NAME.sub(lambda m: b"/" + b"X" * (len(m[0]) - 1) if _is_active(m[0]) else m[0], data)


def _packed_without_keys(body: bytes, packed_objects: bool) -> bytes:
    """A stream's body in the same length: packed objects without keys (emptied, if they don't fit), other packed data as it is."""
    reader = zlib.decompressobj()
    try:
        plain = reader.decompress(body, PDF_UNPACKED)
    except zlib.error:
        return zlib.compress(b"")[: len(body)].ljust(len(body), b"\n") if packed_objects else _without_keys(body)
    if not packed_objects:
        return body if reader.eof and len(reader.unused_data) <= 2 else _without_keys(body)
    whole = not reader.unconsumed_tail
    if whole and pdf_key(plain) is None:
        return body
    packed = zlib.compress(_without_keys(plain), 9) if whole else b""
    if not packed or len(packed) > len(body):
        packed = zlib.compress(b"")
    return packed[: len(body)].ljust(len(body), b"\n")


def rewritten_pdf(data: bytes) -> bytes:
    """The file with the keys that start something renamed, in plain objects and in packed object streams; its length stays."""
    out, at = [], 0
    for m in _PDF_BODY.finditer(data):
        head = data[at : m.start(1)]
        objects = any(_PDF_ESCAPE.sub(lambda x: bytes([int(x[1], 16)]), n[0]) == b"/ObjStm" for n in _PDF_NAME.finditer(head, max(head.rfind(b"endobj"), 0)))
        out += [_without_keys(head), _packed_without_keys(m[1], objects)]
        at = m.end(1)
    return b"".join([*out, _without_keys(data[at:])])


def scan_file(data: bytes, mime: str | None, policy: Policy) -> list[tuple[str, str, int]]:
    """(rule, category, offset) for one file: what could exhaust a reader first, and then nothing else; else active content."""
    sub = policy.subresources
    if mime == "application/xml" and xml_risk(data, sub.xml_budget):
        return [("scan.xml.entity_expansion", "dos", 0)]
    if mime == "application/zip":
        if (at := zip_risk(data, sub.zip_budget)) is not None:
            return [("scan.zip.bomb_risk", "dos", at)]
        macro = [at for name, at, *_ in zip_entries(data, sub.zip_budget.max_entry_count) or [] if name.endswith(b"vbaProject.bin")]
        return [("scan.zip.macro_present", "active_content", macro[0])] if macro else []
    if size := image_size(data, mime or ""):
        if size[0] * size[1] > policy.budgets.max_image_pixels:
            return [("scan.image.dimensions", "dos", size[2])]
    if mime == "text/javascript":
        return [("scan.script.active_type", "active_content", 0)]
    if mime == "application/pdf" and (at := pdf_active(data)) is not None:
        return [("scan.pdf.active_content", "active_content", at)]
    if mime == "image/tiff" and (broken := tiff_break(data)):
        return [("scan.tiff.structural_risk", "active_content", broken[0])]
    if mime == "application/xml":
        at = next((p for p in map(data.find, (b"<!ENTITY", b"SYSTEM", b"PUBLIC")) if p >= 0), None)
        return [] if at is None else [("scan.xml.xxe", "active_content", at)]
    if mime == "text/css":
        return [(rule, "active_content", at) for rule, at in sheet_places(data)]
    return []


#: Types whose files a Python scanner reads; PNG, GIF and scripts are told by expressions.
SCANNED = ("application/xml", "application/zip", "image/jpeg", "image/webp", "image/tiff", "application/pdf", "text/css")


def plain_findings(data: Column, mime: Column, policy: Policy) -> Column:
    """The findings of PNG, GIF and script files."""
    number = lambda at, n: F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("bigint")
    png = (mime == "image/png") & (F.substring(data, 13, 4) == F.lit(b"IHDR")) & (F.octet_length(data) >= 24)
    gif = (mime == "image/gif") & (F.octet_length(data) >= 10)
    pixels = F.when(png, number(16, 4) * number(20, 4)).when(gif, (number(6, 1) + 256 * number(7, 1)) * (number(8, 1) + 256 * number(9, 1)))
    offset = F.when(png, 16).otherwise(6)
    line = 1 + F.size(F.filter(F.sequence(F.lit(1), offset), lambda i: F.substring(data, i, F.lit(1)) == F.lit(b"\n")))
    one = lambda rule, category, at, line: F.array(F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), at.cast("bigint").alias("offset"), line.cast("bigint").alias("line")))
    return (F.when(pixels > policy.budgets.max_image_pixels, one("scan.image.dimensions", "dos", offset, line))
            .when((mime == "text/javascript") & data.isNotNull(), one("scan.script.active_type", "active_content", F.lit(0), F.lit(1))).otherwise(F.array().cast(FINDINGS)))


def scan(data: Column, mime: Column, policy: Policy) -> Column:
    """The findings of each row; only files of the SCANNED types leave the JVM with their bytes."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("category", pa.string()), ("offset", pa.int64()), ("line", pa.int64())]))

    def scanned(blobs: list[bytes | None], mimes: list[str | None]) -> list:
        rows = []
        for blob, m in zip(blobs, mimes, strict=True):
            out, line, counted = [], 1, 0
            for rule, category, at in scan_file(blob, m, policy) if blob is not None else []:
                line += blob.count(b"\n", counted, at) if at >= counted else 1 - line + blob.count(b"\n", 0, at)
                counted = at
                out.append({"rule": rule, "category": category, "offset": at, "line": line})
            rows.append(out)
        return rows

    @F.arrow_udf(FINDINGS)
    def found(blobs: pa.Array, mimes: pa.Array) -> pa.Array:
        return in_pieces(kind, scanned, blobs, mimes)

    return F.when(mime.isin(*SCANNED), found(F.when(mime.isin(*SCANNED), data), mime)).otherwise(plain_findings(data, mime, policy))


REWRITERS = {"text/css": rewritten_sheet, "image/tiff": rewritten_tiff, "application/pdf": rewritten_pdf}


def _rewritten(blobs: pa.Array, mimes: pa.Array) -> pa.Array:
    return in_pieces(pa.binary(), lambda bs, ms: [None if b is None else REWRITERS[m](b) for b, m in zip(bs, ms, strict=True)], blobs, mimes)


def rewritten(data: Column, mime: Column, found: Column) -> Column:
    """The bytes without what was ``found``, where a rewriter exists; all other rows keep theirs and never leave the JVM."""
    here = found & F.coalesce(mime.isin(*REWRITERS), F.lit(False))
    return F.when(here, F.arrow_udf(_rewritten, "binary")(F.when(here, data), mime)).otherwise(data)


def _telling_folder(blobs: pa.Array) -> pa.Array:
    """The office folder of archives; see ``functions.sniff.office_kind``."""
    return in_pieces(pa.string(), lambda some: [None if b is None else zip_folder(b) for b in some], blobs)


def telling_folder(blobs: Column) -> Column:
    return F.arrow_udf(_telling_folder, "string")(blobs)
