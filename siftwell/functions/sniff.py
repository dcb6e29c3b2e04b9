"""Type detection as column expressions: leading bytes, declared headers and extensions, and their contradiction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types and the file extension of each.
EXTENSION_OF = {
    "image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/tiff": "tiff",
    "text/html": "html", "text/css": "css", "text/javascript": "js", "application/pdf": "pdf", "application/zip": "zip", "application/xml": "xml",
    "audio/flac": "flac", "audio/mpeg": "mp3", "audio/wav": "wav", "video/x-msvideo": "avi", "video/mp4": "mp4",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/msword": "doc", "application/vnd.ms-excel": "xls", "application/vnd.ms-powerpoint": "ppt",
}
#: Further spellings of extensions, and those that declare no type.
MORE_EXTENSIONS = {"jpeg": "image/jpeg", "htm": "text/html", "mjs": "text/javascript", "tif": "image/tiff"}
UNDECLARED = ("doc", "xls", "ppt")
#: Content types of headers that stand for another one; further ones stand for themselves.
HEADER_ALIASES = {
    "image/jpg": "image/jpeg", "application/xhtml+xml": "text/html", "text/xml": "application/xml", "application/javascript": "text/javascript",
    "application/x-javascript": "text/javascript", "text/ecmascript": "text/javascript", "application/ecmascript": "text/javascript",
    "text/jscript": "text/javascript", "text/livescript": "text/javascript",
}
HEADERS = ("image/jpeg", "image/png", "image/gif", "image/webp", "image/svg+xml", "image/tiff", "text/html", "text/css", "text/javascript", "application/pdf", "application/zip", "application/xml")
#: Fixed values: (place, bytes in hexadecimal, type), in the order in which they are tried.
MAGIC = (
    (0, "FFD8FF", "image/jpeg"), (0, "89504E470D0A1A0A", "image/png"), (0, "474946383761", "image/gif"), (0, "474946383961", "image/gif"),
    (0, "3C21444F43545950452068746D6C3E", "text/html"), (0, "3C21646F63747970652068746D6C3E", "text/html"), (0, "255044462D", "application/pdf"),
    (0, "49492A00", "image/tiff"), (0, "4D4D002A", "image/tiff"), (0, "504B0304", "application/zip"), (0, "664C6143", "audio/flac"),
    (0, "494433", "audio/mpeg"), (0, "FFFB", "audio/mpeg"), (8, "57415645", "audio/wav"), (0, "41564920", "video/x-msvideo"),
    (4, "66747970", "video/mp4"), (0, "3C3F786D6C", "application/xml"), (0, "3C737667", "image/svg+xml"),
)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[key]


def sniffed(data: Column) -> Column:
    """The type by leading bytes (``data`` is binary), null if none fits. Office files in ZIP are told apart by ``office_kind``."""
    found = F.lit(None).cast("string")
    for place, magic, mime in reversed(MAGIC):
        found = F.when(F.substring(data, place + 1, len(magic) // 2) == F.unhex(F.lit(magic)), mime).otherwise(found)
    return found


def office_kind(first_folder: Column) -> Column:
    """The office type of a ZIP archive by the folder of its first telling entry (word, xl, ppt)."""
    office = {"word": "docx", "xl": "xlsx", "ppt": "pptx"}
    by_extension = {v: k for k, v in EXTENSION_OF.items()}
    return _lookup({k: by_extension[v] for k, v in office.items()}, first_folder)


def of_header(header: Column) -> Column:
    """The type that a content type header declares; parameters are dropped, unknown ones are null."""
    essence = F.lower(F.trim(F.split(header, ";")[0]))
    return _lookup(HEADER_ALIASES | {h: h for h in HEADERS}, essence)


def extension(name: Column) -> Column:
    """What follows the last point of the last path segment; a leading point begins no extension."""
    last = F.element_at(F.split(F.regexp_replace(name, r"[?#].*$", ""), "/"), -1)
    return F.lower(F.nullif(F.regexp_extract(last, r"^.+\.([^.]*)$", 1), F.lit("")))


def of_extension(name: Column) -> Column:
    known = {ext: mime for mime, ext in EXTENSION_OF.items() if ext not in UNDECLARED} | MORE_EXTENSIONS
    return _lookup(known, extension(name))


def declared(header: Column, name: Column) -> Column:
    """The declared type: by header, else by the extension of the name."""
    return F.coalesce(of_header(header), of_extension(name))


def effective(sniffed_type: Column, declared_type: Column) -> Column:
    return F.coalesce(sniffed_type, declared_type)


def contradicted(sniffed_type: Column, declared_type: Column) -> Column:
    return F.coalesce(sniffed_type != declared_type, F.lit(False))


def mismatch_text(sniffed_type: Column, declared_type: Column) -> Column:
    return F.when(contradicted(sniffed_type, declared_type), F.format_string("declared=%s sniffed=%s", declared_type, sniffed_type))
