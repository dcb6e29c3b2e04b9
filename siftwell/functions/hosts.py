"""Host names: the one step of URL parsing that needs Python (IDNA and numbers in hosts)."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "kind string, ascii string, unicode string, digits string"
_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^`{|}%\x7f]")
_NUMBER = re.compile(r"(0x[0-9a-f]*|\d+)")

def suffixes(host: Column) -> Column:
    """The name itself and each parent domain, the longest first; a root point is dropped."""
    labels = F.split(F.rtrim(host, F.lit(".")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def parse_host(text: str) -> tuple[str, str, str, str | None] | None:
    """(kind, ascii, unicode, digits) of a host as written in a URL with a special scheme, or None if it is invalid."""
    if text.startswith("["):
        try:
            address = ipaddress.IPv6Address(text[1:-1]) if text.endswith("]") else None
        except ValueError:
            address = None
        return address and ("ipv6", f"[{address.compressed}]", f"[{address.compressed}]", f"{int(address):032x}")
    text = unicodedata.normalize("NFKC", unquote(text, errors="strict")).lower().replace("。", ".").replace("­", "")
    try:
        ascii_host = text if text.isascii() else ".".join(x.encode("idna").decode() if x else "" for x in text.split("."))
    except UnicodeError:
        return None
    if not ascii_host or _FORBIDDEN.search(ascii_host):
        return None
    labels = ascii_host.removesuffix(".").split(".")
    if _NUMBER.fullmatch(labels[-1]):
        try:
            numbers = [int(x, 16) if x.startswith("0x") and len(x) > 2 else 0 if x == "0x" else int(x, 8) if x.startswith("0") and len(x) > 1 else int(x) for x in labels]
        except ValueError:
            return None
        if len(numbers) > 4 or any(x > 255 for x in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(x << 8 * (3 - k) for k, x in enumerate(numbers[:-1]))
        return "ipv4", str(ipaddress.IPv4Address(value)), str(ipaddress.IPv4Address(value)), f"{value:032x}"
    try:
        shown = ".".join(x.encode().decode("idna") if x.startswith("xn--") else x for x in ascii_host.split("."))
    except UnicodeError:
        shown = ascii_host
    return "domain", ascii_host, shown, None


def _parsed_host(hosts: pa.Array) -> pa.Array:
    """A struct (kind, ascii, unicode, digits) for each host, null for invalid ones."""
    rows = []
    for h in hosts.to_pylist():
        try:
            found = parse_host(h) if h else None
        except (UnicodeError, ValueError):
            found = None
        rows.append(dict(zip(("kind", "ascii", "unicode", "digits"), found, strict=True)) if found else None)
    return pa.array(rows, pa.struct([(n, pa.string()) for n in ("kind", "ascii", "unicode", "digits")]))


def parsed_host(hosts: Column) -> Column:
    return F.arrow_udf(_parsed_host, HOST)(hosts)
