"""Joining references to addresses."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Addresses that joining to a base of the same form leaves as they are.
PLAIN = r"^https?://[A-Za-z0-9.-]+(/[A-Za-z0-9._~/-]*)?$"


def _absolute(raws: pa.Array, bases: pa.Array) -> pa.Array:
    plain = pc.and_(*[pc.fill_null(pc.match_substring_regex(x, PLAIN), False) for x in (raws, bases)])
    if plain.true_count == len(plain):
        return raws
    return pc.replace_with_mask(raws, pc.invert(plain), _joined(raws.filter(pc.invert(plain)), bases.filter(pc.invert(plain))))


def _joined(raws: pa.Array, bases: pa.Array) -> pa.Array:
    out = []
    for raw, base in zip(raws.to_pylist(), bases.to_pylist(), strict=True):
        text = (raw or "").strip()
        try:
            joined = urldefrag(urljoin(base or "", text)).url
        except ValueError:
            joined = ""
        out.append(joined if text and not text.startswith("#") and joined.lower().startswith(("http://", "https://")) else None)
    return pa.array(out, pa.string())


def absolute(raw: Column, base: Column) -> Column:
    """A reference joined to an absolute base URL; null if it is empty, a fragment, or neither http nor https."""
    return F.arrow_udf(_absolute, "string")(raw, base)
