"""Arrow functions over long columns: a batch is worked on in pieces, so that Python objects of a few rows exist at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the first column that are worked on at once.
PIECE = 1 << 20


def in_pieces(kind: pa.DataType, work: Callable[..., list], *columns: pa.Array) -> pa.Array:
    """``work`` of (lists of) the columns' rows, piece by piece; it gives a list with a value for each row."""
    first = columns[0].combine_chunks() if isinstance(columns[0], pa.ChunkedArray) else columns[0]
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(first), 0)).astype(np.int64))
    out, begin = [], 0
    while begin < len(first):
        limit = (ends[begin - 1] if begin else 0) + PIECE
        end = max(begin + 1, int(np.searchsorted(ends, limit, "right")))
        out.append(pa.array(work(*[c.slice(begin, end - begin).to_pylist() for c in columns]), kind))
        begin = end
    return pa.concat_arrays(out) if out else pa.array([], kind)
