"""Arrow columns worked through a slice of rows at a time: a worker holds the objects of a slice, never of a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS = 1 << 20, 512


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of SLICE_ROWS or SLICE_BYTES at most, a row at least; one empty run of no rows."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        n = int(np.searchsorted(ends, before + SLICE_BYTES, "right")) - start
        n = max(1, min(n, SLICE_ROWS))
        yield start, n
        start += n
    if not len(ends):
        yield 0, 0


def mapped(kind: pa.DataType, f: Callable, *columns: pa.Array) -> Iterator[pa.Array]:
    """f of each row of the columns, of which the first decides the slices; null where the first is null."""
    for start, n in slices(columns[0]):
        rows = zip(*(c.slice(start, n).to_pylist() for c in columns))
        yield pa.array([None if x is None else f(x, *more) for x, *more in rows], kind)
