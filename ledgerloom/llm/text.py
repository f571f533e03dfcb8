"""Vectorised work on the UTF-8 bytes of whole Arrow batches, shared by the operators of this subpackage.

A token is a maximal run of bytes other than the six ASCII white-space characters. Nulls count as empty texts.
Hashes are 64-bit polynomials over bytes, and over token hashes for windows, taken by prefix sums modulo 2**64: an odd
base has an inverse there, so the hash of any range is one subtraction and one product (Rabin-Karp without a loop).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
BLOCK = 1 << 17
_MASK = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WINDOW_BASE = np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
try:  # glibc only
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim
except (OSError, AttributeError):
    _LIBC = None
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, n of each; those up to BLOCK are kept."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size == BLOCK + 1:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, add: int = 0) -> np.ndarray:
    """Hash of each range of values (plus add); starts and ends both rise. BLOCK values at a time, so memory is bounded."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(base, BLOCK + 1)
    sums = np.zeros(BLOCK + 1, np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        if ends[i] - a > BLOCK:  # one long range, piece by piece
            total, scale = 0, 1
            for c in range(a, int(ends[i]), BLOCK):
                part = values[c : min(c + BLOCK, int(ends[i]))].astype(np.uint64) + np.uint64(add)
                total += scale * int((part * up[: len(part)]).sum(dtype=np.uint64))
                scale = scale * pow(int(base), BLOCK, 1 << 64) & _MASK
            out[i] = total & _MASK
        else:
            part = values[a : int(ends[j - 1])].astype(np.uint64)
            if add:
                part += np.uint64(add)
            part *= up[: len(part)]
            np.cumsum(part, dtype=np.uint64, out=sums[1 : len(part) + 1])
            at = starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[at]) * down[at]
        i = j
    return mix(out)


def release() -> None:
    """Give memory that a task has freed back to the system: workers are kept for the next stage, whose needs differ."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, end to end, and the n + 1 offsets of the texts in them."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of at most so many whole rows of about limit bytes of text; a longer text comes alone. Gives rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, min(row + rows, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1))
            yield batch.slice(row, stop - row), data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
            row = stop
    release()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of all tokens, and the n + 1 offsets of the texts in the list of tokens."""
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _range_hashes(data, starts, ends, _BASE, 1)


def windows(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens of all windows of width tokens that lie in one text, and the number of the text of each."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    return first, rows


def window_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    return _range_hashes(hashes, first, first + width, _WINDOW_BASE)


def unions(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal unions of the intervals of each key; intervals that touch are joined."""
    if not len(keys):
        return keys, starts, ends
    order = np.lexsort((starts, keys))
    keys, starts, ends = keys[order], starts[order], ends[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    span = int(ends.max()) + 1
    group = np.cumsum(fresh) - 1
    reach = np.maximum.accumulate(ends + group * span) - group * span
    fresh[1:] |= starts[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    return keys[heads], starts[heads], reach[np.append(heads[1:], len(keys)) - 1]
