"""Operator 3: best-fit packing of documents into sequences, after Martello and Toth's dominance reduction.

A document of n tokens gives n // capacity pieces that fill a sequence each, and a rest. Rests are dealt to groups by a
hash of the id (about `group_rests` in each, so their number follows the table's) and each group is packed alone. The
reduction takes sizes in falling order. With j the largest left and s its most that fits beside it: j goes alone where
nothing fits; with s where both fill the sequence, or where no two others fit with j; with s also where two fit but the
best two together aren't larger than s; and with those two where s is the larger of them and no other two come close.
Each set fixed so dominates all that j could be packed with, so an optimal packing of what is left, with the sets, is
optimal. The rest is packed by best fit in falling order. Sizes are integers, so both work on counts of sizes.

Results for edge cases: null, empty and white-space texts have no token and give no row. Rows without an id are left
out. Rows that share an id are packed one by one; equal sizes go by (id, piece). An empty table gives an empty result.
Sequences never hold more than `capacity` tokens and no token is dropped. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import keyed

CAPACITY, GROUP_RESTS = 2048, 50_000
_SCHEMA = "bin_id string, position int, doc_id long, piece int, start_token long, n_tokens int, fixed boolean"


def _largest(counts: list[int], top: int) -> int:
    while top > 0 and not counts[top]:
        top -= 1
    return top


def reduce(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Sets of sizes that the reduction fixes, and the sizes that are left, both in falling order of the largest."""
    counts, fixed = [0] * (capacity + 1), []
    for s in sizes:
        counts[s] += 1
    bits = 0
    for s, n in enumerate(counts):
        if n:
            bits |= 1 << s

    def take(s: int) -> None:
        nonlocal bits
        counts[s] -= 1
        if not counts[s]:
            bits &= ~(1 << s)

    def most(limit: int) -> int:
        return (bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 else -1

    def least(many: int) -> int:
        """Sum of the `many` smallest sizes, or more than the capacity where there are fewer."""
        total, b = 0, bits
        while many and b:
            s = (b & -b).bit_length() - 1
            n = min(many, counts[s])
            total, many, b = total + n * s, many - n, b & (b - 1)
        return total if not many else capacity + 1

    def best_two(room: int) -> tuple[int, int]:
        """The two sizes of largest sum within room, the larger one as large as can be."""
        found = (0, 0)
        b = bits & ((1 << (room + 1)) - 1)
        while b:
            x = b.bit_length() - 1
            b ^= 1 << x
            if 2 * x <= sum(found):
                break
            y = most(min(room - x, x))
            if y == x and counts[x] < 2:
                y = most(min(room - x, x - 1))
            if y > 0 and x + y > sum(found):
                found = (x, y)
        return found

    def give_back(s: int) -> None:
        nonlocal bits
        counts[s] += 1
        bits |= 1 << s

    top = capacity
    while (top := _largest(counts, top)) > 0:
        take(top)
        room = capacity - top
        s = most(room)
        if s < 1:
            fixed.append([top])
        elif s == room or least(2) > room:
            take(s)
            fixed.append([top, s])
        elif least(3) > room:
            a, b = best_two(room)
            if s >= a + b:
                take(s)
                fixed.append([top, s])
            elif s == a and _close(counts, a, b, room):
                take(a)
                take(b)
                fixed.append([top, a, b])
            else:
                give_back(top)
                top -= 1
        else:
            give_back(top)
            top -= 1
    return fixed, [s for s in range(capacity, 0, -1) for _ in range(counts[s])]


def _close(counts: list[int], a: int, b: int, room: int) -> bool:
    """Whether a and b are at most two places apart in falling order, or the two before b don't fit together."""
    before: list[int] = []  # the two sizes that come before b, from a on
    between = counts[a] - 1 + sum(counts[b + 1 : a]) if a > b else 0
    if between <= 1:
        return True
    s = b + 1
    while len(before) < 2 and s <= a:
        before += [s] * min(counts[s], 2 - len(before))
        s += 1
    return sum(before) > room


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of sizes, each size (in falling order) in the fullest bin with room, the oldest of those."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    taken = [0] * (capacity + 1)  # how many of each list are gone
    bits = 0
    for s in sorted(sizes, reverse=True):
        b = bits >> s
        if b:
            room = s + (b & -b).bit_length() - 1
            at = by_room[room][taken[room]]
            taken[room] += 1
            if taken[room] == len(by_room[room]):
                by_room[room], taken[room] = [], 0
                bits &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(s)
        if room > s:
            by_room[room - s].append(at)
            bits |= 1 << (room - s)
    return bins


def pack(sizes: list[int], capacity: int) -> list[tuple[list[int], bool]]:
    fixed, left = reduce(sizes, capacity)
    return [(b, True) for b in fixed] + [(b, False) for b in best_fit(left, capacity)]


def _measure(capacity: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, "text"):
            n = np.diff(T.tokens(data, offsets)[2])
            doc = rows.column("doc_id").to_numpy()
            has = n > 0
            n, doc = n[has], doc[has]
            group = (T.mix(doc.view(np.uint64) ^ np.uint64(31)) % np.uint64(groups)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(doc), pa.array(n.astype(np.int64))], ["grp", "doc_id", "n"])

    return run


def _pack(capacity: int):
    def one(group: int, doc: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((n, doc))
        doc, n = doc[order], n[order]
        full, rest = n // capacity, n % capacity
        parts: list[tuple[np.ndarray, ...]] = []
        source = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(source)) - np.repeat(np.cumsum(full) - full, full)
        zero = np.zeros(len(source), np.int64)
        parts.append((np.arange(len(source)), zero, source, piece, np.full(len(source), capacity), zero + 1))
        at = np.flatnonzero(rest)
        at = at[np.argsort(-rest[at], kind="stable")]
        next_of = {s: i for i, s in reversed(list(enumerate(rest[at].tolist())))}
        bins, place, who, size, fixed = [], [], [], [], []
        for b, (members, sure) in enumerate(pack(rest[at].tolist(), capacity), len(source)):
            for k, s in enumerate(members):
                who.append(next_of[s])
                next_of[s] += 1
                bins.append(b)
                place.append(k)
                size.append(s)
                fixed.append(sure)
        who = at[np.array(who, np.int64)] if who else np.zeros(0, np.int64)
        parts.append((np.array(bins, np.int64), np.array(place, np.int64), who, full[who], np.array(size, np.int64), np.array(fixed, np.int64)))
        bin_, position, who, piece, size, sure = (np.concatenate([x[i] for x in parts]) for i in range(6))
        names = pa.array([f"{group}-{b}" for b in bin_.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(position.astype(np.int32)), pa.array(doc[who]), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size.astype(np.int32)), pa.array(sure.astype(bool))], [f.split()[0] for f in _SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches if batch.num_rows]
        if not held:
            return
        group, doc, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        for g in np.unique(group).tolist():
            yield one(g, doc[group == g], n[group == g])

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_rests: int = GROUP_RESTS) -> DataFrame:
    """One row for each piece of a document: its bin, its place there, its tokens, and whether the reduction fixed it.

    bin_id is 'group-number'; start_token and n_tokens give the piece's tokens in its document, split at white space.
    """
    docs = keyed(df, id_col, text_col)
    groups = max(1, math.ceil(docs.select("doc_id").count() / group_rests))
    sizes = docs.mapInArrow(_measure(capacity, groups), "grp int, doc_id long, n long")
    return sizes.repartitionById(groups, F.col("grp")).mapInArrow(_pack(capacity), _SCHEMA)
