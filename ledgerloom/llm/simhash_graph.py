"""Operator 9: SimHash near-duplicates by navigable small-world graphs over Hamming distance.

Each text gets a 256-bit SimHash of its distinct tokens and token pairs (ASCII case ignored): a signed feature hash of
2,048 slots, then signs of random projections. Texts with equal tokens are one point. Points are dealt to shards by a
hash of their id; each shard builds one navigable small-world graph, and every point of the table is a query to every
shard. SimHashes of unlike texts lie as far apart as random ones, so a walk from fixed seeds finds no way to a lone
copy; a search here enters the graph where points agree with the query in all of some 10 bits, in any of `tables`
choices of bits. From the nearest entries it expands its nearest open nodes, and doubles the width of its
beam as long as the whole beam lies within `radius` bits. Each shard checks its search against exact search for `audit`
of its own points and as many of other shards, and builds its graph again, with a beam twice as wide and twice the
tables, while the recall of an average query, or of an average one with few hits, is below `recall`.

All hits are candidates, verified by the exact Jaccard similarity of the feature sets and united by alternating stars.
So that large groups don't need all their pairs, likely ones come first: the spanning tree of least distances of each
local component (points of a shard that are linked within the radius), and the nearest pair between two components.
A hit is left out only where verified edges join its ends already. Of the others the nearest few between each two
verified groups are verified next, then all that still lie between two groups.

The number of shards depends on the number of points only (500,000 each at most, and 6 at least): work grows with
points times shards times the cost of a search, which hardly grows with the shard. Beyond four million queries,
several tasks share the queries to a shard, each with its own copy of the graph.

Results for edge cases: null and empty texts, and texts without a token, have no copy: each is its own group. Rows
without an id are left out. Rows that share an id are one document: it's in the group of any of them. Texts with equal
tokens are in one group at any length. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import cut, fresh, keyed, parts, spread

BITS, SLOTS = 256, 2048
RADIUS, JACCARD = 72, 0.55
LINKS, BACK, SEEDS, BEAM, OPEN, TABLES, WIDER = 12, 16, 8, 8, 4, 32, 1
FEW, ROWS, STEP, NEAR, ASKED, EDGES = 4, 100_000, 1024, 16, 60_000, 1 << 19
CROWD, FULL, TILE, PAIRS = 32, 128, 8 << 20, 1 << 15
SHARDS, SHARD_POINTS, SLICE_QUERIES, AUDIT, RECALL = 6, 500_000, 4_000_000, 768, 0.95
_FAR = np.int16(999)
_BLOCKS = "shard int, kind int, ids binary, prints binary"
_FOUND = "kind int, a long, b long, distance int"
_PLANES: list[np.ndarray] = []


def _planes() -> np.ndarray:
    if not _PLANES:
        _PLANES.append(np.random.default_rng(20240229).standard_normal((SLOTS, BITS)).astype(np.float32))
    return _PLANES[0]


def feature_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 40-bit features of each row, end to end, and their n + 1 offsets; two 64-bit hashes of each row's tokens."""
    starts, ends, bounds = T.tokens(data, offsets)
    n = len(bounds) - 1
    h = T.token_hashes(T.LOWER[data], starts, ends)
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(bounds))
    place = (np.arange(len(h), dtype=np.uint64) - bounds[:-1].astype(np.uint64)[row.astype(np.int64)]) if len(h) else h
    first, second = (np.zeros(n, np.uint64) for _ in range(2))
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        spread = T.mix(h + place * np.uint64(0x9E3779B97F4A7C15))
        first[filled] = np.add.reduceat(spread, bounds[:-1][filled])
        second[filled] = np.add.reduceat(T.mix(spread ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1][filled])
    paired = T.mix(h[:-1] * np.uint64(3) + h[1:] * np.uint64(5))[row[:-1] == row[1:]] if len(h) > 1 else h[:0]
    pair_row = row[:-1][row[:-1] == row[1:]] if len(h) > 1 else row[:0]
    keys = np.concatenate([(row << np.uint64(40)) | (h >> np.uint64(24)), (pair_row << np.uint64(40)) | (paired >> np.uint64(24))])
    keys.sort()
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64((1 << 40) - 1), np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(40)), first, second


def fingerprints(features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """n x 4 words of 64 bits."""
    n = len(bounds) - 1
    out = np.empty((n, BITS // 64), np.uint64)
    for a in range(0, n, 2048):
        b = min(a + 2048, n)
        f = features[bounds[a] : bounds[b]]
        row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        sign = ((f >> np.uint64(39)) & np.uint64(1)).astype(np.float64) * 2 - 1
        sketch = np.bincount(row * SLOTS + (f % np.uint64(SLOTS)).astype(np.int64), sign, (b - a) * SLOTS).reshape(b - a, SLOTS).astype(np.float32)
        out[a:b] = np.packbits(sketch @ _planes() > 0, axis=1).view(np.uint64)
    return out


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in T.chunks(batches, "text"):
        features, bounds, first, second = feature_sets(data, offsets)
        has = np.flatnonzero(np.diff(bounds))
        prints = fingerprints(features, bounds)[has]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(has)), pa.array(first[has].view(np.int64)), pa.array(second[has].view(np.int64)), pa.array([x.tobytes() for x in prints], pa.binary())],
            ["doc_id", "first", "second", "print"],
        )


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    four = np.bitwise_count(a ^ b).view(np.uint32)[..., 0]  # the counts of four words, a byte each
    two = (four & np.uint32(0xFF00FF)) + ((four >> np.uint32(8)) & np.uint32(0xFF00FF))
    return ((two & np.uint32(0xFFFF)) + (two >> np.uint32(16))).astype(np.int16)


class Graph:
    """A navigable small-world graph of points: links to near ones, half of them beyond the radius, and links back.

    A search enters it where points agree with the query in all of some `width` bits, of any of `tables` random choices of
    bits; these entries also give the candidates for links. All queries of a bucket are compared with its points at once,
    by a word of 64 bits, then by two; what remains, by the whole print.

    Its crowd are the points with many entries within the radius, and these entries: the members of large groups. A
    query with over CROWD entries within the radius is compared with the whole crowd, which costs far less than a walk
    past all of a group; `home` is the component of each of the crowd, `forest` a spanning forest of the crowd, of links
    to nearest points where these suffice.
    """

    def __init__(self, prints: np.ndarray, radius: int, beam: int, tables: int) -> None:
        self.prints, self.radius, self.beam, n = prints, radius, beam, len(prints)
        self.size, self.width = n, int(np.clip(min(np.log2(max(n, 1)) / 2 + WIDER, np.log2(max(n, 1) / SEEDS)), 0, 18))
        self.most, self.far = 2 * (n >> self.width) + 4 * SEEDS, BITS
        self.rng = np.random.default_rng(77)
        self.words = np.ascontiguousarray(prints.T)
        share = radius / BITS  # of a pair at the radius one in 40 differs in more bits of one word, or of two
        self.word = [np.uint8(k * share + 2 * math.sqrt(k * share * max(1 - share, 0) * (BITS - k) / (BITS - 1))) for k in (64, 128)]
        self.bits: list[np.ndarray] = []
        self.order: list[np.ndarray] = []
        self.offsets: list[np.ndarray] = []
        self._add(tables)
        self.out = np.full((n, LINKS), -1, np.int32)
        self.back = np.full((n, BACK), -1, np.int32)
        self.back_d = np.full((n, BACK), _FAR, np.int16)
        self.crowd = np.zeros(n, bool)
        for a in range(0, n, ASKED):
            some = np.arange(a, min(n, a + ASKED))
            self.far = BITS
            q, p, d = self._entries(prints[some])
            near = d <= radius
            many = np.bincount(q[near], minlength=len(some)) > CROWD * BEAM // (2 * beam)  # a wider beam has a wider crowd
            self.crowd[some[many]] = True
            self.crowd[p[near & many[q]]] = True
            other = some[q] != p
            self._link(some, q[other], p[other], d[other])
        self.among = np.flatnonzero(self.crowd)
        self.close = prints[self.among]
        self.step = int(min(STEP, max(16, (96 << 20) // max(n, 1))))
        self.seen: np.ndarray | None = None
        self.home: np.ndarray | None = None

    def _add(self, tables: int) -> None:
        bits = np.zeros((BITS, tables), np.float32)
        for t in range(tables):
            bits[self.rng.choice(BITS, self.width, replace=False), t] = 1 << np.arange(self.width)
        for a in range(0, tables, 16):
            for key in self._keys(self.prints, bits[:, a : a + 16]):
                order = np.argsort(key.astype(np.uint16) if self.width <= 16 else key, kind="stable").astype(np.int32)
                self.order.append(order)
                self.offsets.append(np.searchsorted(key[order], np.arange((1 << self.width) + 1)).astype(np.int32))
        self.bits += list(bits.T)

    def widen(self) -> None:
        """Twice the beam and the tables; links and crowd stay."""
        self.beam *= 2
        self._add(len(self.bits))

    def join_crowd(self) -> None:
        m = len(self.among)
        forest = tuple(np.zeros(0, np.int64) for _ in range(3))
        self.home = np.arange(m)
        for a in range(0, m, 64):
            q, p, d = exact_hits(self.close, self.close[a : a + 64], self.radius)
            order = np.lexsort((p, d, q))
            q, p, d = q[order], p[order], d[order]
            some = (q + a != p) & ((np.arange(len(q)) - np.searchsorted(q, q) <= SEEDS) | (self.home[q + a] != self.home[p]))
            x, y, d = (np.concatenate([old, new]) for old, new in zip(forest, (q[some] + a, p[some], d[some])))
            forest = x, y, d
            if len(d) > 4 * m or a + 64 >= m:
                self.home, tree = spanning(m, x, y, d)
                forest = x[tree], y[tree], d[tree]
        self.home = self.among[self.home]
        self.forest = self.among[forest[0]], self.among[forest[1]], forest[2]

    def _keys(self, points: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """For each column of bits, the number that a point's bits there make."""
        out = np.empty((bits.shape[1], len(points)), np.int32)
        for a in range(0, len(points), STEP):
            some = np.unpackbits(np.ascontiguousarray(points[a : a + STEP]).view(np.uint8).reshape(-1, BITS // 8), axis=1)
            out[:, a : a + STEP] = (some.astype(np.float32) @ bits).T
        return out

    def _entries(self, queries: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, distance): of each table up to `most` points with the query's number, that are near by two words of it too.

        Those within limit bits; without it those within the radius, and of others LINKS for a query on average.
        """
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int16))]
        for t, (key, order, offsets) in enumerate(zip(self._keys(queries, np.stack(self.bits, axis=1)), self.order, self.offsets)):
            i, j = t % len(self.words), (t + 1) % len(self.words)
            turn = np.argsort(key.astype(np.uint16) if self.width <= 16 else key, kind="stable")
            asks, also, word, next_ = queries[turn, i], queries[turn, j], self.words[i][order], self.words[j][order]
            buckets, first = np.unique(key[turn], return_index=True)
            blocks = []
            for a, b, x, y in zip(first.tolist(), np.append(first[1:], len(turn)).tolist(), offsets[buckets].tolist(), offsets[buckets + 1].tolist()):
                y = min(y, x + self.most)
                rows = max(1, PAIRS // max(y - x, 1))
                for c in range(a, b if y > x else a, rows):
                    bits = np.bitwise_count(asks[c : min(b, c + rows), None] ^ word[x:y]).ravel()
                    near = np.flatnonzero(bits <= self.word[0])
                    q = near // (y - x)
                    p = near - q * (y - x)
                    q += c
                    p += x
                    both = np.flatnonzero(bits[near] + np.bitwise_count(also[q] ^ next_[p]) <= self.word[1])
                    if len(both):
                        blocks.append((q[both], p[both]))
            if not blocks:
                continue
            q, p = turn[np.concatenate([x for x, _ in blocks])], order[np.concatenate([x for _, x in blocks])]
            d = hamming(queries.take(q, axis=0), self.prints.take(p, axis=0))
            near = np.flatnonzero(d <= (self.far if limit is None else limit))
            found.append((q[near], p[near], d[near]))
            if limit is None and sum(len(f[0]) for f in found) > 4 * LINKS * len(queries):
                found = [self._nearer(found, len(queries))]
        q, p, d = self._nearer(found, len(queries)) if limit is None else (np.concatenate([f[i] for f in found]) for i in range(3))
        _, one = np.unique(q * self.size + p, return_index=True)
        return q[one], p[one], d[one]

    def _nearer(self, found: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of what was found for n queries, what lies within the radius, and of others LINKS for a query on average."""
        q, p, d = (np.concatenate([f[i] for f in found]) for i in range(3))
        far = d[d > self.radius]
        if len(far) > LINKS * n:
            near = np.flatnonzero(d <= np.partition(far, LINKS * n)[LINKS * n])
            q, p, d = q[near], p[near], d[near]
            self.far = max(self.radius, int(d.max()))
        return q, p, d

    def _nearest(self, n: int, q: np.ndarray, p: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points of each of n queries and their distances, sorted, `most` at most."""
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < most
        ids, far = np.full((n, most), -1, np.int32), np.full((n, most), _FAR, np.int16)
        ids[q[keep], rank[keep]], far[q[keep], rank[keep]] = p[keep], d[keep]
        return ids, far

    def _link(self, points: np.ndarray, q: np.ndarray, p: np.ndarray, d: np.ndarray) -> None:
        """Links of points[q] to p at distance d: the nearest, any of those within the radius, and the nearest beyond it.

        Links back go to the nearest that ask for one, and to any others: so that a large group has ways to all of it.
        """
        within = d <= self.radius
        chance = T.mix((points[q].astype(np.uint64) << np.uint64(32)) | p.astype(np.uint64))
        picks = []
        for some, by in ((np.arange(len(q)), d), (np.flatnonzero(within), chance), (np.flatnonzero(~within), d)):
            some = some[np.lexsort((p[some], by[some], q[some]))]
            some = some[np.arange(len(some)) - np.searchsorted(q[some], q[some]) < LINKS // 3]
            picks.append(some)
        pick = np.unique(np.concatenate(picks))
        q, p, d = q[pick], p[pick], d[pick]
        self.out[points[q], np.arange(len(q)) - np.searchsorted(q, q)] = p
        to, source, dist = p, points[q].astype(np.int32), d
        touched = np.unique(to)
        old = self.back[touched]
        have = old >= 0
        to = np.concatenate([to, np.repeat(touched, BACK)[have.ravel()]])
        source = np.concatenate([source, old[have]])
        dist = np.concatenate([dist, self.back_d[touched][have]])
        self.back[touched], self.back_d[touched] = -1, _FAR
        chance = T.mix((to.astype(np.uint64) << np.uint64(32)) | source.astype(np.uint64))
        rest = np.arange(len(to))
        for half, by in ((0, dist), (BACK // 2, chance)):
            rest = rest[np.lexsort((source[rest], by[rest], to[rest]))]
            rank = np.arange(len(rest)) - np.searchsorted(to[rest], to[rest])
            keep = rest[rank < BACK // 2]
            self.back[to[keep], half + rank[rank < BACK // 2]] = source[keep]
            self.back_d[to[keep], half + rank[rank < BACK // 2]] = dist[keep]
            rest = rest[rank >= BACK // 2]

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All hits (query, point, distance) of all queries."""
        return self._stepwise(queries, True)[:3]

    def reduced(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As search, but of the crowd only the nearest of each component for a query with many entries; and who has many."""
        return self._stepwise(queries, False)

    def _stepwise(self, queries: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hits, many = [], np.zeros(len(queries), bool)
        for a in range(0, len(queries), ASKED):
            some, many[a : a + ASKED] = self._search(queries[a : a + ASKED], whole)
            hits += [(q + a, p, x) for q, p, x in some]
        return *(np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in range(3)), many

    def _scan(self, queries: np.ndarray, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hits of queries in the crowd."""
        for a in range(0, len(queries), 64):
            q, p, d = exact_hits(self.close, queries[a : a + 64], self.radius)
            if not whole:
                order = np.lexsort((p, d, self.home[p], q))
                q, p, d = q[order], p[order], d[order]
                first = np.append(True, (q[1:] != q[:-1]) | (self.home[p[1:]] != self.home[p[:-1]]))[: len(q)]
                q, p, d = q[first], p[first], d[first]
            yield q + a, self.among[p], d

    def _search(self, queries: np.ndarray, whole: bool) -> tuple[list, np.ndarray]:
        """A beam begins with entries up to NEAR bits beyond the radius; a query without one has no hit that links lead to."""
        q, p, d = self._entries(queries, self.radius + NEAR)
        within = d <= self.radius
        count, entered = (np.bincount(x, minlength=len(queries)) for x in (q[within], q))
        many = count > CROWD
        hits: list = []
        if many.any():
            lots = np.flatnonzero(many)
            hits += [(lots[a], b, x) for a, b, x in self._scan(queries[lots], whole)]
            rest = within & many[q] & ~self.crowd[p]
            hits.append((q[rest], p[rest], d[rest]))
        for wide in (False, True):  # where entries alone fill a beam, it starts wider
            walks = np.flatnonzero(((count >= self.beam) == wide) & (entered > 0) & ~many)
            for own in (walks[a : a + self.step] for a in range(0, len(walks), self.step)):
                width = max(self.beam, 2 * int(count[own].max())) if wide else self.beam
                place = np.full(len(queries), -1)
                place[own] = np.arange(len(own))
                mine = place[q] >= 0
                hits += [(own[a], b, x) for a, b, x in self._walk(queries[own], place[q[mine]], p[mine], d[mine], min(width, max(self.size, 1)))]
        if not hits:
            return [], many
        q, p, d = (np.concatenate([h[i] for h in hits]) for i in range(3))
        _, one = np.unique(q * self.size + p, return_index=True)
        return [(q[one], p[one], d[one])], many

    def _walk(self, queries: np.ndarray, q: np.ndarray, p: np.ndarray, x: np.ndarray, width: int) -> list:
        """Hits of a beam that starts with the nearest entries (q, p, x), and of wider ones where it lies within the radius whole.

        Beyond FULL places a query is compared with all points.
        """
        n = len(queries)
        if self.seen is None:
            self.seen = np.zeros((self.step, self.size), np.uint8)
        seen, touched = self.seen, [(q, p)]
        seen[q, p] = 1
        near = x <= self.radius
        hits, again = [(q[near], p[near].astype(np.int64), x[near])] if near.any() else [], []
        ids, d = self._nearest(n, q, p, x, width)
        done, live = d >= _FAR, np.arange(n)
        while len(live):
            k = min(OPEN, ids.shape[1])
            key = d + np.where(done, np.int16(2000), np.int16(0))
            pick = np.argpartition(key, k - 1, axis=1)[:, :k]
            open_ = np.take_along_axis(key, pick, 1) < _FAR
            np.put_along_axis(done, pick, True, 1)
            nodes = np.where(open_, np.take_along_axis(ids, pick, 1), -1)
            near = np.concatenate([self.out[nodes], self.back[nodes]], axis=2)
            near[nodes < 0] = -1
            for part in np.array_split(np.arange(near.shape[1]), math.ceil(near.shape[1] * near.shape[2] / 250)):
                some = near[:, part].reshape(len(live), -1)
                r, c = np.nonzero(some >= 0)
                p = some[r, c]
                at = live[r]
                fresh = seen[at, p] == 0
                r, c, p, at = r[fresh], c[fresh], p[fresh], at[fresh]
                seen[at, p] = c + 1
                fresh = seen[at, p] == c + 1
                r, c, p, at = r[fresh], c[fresh], p[fresh], at[fresh]
                touched.append((at, p))
                x = hamming(queries[at], self.prints[p])
                close = x <= self.radius
                if close.any():
                    hits.append((at[close], p[close].astype(np.int64), x[close]))
                new_d = np.full(some.shape, _FAR, np.int16)
                new_d[r, c] = x
                d, ids, done = np.concatenate([d, new_d], 1), np.concatenate([ids, some], 1), np.concatenate([done, new_d >= _FAR], 1)
            pick = np.argpartition(d, width - 1, axis=1)[:, :width]
            d, ids, done = (np.take_along_axis(x, pick, 1) for x in (d, ids, done))
            over = done.all(axis=1)
            if not over.any():
                continue
            if width < self.size:  # a beam that lies within the radius whole may have dropped hits
                full = over & (d.max(axis=1) <= self.radius)
                if full.any():
                    again.append((live[full], ids[full], d[full]))
            live, ids, d, done = live[~over], ids[~over], d[~over], done[~over]
        for at, p in touched:
            seen[at, p] = 0
        if again:
            who = np.concatenate([w for w, _, _ in again])
            if 2 * width > FULL:
                a, b, y = exact_hits(self.prints, queries[who], self.radius)
                return [*hits, (who[a], b, y)]
            p, x = (np.concatenate([a[i] for a in again]) for i in (1, 2))
            q = np.repeat(np.arange(len(who)), p.shape[1])
            hits += [(who[a], b, y) for a, b, y in self._walk(queries[who], q, p.ravel(), x.ravel(), min(2 * width, self.size))]
        return hits


def exact_hits(prints: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hits, in the order of queries; 64 x 2,048 pairs at a time stay in a core's cache."""
    found = []
    for a in range(0, len(queries), 64):
        some = queries[a : a + 64]
        for b in range(0, len(prints), 2048):
            d = np.zeros((len(some), len(prints[b : b + 2048])), np.uint16)
            for w in range(prints.shape[1]):
                d += np.bitwise_count(some[:, w, None] ^ prints[None, b : b + 2048, w])
            q, p = np.nonzero(d <= radius)
            if len(q):
                found.append((q + a, p + b, d[q, p].astype(np.int16)))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def audited(prints: np.ndarray, radius: int, beam: int, audit: int, least: float, foreign: np.ndarray | None = None, tables: int = TABLES) -> tuple[Graph, float]:
    """A graph whose search finds the share `least`, averaged by query, of what exact search finds; and that share.

    It must be reached by `audit` of its own points, by as many foreign ones, and by those of both that have few hits,
    though one lost query is no proof in a group of under 1 / (1 - least). Else its beam is made twice as wide and its
    tables twice as many; every second time the links are built again too. The share returned is the least of the three.
    """
    n = len(prints)
    sample = np.unique(np.linspace(0, n - 1, min(n, audit)).astype(int))
    other = prints[:0] if foreign is None else foreign[np.unique(np.linspace(0, len(foreign) - 1, min(len(foreign), audit)).astype(int))]
    queries, home = np.concatenate([prints[sample], other]), np.append(sample, np.full(len(other), -1))

    def keys(q: np.ndarray, p: np.ndarray, _: np.ndarray) -> np.ndarray:
        return np.unique((q * n + p)[home[q] != p])

    true = keys(*exact_hits(prints, queries, radius))
    each = np.bincount(true // n, minlength=len(queries))
    groups = [g for g in ((each > 0) & (home >= 0), (each > 0) & (home < 0), (each > 0) & (each <= FEW)) if g.any()]
    graph, again = Graph(prints, radius, beam, tables), False
    while True:
        got = np.bincount(np.intersect1d(true, keys(*graph.search(queries)), assume_unique=True) // n, minlength=len(queries))
        lost = 1 - got / np.maximum(each, 1)
        if beam >= n or all(lost[g].sum() <= max(1.0, (1 - least) * g.sum()) for g in groups):
            return graph, min((1 - lost[g].mean() for g in groups), default=1.0)
        beam, tables, again = 2 * beam, 2 * tables, not again
        if again:
            graph.widen()
        else:
            graph = Graph(prints, radius, beam, tables)


def spanning(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root of each of n nodes (the least of its component) and the indices of the edges of a least spanning forest."""
    root, chosen = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.lexsort((b, a, d))
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            chosen.append(i)
    return np.array([find(x) for x in range(n)], np.int64), np.array(chosen, np.int64)


def _deal(shards: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy()
            prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            home = (T.mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int32)
            part = (T.mix(ids.view(np.uint64) ^ np.uint64(7)) % np.uint64(slices)).astype(np.int32)
            shard, kind, blobs = [], [], []
            for s in range(shards * slices):
                own = home == s // slices
                asks = ~own & (part == s % slices)
                for k, mask in ((0, own), (1, asks)):
                    if mask.any():
                        shard.append(s)
                        kind.append(k)
                        blobs.append((ids[mask].tobytes(), prints[mask].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(kind, pa.int32()), *(pa.array([x[i] for x in blobs], pa.binary()) for i in (0, 1))], ["shard", "kind", "ids", "prints"])

    return run


def _found(kind: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(d.astype(np.int32))], ["kind", "a", "b", "distance"])


def _others(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 4 in batches of ROWS: a large group has many."""
    for i in range(0, len(a), ROWS):
        yield _found(4, a[i : i + ROWS], b[i : i + ROWS], d[i : i + ROWS])


def _search_shard(slices: int, radius: int, beam: int, audit: int, least: float, tables: int = TABLES):
    """Rows of kind 0: point a is in the component of point b; 1: tree edge; 2: query a's nearest hit b; 3: recall, in ten thousandths; 4: any other hit; 5: point a is in the crowd's component of point b, or has a hit there.

    Pairs of the crowd, and of it and a query with many entries, have rows of kind 5 in place of 4: all pairs of what these
    rows join are compared later (_compare).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, asked, graph, shard = [], [], [], None, 0
        points = np.zeros(0, np.int64)

        def start() -> Iterator[pa.RecordBatch]:
            nonlocal graph, points
            points, own = np.concatenate(ids), np.concatenate(prints)
            order = np.argsort(T.mix(points.view(np.uint64) ^ np.uint64(99)))
            points, own = points[order], own[order]
            graph, share = audited(own, radius, beam, audit, least, np.concatenate([own[:0], *(x for _, x in asked)]), tables)
            graph.join_crowd()
            yield _found(5, points[graph.among], points[graph.home], np.zeros(len(graph.among)))
            if shard % slices:
                return
            yield _found(3, points[:1], points[:1], np.array([round(share * 10_000)]))
            place = np.full(len(points), -1)
            place[graph.among] = graph.home
            pairs = [graph.forest]
            for i in range(0, len(own), ASKED):
                q, p, d, many = graph.reduced(own[i : i + ASKED])
                joins = many[q] & graph.crowd[p]
                q = q + i
                joins &= ~graph.crowd[q]
                yield _found(5, points[q[joins]], points[place[p[joins]]], np.zeros(int(joins.sum())))
                pair = (q != p) & ~(graph.crowd[q] & graph.crowd[p])
                pairs.append((q[pair], p[pair], d[pair]))
            q, p, d = (np.concatenate([x[i] for x in pairs]) for i in range(3))
            a, b = np.minimum(q, p), np.maximum(q, p)
            _, one = np.unique(a * len(points) + b, return_index=True)
            a, b, d = a[one], b[one], d[one]
            roots, tree = spanning(len(points), a, b, d)
            linked = np.flatnonzero((roots != np.arange(len(points))) | (np.bincount(roots, minlength=len(points)) > 1))
            yield _found(0, points[linked], points[roots[linked]], np.zeros(len(linked)))
            yield _found(1, points[a[tree]], points[b[tree]], d[tree])
            other = np.ones(len(a), bool)
            other[tree] = False
            yield from _others(points[a[other]], points[b[other]], d[other])

        def answer() -> Iterator[pa.RecordBatch]:
            if graph is None:
                yield from start()
            for i, x in asked:
                q, p, d, many = graph.reduced(x)
                place = np.full(len(points), -1)
                place[graph.among] = graph.home
                joins = many[q] & graph.crowd[p]
                if joins.any():
                    yield _found(5, i[q[joins]], points[place[p[joins]]], np.zeros(int(joins.sum())))
                order = np.lexsort((p, d, q))
                q, p, d = q[order], p[order], d[order]
                best = np.append(True, q[1:] != q[:-1]) if len(q) else np.zeros(0, bool)
                if best.any():
                    yield _found(2, i[q[best]], points[p[best]], d[best])
                    yield from _others(i[q[~best]], points[p[~best]], d[~best])
            asked.clear()

        for batch in batches:
            for shard, kind, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                i, x = np.frombuffer(i, np.int64), np.frombuffer(x, np.uint64).reshape(-1, BITS // 64)
                if kind == 0:
                    ids.append(i)
                    prints.append(x)
                elif ids:
                    asked.append((i, x))
                    if sum(len(i) for i, _ in asked) >= (audit if graph is None else ASKED):
                        yield from answer()
        if ids:
            yield from answer()
        graph = None
        T.release()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text in rising order, five bytes each."""
    for rows, data, offsets in T.chunks(batches, "text"):
        features, bounds, _, _ = feature_sets(data, offsets)
        small = np.ascontiguousarray(features.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([small[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "features"])


def _features(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _verify(jaccard: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = _features(x), _features(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= jaccard * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(radius: int, jaccard: float):
    """Verified links (a, b) between groups (labels), of all pairs of tile i and tile j within the radius: those that unite two, nearest first."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        (_, i, j), table = (k.as_py() for k in key), table.combine_chunks()
        ids, tile = table["doc_id"].to_numpy(), table["tile"].to_numpy()
        prints = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        packed = table["features"].to_pylist()
        sizes = np.array([len(x) // 5 for x in packed], np.int64)
        starts = np.cumsum(sizes) - sizes
        names, values = np.unique(_features(b"".join(packed)), return_inverse=True)
        _, group = np.unique(table["label"].to_numpy(), return_inverse=True)
        group, mark = group.copy(), np.zeros(len(names), bool)
        first, second = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        found: list[tuple[int, int]] = []
        for a in range(0, len(first), 64):
            some = first[a : a + 64]
            q, p, d = exact_hits(prints[second], prints[some], radius)
            u, v = some[q], second[p]
            apart = (group[u] != group[v]) & ((u < v) | (i != j))
            u, v, d = u[apart], v[apart], d[apart]
            order = np.lexsort((v, d, u))
            u, v = u[order], v[order]
            for x, near in zip(u[np.flatnonzero(np.append(True, u[1:] != u[:-1]))[: len(u)]].tolist(), np.split(v, np.flatnonzero(u[1:] != u[:-1]) + 1)):
                own = values[starts[x] : starts[x] + sizes[x]]
                mark[own] = True
                size = 8
                while len(near):
                    near = near[group[near] != group[x]]
                    part, near = near[:size], near[size:]
                    ends = np.cumsum(sizes[part])
                    if len(part):
                        both = np.add.reduceat(mark[values[np.repeat(starts[part] - ends + sizes[part], sizes[part]) + np.arange(ends[-1])]], ends - sizes[part], dtype=np.int64)
                        for y in part[both >= jaccard * (len(own) + sizes[part] - both)].tolist():
                            if group[x] != group[y]:
                                group[group == group[y]] = group[x]
                                found.append((int(ids[x]), int(ids[y])))
                    size *= 8
                mark[own] = False
        T.release()
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of the nodes of edges (u, v), all of them in this one task."""
    found = [[batch.column(i).to_numpy() for i in range(2)] for batch in batches if batch.num_rows]
    if found:
        u, v = (np.concatenate([f[i] for f in found]) for i in range(2))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        at = at.ravel()
        roots, _ = spanning(len(nodes), at[: len(u)], at[len(u) :], np.zeros(len(u), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots])], ["id", "root"])


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(id, root) of all nodes of edges (a, b): the least id of each component, by alternating large and small stars.

    Of `most` edges or fewer, which are counted first, one task with union-find finds the same in one pass.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= most:
        return edges.coalesce(1).mapInArrow(_unite, "id long, root long")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            ends = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
            return ends.unionByName(ends.select(F.col("root").alias("id"), "root").distinct())
        mark = now


def _apart(hits: DataFrame, roots: DataFrame) -> DataFrame:
    """Hits (a, b, distance) whose ends aren't in one group yet, with these two groups as x < y."""
    for end, root in (("a", "x"), ("b", "y")):
        hits = hits.join(roots.select(F.col("id").alias(end), F.col("root").alias(root)), end, "left").withColumn(root, F.coalesce(root, end))
    return hits.where("x <> y").select("a", "b", "distance", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _crowded(found: DataFrame, roots: DataFrame, points: DataFrame, sets: DataFrame, n: int, radius: int, jaccard: float) -> DataFrame | None:
    """Verified links between groups within each crowd, all of its pairs compared by tiles of about TILE bytes; None without a crowd."""
    edges = found.where("kind = 5 and a <> b").select("a", "b")
    if edges.isEmpty():
        return None
    members = components(edges).select(F.col("id").alias("doc_id"), F.col("root").alias("block")).join(roots.select(F.col("id").alias("doc_id"), F.col("root").alias("label")), "doc_id", "left")
    members = members.withColumn("label", F.coalesce("label", "doc_id")).join(sets.select("doc_id", F.length("features").alias("size")), "doc_id")
    place = F.sum(F.col("size") + 1024).over(W.partitionBy("block").orderBy("label", "doc_id")) / TILE
    members = cut(members.withColumn("tile", F.floor(place).cast("int")).drop("size"))
    spans = members.groupBy("block", "tile").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = spans.select("block", F.col("tile").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    asked = spans.withColumnRenamed("tile", "i").join(other, "block").where("i <= j and least(low, low2) <> greatest(high, high2)")
    asked = asked.select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    rows = members.join(points, "doc_id").join(sets, "doc_id").join(asked, ["block", "tile"])
    return cut(rows.repartition(n, "block", "i", "j").groupBy("block", "i", "j").applyInArrow(_compare(radius, jaccard), "a long, b long"))


def _points(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Print of each document, and, as doc, the least id with the same tokens."""
    return spread(keyed(df, id_col, text_col)).mapInArrow(_print, "doc_id long, first long, second long, print binary")


def _search(points: DataFrame, radius: int, shards: int | None, beam: int, audit: int, recall: float, tables: int) -> DataFrame:
    n = points.count()
    s = shards or max(SHARDS, math.ceil(n / SHARD_POINTS))
    slices = math.ceil(n / SLICE_QUERIES) or 1
    blocks = points.mapInArrow(_deal(s, slices), _BLOCKS).repartitionById(s * slices, F.col("shard")).sortWithinPartitions("shard", "kind")
    return blocks.mapInArrow(_search_shard(slices, radius, beam, audit, recall, tables), _FOUND)


def _groups(df: DataFrame, id_col: str, text_col: str, radius: int, jaccard: float, shards: int | None, beam: int, audit: int, recall: float, tables: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All ids; the root of each that is in a group of several; documents a whose tokens are those of point b; verified links of points."""
    prints = cut(_points(df, id_col, text_col))
    points = prints.groupBy("first", "second").agg(F.min("doc_id").alias("doc_id"), F.min("print").alias("print"))
    exact = prints.join(points.select("first", "second", F.col("doc_id").alias("b")), ["first", "second"]).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    points = cut(points.groupBy("doc_id").agg(F.min("print").alias("print")))
    found = cut(_search(points, radius, shards, beam, audit, recall, tables))
    part = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("root"))
    cross = found.where("kind = 2").join(part.select(F.col("id").alias("a"), F.col("root").alias("x")), "a", "left").join(part.select(F.col("id").alias("b"), F.col("root").alias("y")), "b", "left")
    cross = cross.withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")}).groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    cross = cross.agg(F.min(F.struct("distance", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("e")).select("e.a", "e.b")
    pairs = cut(found.where("kind = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(cross).distinct())
    docs = keyed(df, id_col, text_col)
    n = parts(docs)
    ids = found.where("kind in (1, 2, 4, 5)").select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, features binary")
    sets = cut(sets.groupBy("doc_id").agg(F.min("features").alias("features")))

    def verified(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("features").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("features").alias("y")), "b")
        return cut(joined.select("a", "b", "x", "y").mapInArrow(_verify(jaccard), "a long, b long"))

    links = verified(pairs)
    roots = cut(components(links.unionByName(exact).repartition(n, "a")))
    more = _crowded(found, roots, points, sets, n, radius, jaccard)
    if more is not None:
        links = links.unionByName(more)
        roots = cut(components(more.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))).repartition(n, "a")))
    hits = found.where("kind in (2, 4)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()
    for few in (FEW, None):
        hits = cut(_apart(hits, roots).join(pairs, ["a", "b"], "left_anti"))
        if hits.isEmpty():
            break
        rank = F.row_number().over(W.partitionBy("x", "y").orderBy("distance", "a", "b"))
        pairs = cut((hits.withColumn("rank", rank).where(F.col("rank") <= few) if few else hits).select("a", "b"))
        hits = hits.select("a", "b", "distance")
        more = verified(pairs)
        links = links.unionByName(more)
        roots = cut(components(more.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))).repartition(n, "a")))
    return docs.select("doc_id").distinct(), roots, exact, links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, jaccard: float = JACCARD, shards: int | None = None, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL, tables: int = TABLES) -> DataFrame:
    """(doc_id, group_id, keep, n_links) for every document: the least id of its group of near-duplicates, and whether it's that.

    n_links: verified links of its text to other texts. A pair whose texts are joined by verified links already is neither
    verified nor counted, so a group of k texts has k - 1 links at least and needn't have all of its pairs.
    """
    everyone, roots, exact, links = _groups(df, id_col, text_col, radius, jaccard, shards, beam, audit, recall, tables)
    degree = links.select(F.explode(F.array("a", "b")).alias("point")).groupBy("point").agg(F.count("*").alias("n_links"))
    point = exact.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("point"))
    found = everyone.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").join(point, "doc_id", "left")
    found = found.select("doc_id", "root", F.coalesce("point", "doc_id").alias("point")).join(degree, "point", "left")
    keep = F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", F.coalesce("root", "doc_id").alias("group_id"), keep.alias("keep"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def recall_audit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shards: int | None = None, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL, tables: int = TABLES) -> DataFrame:
    """(shard_first, recall): the least share of exact hits, by query, that each shard's search found in what it checked."""
    points = _points(df, id_col, text_col).groupBy("first", "second").agg(F.min("doc_id").alias("doc_id"), F.min("print").alias("print"))
    points = cut(points.groupBy("doc_id").agg(F.min("print").alias("print")))
    return _search(points, radius, shards, beam, audit, recall, tables).where("kind = 3").select(F.col("a").alias("shard_first"), (F.col("distance") / 10_000).alias("recall"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """Rows of df that are the first of their group, in the order of the id; rows without an id go.

    Of rows that share an id and text one stays; of those that share an id only, all do.
    """
    key, rank = fresh(df, "kept_id"), fresh(df, "kept_rank")
    chosen = {"radius": RADIUS, "jaccard": JACCARD, "shards": None, "beam": BEAM, "audit": AUDIT, "recall": RECALL, "tables": TABLES} | options
    everyone, roots, _, _ = _groups(df, id_col, text_col, **chosen)
    first = everyone.join(roots.where("id <> root").withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias(key))
    found = df.join(first, F.col(f"`{id_col}`").cast("long") == F.col(f"`{key}`"), "left_semi")
    again = F.row_number().over(W.partitionBy(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).orderBy(F.lit(0)))
    return found.withColumn(rank, again).where(F.col(f"`{rank}`") == 1).drop(rank)
