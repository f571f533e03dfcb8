"""Runs of repeated windows: how operators 5 and 10 collapse them before the shuffle, carry them, and unite them.

A window (or segment) that a task meets again is repeated for certain, and not the first of its content if it comes
after one that the task sent on. Such places become runs on the spot; of each content a chunk sends on one place only,
with a flag if it stands for several, and a task none that comes after one it sent with that flag. So what meets in one
task of the shuffle follows the number of contents, not of their places, however often a passage is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ledgerloom.llm import text as T

MARKS = "doc_id long, at binary, size binary, later binary"
_NAMES = ["doc_id", "at", "size", "later"]


class Sent:
    """Contents that this task has sent on for several places: hash, and the least place sent; forgotten beyond `most`."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most = most
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _keep(self, hashes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        self.hashes, self.doc, self.at = hashes, doc, at

    def known(self, hashes: np.ndarray, doc: np.ndarray, at: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Of distinct hashes with their places: which come after a place sent before. The others of many are noted."""
        rank = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        found = self.hashes[rank] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        after = found.copy()
        r = rank[found]
        after[found] = (doc[found] > self.doc[r]) | ((doc[found] == self.doc[r]) & (at[found] > self.at[r]))
        earlier = found & ~after
        self.doc[rank[earlier]], self.at[rank[earlier]] = doc[earlier], at[earlier]
        fresh = many & ~found
        if fresh.any():
            h, d, p = hashes[fresh], doc[fresh], at[fresh]
            if len(self.hashes) + len(h) <= self.most:
                h, d, p = np.concatenate([self.hashes, h]), np.concatenate([self.doc, d]), np.concatenate([self.at, p])
            order = np.argsort(h)
            self._keep(h[order], d[order], p[order].astype(np.int64))
        return after


def one_of_each(hashes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the least place of each hash, whether it stands for several, and the indices of all other places."""
    order = np.argsort(hashes, kind="quicksort")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.zeros(len(ranked), bool)
    tied[1:] = same
    tied[:-1] |= same
    some = order[tied]
    some = some[np.lexsort((at[some], doc[some], hashes[some]))]
    h = hashes[some]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    one = np.concatenate([order[~tied], some[first]])
    return one, np.arange(len(one)) >= len(one) - int(first.sum()), some[~first]


def runs(doc: np.ndarray, at: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of windows as runs (doc, first window, number of windows, later), in the order of doc and place."""
    order = np.lexsort((at, doc))
    doc, at, later = doc[order], at[order], later[order]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (later[1:] != later[:-1]))) if len(doc) else np.zeros(0, int)
    return doc[head], at[head], np.diff(np.append(head, len(doc))), later[head]


def batch(doc: np.ndarray, at: np.ndarray, size: np.ndarray, later: np.ndarray) -> pa.RecordBatch:
    """One row a document, its runs end to end; doc: sorted, and not empty."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    pairs = list(zip(cuts[:-1], cuts[1:]))
    blobs = (pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (at.astype(np.int32), size.astype(np.int32), later.astype(bool)))
    return pa.RecordBatch.from_arrays([pa.array(doc[cuts[:-1]]), *blobs], _NAMES)


def unite(width: int):
    """Maximal intervals of tokens of each document from its runs of windows; a document at a time, in batches."""

    def solve(docs: list[int], blobs: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        at, size = (np.frombuffer(b"".join(x[i] for x in blobs), np.int32).astype(np.int64) for i in (0, 1))
        later = np.frombuffer(b"".join(x[2] for x in blobs), bool)
        doc = np.repeat(np.array(docs, np.int64), [len(x[2]) for x in blobs])
        for kind, mask in (("repeat", np.ones(len(later), bool)), ("remove", later)):
            k, a, b = T.unions(doc[mask], at[mask], (at + size - 1)[mask] + width)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([kind] * len(k), pa.string()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "kind", "start_token", "end_token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document: a batch is solved up to where its last document begins."""
        docs: list[int] = []
        blobs: list[tuple[bytes, bytes, bytes]] = []
        for some in batches:
            if not some.num_rows:
                continue
            for doc, *x in zip(*(c.to_pylist() for c in some.columns)):
                if docs and doc != docs[-1] and len(docs) > 20_000:
                    yield from solve(docs, blobs)
                    docs, blobs = [], []
                docs.append(doc)
                blobs.append(tuple(x))
        if docs:
            yield from solve(docs, blobs)
        del docs, blobs
        T.release()

    return run
