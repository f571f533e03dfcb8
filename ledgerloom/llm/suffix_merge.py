"""Operator 10: suffix-array de-duplication by merging Burrows-Wheeler transforms of shards.

Every window of `width` tokens has a minimiser: the least of the hashes of its runs of `seed` tokens. A stretch of
windows with one minimiser is a segment, cut at most 2 * width - seed tokens long, and goes to the bucket of that
hash; so all contents of a repeated window meet in one bucket, each with the tokens that its order needs. Segments that
a task can tell to be later copies of an equal one become runs on the spot (marks.py), and the others that are equal
collapse in their bucket. Those whose minimiser is alone are dropped there: no window of theirs can repeat. The rest is
dealt to shards. Each shard's suffix array and Burrows-Wheeler transform come from
prefix doubling; the transforms are merged by iterative interleave refinement: from the order of all suffixes by h
symbols, one stable pass over the symbols before them gives the order by h + 1, without sorting suffixes again. Borders
between blocks appear in pass h where the common prefix is h - 1 symbols long, so after `width` passes the borders give
the longest-common-prefix array up to `width`, and each block without a border inside is one repeated interval.

Memory of a task follows its bucket, not the table; buckets grow in number with the table's size. A passage that is
repeated everywhere is sent on once by each task that meets it, as equal segments, and collapses again in its bucket.

Results for edge cases: null and empty texts, and texts of fewer than `width` tokens, have no window and give no row.
Rows without an id are left out. Rows that share an id are one document: a window that both hold is repeated. Texts that
differ in white space only are equal. Tokens are known by 40-bit hashes, so two windows are taken for one by chance only
where they differ in tokens that clash: under 2**-40 for each pair of windows that differ in one token. An empty table
gives an empty result. Only the id and text columns are read; input that isn't read straight from files is written to
the checkpoint folder first, so that a task run again sees the same rows in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import marks as M
from ledgerloom.llm import text as T
from ledgerloom.llm.common import keyed, parts, stable
from ledgerloom.llm.repetition import suffix_array

WIDTH, SEED, SHARDS, SLICE = 50, 6, 4, 500_000
#: kind 0: segments, each with a place, and whether it stands for several; 1: runs (docs, at, sizes) of later copies.
_SEGMENTS = "bucket int, kind int, docs binary, at binary, sizes binary, many binary, seeds binary, wholes binary, low binary, high binary"
_SEGMENT_BASE = np.uint64(0xA24BAED4963EE407)


def minimizers(hashes: np.ndarray, bounds: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of width tokens: its first token, and place and hash of its least run of seed tokens (the first)."""
    first, _ = T.windows(bounds, width)
    if not len(first):
        return first, first, hashes[:0]
    grams = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    at, _ = T.windows(bounds, seed)
    grams[at] = T.window_hashes(hashes, at, seed)
    least = np.arange(len(grams))
    span, reach = 1, width - seed + 1
    while 2 * span <= reach:
        right = np.append(least[span:], np.full(span, len(grams) - 1))
        least = np.where(grams[right] < grams[least], right, least)
        span *= 2
    left, right = least[first], least[first + reach - span]
    place = np.where(grams[right] < grams[left], right, left)
    return first, place, grams[place]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _cut(width: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = M.Sent()
        for rows, data, offsets in T.chunks(batches, "text"):
            starts, ends, bounds = T.tokens(data, offsets)
            hashes = T.token_hashes(data, starts, ends)
            del starts, ends
            first, place, gram = minimizers(hashes, bounds, width, seed)
            if not len(first):
                continue
            head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)))
            begin, gram = first[head], gram[head]
            size = np.diff(np.append(head, len(first))) + width - 1
            del first, place, head
            row = np.searchsorted(bounds, begin, "right") - 1
            doc, at = rows.column("doc_id").to_numpy()[row], (begin - bounds[row]).astype(np.int32)
            whole = T._range_hashes(hashes, begin, begin + size, _SEGMENT_BASE)
            one, many, copies = M.one_of_each(whole, doc, at)
            after = sent.known(whole[one], doc[one], at[one], many)
            copies = np.concatenate([copies, one[after]])
            one, many = one[~after], many[~after]
            bucket = ((T.mix(gram[one]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # least hashes are small: mixed again
            order = np.lexsort((one, bucket))
            bucket, many, one = bucket[order], many[order], one[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            pairs = list(zip(cuts[:-1], cuts[1:])) if len(bucket) else []
            to = bucket[cuts[:-1]].astype(np.int32) if len(bucket) else np.zeros(0, np.int32)
            small = size.astype(np.uint8 if 2 * width < 256 else np.int32)
            columns = [[x[one[a:b]].tobytes() for a, b in pairs] for x in (doc, at, small)] + [[many[a:b].tobytes() for a, b in pairs]]
            columns += [[x[one[a:b]].tobytes() for a, b in pairs] for x in (gram, whole)]
            low, high = (hashes >> np.uint64(24)).astype(np.uint32), (hashes >> np.uint64(56)).astype(np.uint8)
            places = [_ranges(begin[one[a:b]], size[one[a:b]]) for a, b in pairs]
            columns += [[x[p].tobytes() for p in places] for x in (low, high)]
            kind = np.zeros(len(to), np.int32)
            if len(copies):
                copies = copies[np.lexsort((at[copies], doc[copies]))]
                to, kind = np.append(to, np.int32(int(whole[0]) % buckets)), np.append(kind, np.int32(1))
                for column, x in zip(columns, (doc[copies], at[copies], (size[copies] - width + 1).astype(np.int32), *[at[:0]] * 5)):
                    column.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(kind), *(pa.array(x, pa.binary()) for x in columns)], [f.split()[0] for f in _SEGMENTS.split(", ")])

    return run


def bwt(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of segments, each suffix cut at stops, and the symbol before each suffix (-1 at a segment's start)."""
    order, _ = suffix_array(symbols, stops, int((stops - np.arange(len(stops))).max()))
    start = np.append(True, stops[1:] != stops[:-1])
    before = np.append(np.int64(-1), symbols[:-1])
    before[start] = -1
    return order, before[order]


def interleave(symbols: np.ndarray, stops: np.ndarray, shard: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first width symbols, and their common prefixes with the one before, up to width.

    symbols: 0 .. alphabet - 1, segments end to end; shard: of each position, ascending. Each shard's suffix array and
    transform are built alone; the merge then moves whole blocks by the symbols in the transforms.
    """
    n = len(symbols)
    borders = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [n]])
    rows, transform = [], []
    for a, b in zip(borders[:-1], borders[1:]):
        order, before = bwt(symbols[a:b], stops[a:b] - a)
        rows.append(order + a)
        transform.append(before)
    order, before = np.concatenate(rows), np.concatenate(transform)  # rows of the stacked suffix arrays: position, symbol before
    alphabet = int(symbols.max()) + 1 if n else 0
    tail = np.flatnonzero(stops == np.arange(n) + 1)  # suffixes of one symbol: what precedes the end of a segment
    # pass 1: by the first symbol, shards in turn
    low = symbols.astype(np.uint16)
    high = (symbols >> 16).astype(np.uint16) if alphabet > 1 << 16 else None

    def by_symbol(items: np.ndarray) -> np.ndarray:
        """Stable radix sort of text positions by their symbol."""
        items = items[np.argsort(low[items], kind="stable")]
        return items[np.argsort(high[items], kind="stable")] if high is not None else items

    merged = by_symbol(order)
    fresh = np.append(True, symbols[merged[1:]] != symbols[merged[:-1]]) if n else np.zeros(0, bool)
    lcp = np.where(fresh, 0, width)
    block = np.empty(n, np.int64)
    preceded = np.empty(n, bool)
    preceded[order] = before >= 0
    for h in range(1, width):
        if fresh.all():
            break
        block[merged] = np.cumsum(fresh)
        # one pass: read the transform in merged order; each symbol sends the suffix one longer to its bucket
        sources = merged[preceded[merged]] - 1
        merged = by_symbol(np.concatenate([tail, sources]))
        after = np.where(stops[merged] == merged + 1, 0, block[np.minimum(merged + 1, n - 1)])
        symbol = symbols[merged]
        now = np.append(True, (symbol[1:] != symbol[:-1]) | (after[1:] != after[:-1]))
        lcp[now & ~fresh] = h
        fresh = now
    return merged, lcp


def _solve(gram: np.ndarray, whole: np.ndarray, size: np.ndarray, many: np.ndarray, symbols: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int, shards: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, first window, number of windows, later): runs of repeated windows; later: none is the first of its content.

    Segments whose minimiser is alone are dropped; the others are taken by minimiser, about SLICE symbols at a time, one
    of each content, with all its places.
    """
    offset = np.cumsum(size) - size
    order = np.lexsort((whole, gram))
    fresh = np.append(True, gram[order][1:] != gram[order][:-1]) if len(gram) else np.zeros(0, bool)
    seed = np.cumsum(fresh) - 1
    order = order[(np.bincount(seed, 1 + many[order])[seed] > 1)] if len(gram) else order
    gram, whole, size, many, offset, doc, at = gram[order], whole[order], size[order], many[order], offset[order], doc[order], at[order]
    if not len(gram):
        return
    content = np.append(True, (gram[1:] != gram[:-1]) | (whole[1:] != whole[:-1]))
    before = np.cumsum(np.where(content, size, 0)) - np.where(content, size, 0)
    fresh = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    cuts = fresh[np.append(True, before[fresh][1:] // SLICE != before[fresh][:-1] // SLICE)]
    for a, b in zip(cuts, np.append(cuts[1:], len(gram))):
        heads = np.flatnonzero(content[a:b])
        kind = np.cumsum(content[a:b]) - 1
        words = symbols[_ranges(offset[a:b][heads], size[a:b][heads])]
        several = np.bincount(kind, 1 + many[a:b]) > 1
        yield _solve_slice(gram[a:b][heads], size[a:b][heads], words, several, kind, doc[a:b], at[a:b].astype(np.int64), width, shards)


def _solve_slice(gram: np.ndarray, d_size: np.ndarray, words: np.ndarray, several: np.ndarray, kind: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, d_size, words and several (it has more than one place): of each content; kind, doc and at: of their places."""
    order = np.lexsort((at, doc, kind))
    kind, doc, at = kind[order], doc[order], at[order]
    fresh = np.append(True, kind[1:] != kind[:-1])
    heads = np.flatnonzero(fresh)
    d_offset = np.cumsum(d_size) - d_size
    # seeds that one content holds alone need no order: its copies repeat whole
    _, g = np.unique(gram, return_inverse=True)
    alone = np.bincount(g)[g] == 1
    n_windows = d_size - width + 1
    hit = np.zeros(int(n_windows.sum()), bool)
    lead = np.zeros(len(hit), bool)  # whether the first place of this content is the first of all with this window
    w_at = np.cumsum(n_windows) - n_windows
    solo = np.flatnonzero(alone)
    w = _ranges(w_at[solo], n_windows[solo])
    hit[w] = np.repeat(several[solo], n_windows[solo])
    lead[w] = True
    rest = np.flatnonzero(~alone)
    if len(rest):
        size_r = d_size[rest]
        text = np.unique(words[_ranges(d_offset[rest], size_r)], return_inverse=True)[1].ravel()
        stops = np.repeat(np.cumsum(size_r), size_r)
        seg = np.repeat(np.arange(len(rest)), size_r)
        shard = seg * min(shards, len(rest)) // len(rest)
        merged, lcp = interleave(text, stops, shard, width)
        full = stops[merged] - merged >= width
        group = np.cumsum(lcp < width)
        merged, group = merged[full], group[full]
        s = rest[seg[merged]]
        window = w_at[s] + merged - np.repeat(np.cumsum(size_r) - size_r, size_r)[merged]
        total = np.bincount(group, 1 + several[s])
        hit[window] = total[group] > 1
        order = np.lexsort((at[heads[s]] + window - w_at[s], doc[heads[s]], group))
        lead[window[order[np.append(True, np.diff(group[order]) != 0)]]] = True
    # runs of windows: of each content once for its later places, and split by lead for its first
    segment = np.repeat(np.arange(len(d_size)), n_windows)

    def runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        apart = (segment[1:] != segment[:-1]) | (mark[1:] != mark[:-1])
        first = np.flatnonzero(hit & np.append(True, apart | ~hit[:-1]))
        return first, np.flatnonzero(hit & np.append(apart | ~hit[1:], True)) - first + 1

    run, length = runs(np.zeros(len(hit), bool))
    many = np.bincount(segment[run], minlength=len(d_size))
    begin = np.cumsum(many) - many
    other = kind[~fresh]
    at_run = _ranges(begin[other], many[other])
    later_doc, later_at = np.repeat(doc[~fresh], many[other]), np.repeat(at[~fresh], many[other]) + (run - w_at[segment[run]])[at_run]
    head_run, head_length = runs(lead)
    head_doc, head_at = doc[heads][segment[head_run]], at[heads][segment[head_run]] + head_run - w_at[segment[head_run]]
    return (
        np.concatenate([later_doc, head_doc]), np.concatenate([later_at, head_at]), np.concatenate([length[at_run], head_length]),
        np.concatenate([np.ones(len(later_doc), bool), ~lead[head_run]]),
    )


def _merge_bucket(width: int, shards: int):
    """A partition is one bucket: runs of the places of repeated windows, by document."""
    kinds = (np.int64, np.int32, np.uint8 if 2 * width < 256 else np.int32, np.bool_, np.uint64, np.uint64, np.uint32, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[] for _ in kinds]
        for batch in batches:
            for _, kind, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    d, p, n = (np.frombuffer(x, t) for x, t in zip(blobs, (np.int64, np.int32, np.int32)))
                    yield M.batch(d, p, n, np.ones(len(d), bool))
                else:
                    for column, x in zip(held, blobs):
                        column.append(x)
        joined = []
        for kind in kinds:
            joined.append(np.frombuffer(b"".join(held.pop(0)), kind))
        doc, at, size, many, gram, whole, low, high = joined
        symbols = low.astype(np.uint64)
        symbols |= high.astype(np.uint64) << np.uint64(32)
        del joined, low, high
        for d, p, n, later in _solve(gram, whole, size.astype(np.int64), many, symbols, doc, at, width, shards):
            if len(d):
                order = np.argsort(d, kind="stable")
                yield M.batch(d[order], p[order], n[order], later[order])
        del doc, at, size, many, gram, whole, symbols
        T.release()

    return run


def merged_intervals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """(doc_id, kind, start_token, end_token): maximal unions [start, end) of repeated intervals of width tokens or more.

    kind 'repeat': all places of substrings of at least width tokens that occur more than once in the table.
    kind 'remove': the same without the first place of each window, in the order of (doc_id, start).
    """
    docs = stable(keyed(df, id_col, text_col))
    n = parts(docs)
    seed = min(seed, width)
    buckets = docs.mapInArrow(_cut(width, seed, n), _SEGMENTS).repartitionById(n, F.col("bucket"))
    marks = buckets.mapInArrow(_merge_bucket(width, shards), M.MARKS).repartition(n, "doc_id").sortWithinPartitions("doc_id")
    return marks.mapInArrow(M.unite(width), "doc_id long, kind string, start_token int, end_token int")
