"""Operator 4: quality rules on repetition, from a suffix array over the tokens of each document.

Suffix arrays of a whole Arrow chunk are built at once by prefix doubling: ranks start at (document, token), so suffixes
of different documents never tie, and each round sorts only the suffixes that still tie. The rank arrays of all rounds
then give longest common prefixes of neighbours by binary lifting. The longest prefix that a suffix shares with either
neighbour is the longest repeat that starts there; intervals of the LCP array with at least `least` tokens are the
maximal repeats, and the union of their spans is the union of these longest repeats.

Rules, with token case ignored (ASCII). A document goes where its longest repeat has over `max_longest` tokens, where
that or all repeats of `least` tokens or more have at least `max_share` of all its tokens, or where these repeats cover
over `max_fraction` of its tokens. For the last, a longest repeat with exactly two places doesn't count: a header that
returns once as a footer is no fault.

Results for edge cases: null, empty and white-space texts have no token and no repeat: fraction 0.0, longest 0, kept.
Rows without an id are left out. Rows that share an id or text are judged one by one. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import text as T
from ledgerloom.llm.common import kept, keyed, spread

LEAST, MAX_FRACTION, MAX_LONGEST, MAX_SHARE = 5, 0.3, 50, 0.5
_SCHEMA = "doc_id long, n_tokens int, covered_tokens int, longest_repeat int, maximal_repeats int, covered_fraction double, keep boolean"


def _heads(keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index at which the run of each begins."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def suffix_array(symbols: np.ndarray, stops: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes, each cut at stops[i], and ranks by their first 1, 2, 4, ... symbols.

    Suffixes that are equal whole go by position, if longest, the most symbols that one has, is given; without it there
    must be none.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = _heads(symbols[order])
    levels, step = [rank], 1
    tied = np.bincount(rank, minlength=n)[rank[order]] > 1
    members = order[tied]
    while len(members) and (longest is None or step < longest):
        after = np.minimum(members + step, n - 1)
        second = np.where(members + step < stops[members], rank[after] + 1, 0)
        composite = rank[members] * (n + 1) + second
        by = np.argsort(composite, kind="stable")
        members, composite = members[by], composite[by]
        group = rank[members]
        slots = group + np.arange(len(members)) - _heads(group)
        order[slots] = members
        rank = rank.copy()
        heads = _heads(composite)
        rank[members] = slots[heads]
        levels.append(rank)
        step *= 2
        members = members[np.bincount(heads, minlength=len(heads))[heads] > 1]
    return order, levels


def neighbour_lcp(order: np.ndarray, levels: list[np.ndarray], stops: np.ndarray) -> np.ndarray:
    """lcp[i]: symbols that suffixes order[i - 1] and order[i] share; lcp[0] is 0."""
    lcp = np.zeros(len(order), np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, n = order[at - 1], order[at], len(order)
    length = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        equal = (x < stops[a]) & (y < stops[b])
        equal &= levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)]
        length += equal * (1 << k)
    lcp[at] = length
    return lcp


def _maximal(order: np.ndarray, lcp: np.ndarray, left: np.ndarray, least: int, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Number, by document, of intervals of the LCP array of value `least` at least that can't be extended to the left."""
    counts = np.zeros(n_rows, np.int64)
    at = np.flatnonzero(lcp >= least)
    if not len(at):
        return counts
    stack: list[list[int]] = []  # value, whether left symbols differ, one left symbol
    values, lefts, docs = lcp.tolist(), left[order].tolist(), rows[order].tolist()

    def close(to: int, doc: int) -> None:
        while stack and stack[-1][0] > to:
            value, differ, symbol = stack.pop()
            if differ:
                counts[doc] += 1
            if stack and stack[-1][0] >= to:
                stack[-1][1] |= differ | (stack[-1][2] != symbol)
            elif to >= least:
                stack.append([to, differ, symbol])

    previous = -2
    for i in at.tolist():
        if i != previous + 1:
            close(0, docs[previous] if previous >= 0 else 0)
        value = values[i]
        if not stack or value > stack[-1][0]:
            stack.append([value, 0, lefts[i - 1]])
        elif value < stack[-1][0]:
            close(value, docs[i])
        stack[-1][1] |= stack[-1][2] != lefts[i] or lefts[i] < 0
        previous = i
    close(0, docs[previous])
    return counts


def _measure(least: int, max_fraction: float, max_longest: int, max_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, "text"):
            starts, ends, bounds = T.tokens(data, offsets)
            sizes = np.diff(bounds)
            covered, longest, maximal, places = (np.zeros(len(sizes), np.int64) for _ in range(4))
            if len(starts):
                row = np.repeat(np.arange(len(sizes)), sizes)
                symbol = np.unique(T.token_hashes(T.LOWER[data], starts, ends), return_inverse=True)[1].ravel()
                stops = bounds[1:][row]
                order, levels = suffix_array(row * (int(symbol.max()) + 1) + symbol, stops)
                lcp = neighbour_lcp(order, levels, stops)
                reach = np.zeros(len(order), np.int64)
                reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
                np.maximum.at(longest, row, reach)
                places = np.bincount(row[reach == longest[row]], minlength=len(sizes))
                at = np.flatnonzero(reach >= least)
                doc, a, b = T.unions(row[at], at, at + reach[at])
                np.add.at(covered, doc, b - a)
                left = np.where(np.arange(len(row)) > bounds[:-1][row], np.append(-1, symbol[:-1]), -1)
                maximal = _maximal(order, lcp, left, least, row, len(sizes))
            fraction = covered / np.maximum(sizes, 1)
            keep = (longest <= max_longest) & ((np.maximum(longest, covered) < max_share * sizes) | (longest < least))
            keep &= covered - np.where(places == 2, 2 * longest, 0) <= max_fraction * sizes
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(x.astype(np.int32)) for x in (sizes, covered, longest, maximal)), pa.array(fraction), pa.array(keep)],
                ["doc_id", "n_tokens", "covered_tokens", "longest_repeat", "maximal_repeats", "covered_fraction", "keep"],
            )

    return run


def repetition_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, max_share: float = MAX_SHARE) -> DataFrame:
    """One row a document: tokens, tokens in repeats, longest repeat, number of maximal repeats, fraction, verdict."""
    return spread(keyed(df, id_col, text_col)).mapInArrow(_measure(least, max_fraction, max_longest, max_share), _SCHEMA)


def keep_unrepetitive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, max_fraction: float = MAX_FRACTION, max_longest: int = MAX_LONGEST, max_share: float = MAX_SHARE) -> DataFrame:
    """Rows of df whose text passes, each judged by itself; rows without an id go. All columns stay as they are."""
    return kept(df, id_col, text_col, _measure(least, max_fraction, max_longest, max_share))
