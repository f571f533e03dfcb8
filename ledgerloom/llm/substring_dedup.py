"""Operator 5: substring de-duplication by Rabin-Karp hashes of every window of fixed length in tokens.

Every window of `width` tokens of every document gets a 64-bit hash. Places that a task can tell to be later copies
become runs on the spot (marks.py); one place of each other content goes to a bucket of its hash, so equal ones meet in
one task, which counts them. The shuffle carries 20 bytes a content and chunk, and nothing is sampled, capped or
broadcast. The runs of repeated windows then go to their documents, where they merge into maximal intervals.

Results for edge cases: null and empty texts, and texts of fewer than `width` tokens, have no window and give no row.
Rows without an id are left out. Rows that share an id are one document: a window that both hold is repeated, and
both of its places carry the same id. Texts that differ in white space only are equal. A hash clash has a chance of
about n**2 / 2**65 over n windows. An empty table gives an empty result. Only the id and text columns are read; input
that isn't read straight from files is written to the checkpoint folder first, so that a task run again sees the same
rows in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import marks as M
from ledgerloom.llm import text as T
from ledgerloom.llm.common import fresh, keyed, parts, stable

WIDTH = 40
#: kind 0: contents with a place each, and bits for those that stand for several; 1: runs (docs, at, size) of later copies.
_BUCKETS = "bucket int, kind int, docs binary, at binary, hashes binary, rest binary"


def _scatter(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = M.Sent()
        for rows, data, offsets in T.chunks(batches, "text"):
            starts, ends, bounds = T.tokens(data, offsets)
            first, row = T.windows(bounds, width)
            if not len(first):
                continue
            hashes = T.window_hashes(T.token_hashes(data, starts, ends), first, width)
            docs = rows.column("doc_id").to_numpy()[row]
            at = (first - bounds[row]).astype(np.int32)
            del starts, ends, first, row
            one, many, copies = M.one_of_each(hashes, docs, at)
            after = sent.known(hashes[one], docs[one], at[one], many)
            copies = np.concatenate([copies, one[after]])
            one, many = one[~after], many[~after]
            bucket = ((hashes[one] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
            order = np.lexsort((one, bucket))
            bucket, many, one = bucket[order], many[order], one[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            pairs = list(zip(cuts[:-1], cuts[1:])) if len(bucket) else []
            to = bucket[cuts[:-1]].astype(np.int32) if len(bucket) else np.zeros(0, np.int32)
            columns = [[x[one[a:b]].tobytes() for a, b in pairs] for x in (docs, at, hashes)] + [[np.packbits(many[a:b]).tobytes() for a, b in pairs]]
            kind = np.zeros(len(to), np.int32)
            if len(copies):
                d, p, n, _ = M.runs(docs[copies], at[copies], np.ones(len(copies), bool))
                to, kind = np.append(to, np.int32(int(hashes[0]) % buckets)), np.append(kind, np.int32(1))
                for column, x in zip(columns, (d, p.astype(np.int32), n.astype(np.int32), n[:0])):
                    column.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(kind), *(pa.array(x, pa.binary()) for x in columns)], ["bucket", "kind", "docs", "at", "hashes", "rest"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition is one bucket: runs of the places of repeated windows, by document; later: none comes first."""
    held: list[list[bytes]] = [[], [], [], []]
    for batch in batches:
        for kind, *blobs in zip(*(batch.column(c).to_pylist() for c in ("kind", "docs", "at", "hashes", "rest"))):
            if kind:
                d, p, n = (np.frombuffer(x, t) for x, t in zip(blobs, (np.int64, np.int32, np.int32)))
                yield M.batch(d, p, n, np.ones(len(d), bool))
            else:
                blobs[3] = np.unpackbits(np.frombuffer(blobs[3], np.uint8), count=len(blobs[1]) // 4).tobytes()
                for column, x in zip(held, blobs):
                    column.append(x)
    docs, at, hashes, many = (np.frombuffer(b"".join(x), t) for x, t in zip(held, (np.int64, np.int32, np.uint64, np.uint8)))
    del held
    order = np.argsort(hashes, kind="quicksort")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    repeated = many[order] > 0
    repeated[1:] |= same
    repeated[:-1] |= same
    picked = order[repeated]
    if not len(picked):
        return
    picked = picked[np.lexsort((at[picked], docs[picked], hashes[picked]))]
    h = hashes[picked]
    yield M.batch(*M.runs(docs[picked], at[picked], np.append(False, h[1:] == h[:-1])))
    del docs, at, hashes, many, order, ranked, same, repeated, picked, h
    T.release()


def repeated_intervals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, kind, start_token, end_token): maximal intervals [start, end) of tokens.

    kind 'repeat': the union of all windows that occur more than once in the table, at every place they occur.
    kind 'remove': the union of those that aren't the first place of their content, in the order of (doc_id, start):
    taking these out leaves one copy of each repeated passage.
    """
    docs = stable(keyed(df, id_col, text_col))
    n = parts(docs)
    buckets = docs.mapInArrow(_scatter(width, n), _BUCKETS).repartitionById(n, F.col("bucket"))
    marks = buckets.mapInArrow(_count, M.MARKS).repartition(n, "doc_id").sortWithinPartitions("doc_id")
    return marks.mapInArrow(M.unite(width), "doc_id long, kind string, start_token int, end_token int")


def _cut_out(text_col: str, count_col: str | None, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, text_col):
            starts, ends, bounds = T.tokens(data, offsets)
            keep = np.ones(len(data), bool)
            spans = rows.column(spans_col).to_pylist()
            for i, some in enumerate(spans):
                for s in some or ():
                    a, b = bounds[i] + s["start_token"], min(bounds[i] + s["end_token"], bounds[i + 1])
                    if a < b:
                        keep[starts[a] : starts[b] if b < bounds[i + 1] else ends[b - 1]] = False
            sizes = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
            old = rows.column(text_col)
            text = pa.Array.from_buffers(pa.large_binary(), len(spans), [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(data[keep]))])
            text = pa.compute.if_else(old.is_null(), pa.scalar(None, pa.large_string()), text.cast(pa.large_string())).cast(old.type)
            out = dict(zip(rows.schema.names, rows.columns))
            out[text_col] = text
            if count_col:
                changed = pa.array([bool(s) for s in spans])
                out[count_col] = pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(out[count_col].type), out[count_col])
            del out[spans_col]
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """df with the 'remove' intervals taken out of the text column; n_chars, where there is one, is counted again.

    Rows without such intervals, nulls among them, stay as they are, and so do all rows that share an id: their intervals
    are those of the id, not of one of them. A text that is removed whole becomes ''. The text is shuffled once.
    """
    key, name, spans_col = F.col(f"`{id_col}`").cast("long"), fresh(df, "span_id"), fresh(df, "spans")
    several = df.groupBy(key.alias("doc_id")).count().where("count > 1").select("doc_id")
    spans = repeated_intervals(df, id_col, text_col, width).where("kind = 'remove'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_token", "end_token"))).alias(spans_col))
    spans = spans.join(several, "doc_id", "left_anti").withColumnRenamed("doc_id", name)
    joined = df.join(spans, key == F.col(f"`{name}`"), "left").drop(name)
    return joined.mapInArrow(_cut_out(text_col, "n_chars" if "n_chars" in df.columns else None, spans_col), df.schema)
