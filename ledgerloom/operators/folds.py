"""Ordered folds: operators whose state depends on all rows before, one state a key, streamed through sorted partitions.

Rows are shuffled by key and sorted inside the partition, so memory holds one batch and one state however long a key's
run is; keys run in parallel. Rows of equal order keep no defined order: give an order that is total. Null keys are one
key, and null numbers count as 0. Greedy packing of long runs is not folded row by row: see packing.py.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import GENESIS

Step = Callable[[object, tuple], tuple[object, tuple]]
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def ordered_fold(df: DataFrame, key: str, order: list[str], inputs: list[str], step: Step, outputs: str) -> DataFrame:
    """df with columns added. step(state, values of inputs) gives the next state and the new columns' values.

    The state is None at the first row of each key. outputs: the new columns as DDL of int, long, string and double.
    """
    names, kinds = zip(*(part.split() for part in outputs.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, object()
        for batch in batches:
            found = []
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in inputs)):
                if k != current and not (k is None and current is None):
                    state, current = None, k
                state, out = step(state, tuple(values))
                found.append(out)
            fresh = [pa.array([f[i] for f in found], ARROW[kind]) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *fresh], [*batch.schema.names, *names])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, f"{columns}, {outputs}")


def window_step(seconds: float, threshold: int | None = None) -> Step:
    """Batches opened by their first arrival: (arrival in seconds, size); closed by time, or by size too where given."""

    def step(state, values):  # noqa: ANN001, ANN202
        at, size = float(values[0] or 0), int(values[1] or 0)
        batch, start, used = state or (0, at, 0)
        if state and (at - start > seconds or (threshold is not None and used + size > threshold)):
            batch, start, used = batch + 1, at, 0
        return (batch, start, used + size), (batch,)

    return step


def adaptive_step() -> Step:
    """Batches whose limit follows the mean of the next sizes: 2 MB over 100 KB, 1 MB over 10 KB, else 512 KB."""

    def step(state, values):  # noqa: ANN001, ANN202
        size, mean = int(values[0] or 0), float(values[1] or 0)
        batch, used = state or (0, 0)
        limit = 2 << 20 if mean > 100_000 else 1 << 20 if mean > 10_000 else 512 << 10
        if used and used + size > limit:
            batch, used = batch + 1, 0
        return (batch, used + size), (batch,)

    return step


def chain_step(state, values):  # noqa: ANN001, ANN201
    """Hash chain: own hash in; sequence, previous and chain hash out."""
    sequence, previous = state or (0, GENESIS)
    chain = hashlib.sha256((previous + (values[0] or "")).encode()).hexdigest()
    return (sequence + 1, chain), (sequence, previous, chain)
