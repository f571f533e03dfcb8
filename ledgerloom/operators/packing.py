"""Greedy packing of a run of any length in parallel, with the result of a fold row by row.

A run is cut into spans of its order. Where a block starts, all blocks after it are settled, so what comes before a span
matters only until the span's first new block. Each span works out alone, for every row at which that can be, the state
in which the span ends; a fold over spans (a row each) then gives the state in which each begins, and all spans number
their rows at once. A task holds one span, never a run; rows cross the network twice, as (run, order, size).

Sizes that are null or negative count as 0. Rows of equal order keep no defined order. Null runs are one run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.folds import Step, ordered_fold

SPAN = 100_000
_TABLE = "at binary, blocks binary, used binary, local binary, rows long, total long"


class Rule:
    """Where blocks end. before: a row that would exceed the limit opens a block; else one that reaches it closes its own."""

    def __init__(self, limit: int, prefix: int, before: bool) -> None:
        self.limit, self.prefix, self.before = limit, prefix, before

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.maximum(sizes, 0) + self.prefix)])

    def next_start(self, sums: np.ndarray, base: np.ndarray) -> np.ndarray:
        """First row of the next block, for blocks whose sum at row i is sums[i + 1] - base; rows + 1: none begins."""
        if self.before:
            at = np.searchsorted(sums[1:], base + self.limit, "right")
            return np.where(at == len(sums) - 1, len(sums), at)
        return np.searchsorted(sums[1:], base + self.limit, "left") + 1

    def jumps(self, sums: np.ndarray) -> np.ndarray:
        """The start after each start: a block has one row at least."""
        n = len(sums) - 1
        return np.maximum(self.next_start(sums, sums[:-1]), np.minimum(np.arange(n) + 1, n + 1))


def _ends(rule: Rule, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block that starts at each row (or after the last): blocks from it on, and sum and rows of the last one."""
    n = len(sums) - 1
    jump = rule.jumps(sums).tolist()
    blocks, last = [1] * (n + 1), list(range(n + 1))
    for i in range(n - 1, -1, -1):
        j = jump[i]
        if j < n or (j == n and not rule.before):
            blocks[i], last[i] = blocks[j] + 1, last[j]
    last_ = np.array(last, np.int64)
    return np.array(blocks, np.int64), sums[-1] - sums[last_], n - last_


def _summary(rule: Rule):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sizes = rows.sort_by("__o").column("__z").to_numpy()
        sums = rule.sums(sizes)
        blocks, used, local = _ends(rule, sums)
        most = min(len(sizes), int(rule.next_start(sums, np.array(0)))) + 1  # no block begins later if none began before
        names = [*rows.schema.names[:2], "at", "blocks", "used", "local", "rows", "total"]
        blobs = [pa.array([x[:most].astype(np.int64).tobytes()], pa.binary()) for x in (sums[1 : most + 1], blocks, used, local)]
        return pa.Table.from_arrays([rows.column("__r")[:1], rows.column("__s")[:1], *blobs, pa.array([len(sizes)]), pa.array([int(sums[-1])])], names)

    return run


def _span_step(rule: Rule) -> Step:
    """State: number, rows and sum of the open block. Gives the state at the start of the span."""

    def step(state, values):  # noqa: ANN001, ANN202
        at, blocks, used, local = (np.frombuffer(v, np.int64) for v in values[:4])
        rows, total = values[4:]
        number, held, full = state or (0, 0, 0)
        sums = np.concatenate([[0], at])
        start = int(rule.next_start(sums, np.array(-full))) if held or not rule.before else 0
        if start > rows or start >= len(blocks) or (rule.before and start == rows):
            after = number, held + rows, full + total
        elif not held and rule.before:
            after = number + int(blocks[0]) - 1, int(local[0]), int(used[0])
        else:
            after = number + int(blocks[start]), int(local[start]), int(used[start])
        return after, (number, held, full)

    return step


def _number(rule: Rule):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__o")
        sums = rule.sums(rows.column("__z").to_numpy())
        n = len(sums) - 1
        number, held, full = (rows.column(c)[0].as_py() for c in ("__number", "__held", "__full"))
        jump = rule.jumps(sums).tolist()
        start = int(rule.next_start(sums, np.array(-full))) if held or not rule.before else 0
        fresh = np.zeros(n, np.int64)
        while start < n:
            fresh[start] = 1
            start = jump[start]
        opened = np.cumsum(fresh)
        first = np.maximum.accumulate(np.where(fresh > 0, np.arange(n), -1))
        local = np.where(first >= 0, np.arange(n) - first, np.arange(n) + held)
        block = number + opened - (1 if not held and rule.before else 0)
        keep = [c for c in rows.schema.names if c not in ("__r", "__s", "__o", "__z", "__number", "__held", "__full")]
        return pa.Table.from_arrays([*(rows.column(c) for c in keep), pa.array(block.astype(np.int32)), pa.array(local.astype(np.int32))], [*keep, "block_no", "local_id"])

    return run


def pack(df: DataFrame, run: Column, order: Column, size: Column, rule: Rule, span: int = SPAN) -> DataFrame:
    """df with run, block_no and local_id added; at most `span` different values of order share a span."""
    long = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    rows = df.select("*", run.alias("run")).select("*", F.col("run").alias("__r"), long(order).alias("__o"), long(size).alias("__z"))
    rows = rows.withColumn("__s", F.expr(f"`__o` div {span}"))
    kind = rows.schema["__r"].dataType.simpleString()
    table = rows.select("__r", "__s", "__o", "__z").groupBy("__r", "__s").applyInArrow(_summary(rule), f"__r {kind}, __s long, {_TABLE}")
    begin = ordered_fold(table, "__r", ["__s"], ["at", "blocks", "used", "local", "rows", "total"], _span_step(rule), "__number long, __held long, __full long")
    begin = begin.select(F.col("__r").alias("__r2"), F.col("__s").alias("__s2"), "__number", "__held", "__full")
    joined = rows.join(begin, F.col("__r").eqNullSafe(F.col("__r2")) & (F.col("__s") == F.col("__s2"))).drop("__r2", "__s2")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("__r", "__s", "__o", "__z"))
    return joined.groupBy("__r", "__s").applyInArrow(_number(rule), f"{columns}, block_no int, local_id int")
