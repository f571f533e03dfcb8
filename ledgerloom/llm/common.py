"""Session settings and plan helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import cut

__all__ = ["cut", "documents", "fresh", "keyed", "kept", "parts", "spread", "stable"]


def _only_reads(df: DataFrame) -> bool:
    """Whether df's plan reads, picks and filters only: from files, rows of the driver, or the checkpoint folder."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in str(plan.toString()).splitlines() if line.strip()]
    leaves = plan.collectLeaves()
    written = all(leaf.rdd().isCheckpointed() for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName() == "LogicalRDD")
    return written and all(n in ("Project", "Filter", "Relation", "LocalRelation", "LogicalRDD") for n in nodes)


def stable(df: DataFrame) -> DataFrame:
    """df if its rows come in one order however often a task runs (it only reads, picks and filters), else df cut."""
    return df if _only_reads(df) else cut(df)


def spread(df: DataFrame) -> DataFrame:
    """df for work that takes long a row: where its files make fewer tasks than there are cores, its rows are dealt out."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _only_reads(df) and df._jdf.rdd().getNumPartitions() < cores else df


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept(df: DataFrame, id_col: str, text_col: str, verdicts: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows of df with an id whose verdict, in the column keep of verdicts' rows (doc_id, text), is true; row by row, no shuffle."""
    at = [df.columns.index(c) for c in (id_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number = pa.array(np.arange(batch.num_rows))
                asked = pa.RecordBatch.from_arrays([number, batch.column(at[1])], ["doc_id", "text"])
                keep = np.concatenate([v.column("keep").to_numpy(zero_copy_only=False) for v in verdicts(iter([asked]))])
                yield batch.filter(pa.array(keep & batch.column(at[0]).is_valid().to_numpy(zero_copy_only=False)))

    return spread(df).mapInArrow(run, df.schema)


def parts(df: DataFrame, each: int = 10 << 20) -> int:
    """Partitions that hold about so many bytes of df's input each; the session's number at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(min(size, 1 << 60) / each)) if size < 1 << 55 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """Only the id, as LONG doc_id, and the columns asked for, as text, text2, ...; rows without an id are left out."""
    picked: list[Column] = [F.col(f"`{id_col}`").cast("long").alias("doc_id")]
    picked += [F.col(f"`{c}`").alias("text" if not i else f"text{i + 1}") for i, c in enumerate(columns)]
    return df.select(*picked).where(F.col("doc_id").isNotNull())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
