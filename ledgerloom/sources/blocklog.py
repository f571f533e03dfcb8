"""Readers and writers of files: magic-number scan of foreign logs, JSON transaction logs, Parquet block logs, archives."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.store import latest

LOG_ENTRY = "timestamp timestamp, operation string, details string, metadata map<string,string>"


def magic_positions(spark: SparkSession, path: str, magic: bytes, span: int = 64 << 20) -> DataFrame:
    """(file, position) of every occurrence of magic, overlapping ones too, in the files under path.

    Files are only listed by Spark; ranges of span bytes, which reach into the next by one byte less than magic has, are
    read where they are searched, so a file of any size is many rows and tasks.
    """
    pattern = b"(?=" + re.escape(magic) + b")"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))):
                system, place = pafs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    content = file.read_at(min(span + len(magic) - 1, size - start), start)
                at = [start + m.start() for m in re.finditer(pattern, content) if m.start() < span]
                yield pa.RecordBatch.from_arrays([pa.array([place.rsplit("/", 1)[-1]] * len(at), pa.string()), pa.array(at, pa.int64())], ["file", "position"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(span).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInArrow(run, "file string, position long")


def append_blocks(blocks: DataFrame, path: str) -> None:
    """Append a batch of blocks; write_seq must have been given at ingest. The write is the flush."""
    blocks.write.mode("append").partitionBy("type").parquet(path)


def compact_blocks(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite the latest version of each block to another folder; switch readers to it when that has ended."""
    latest(spark.read.parquet(path)).write.partitionBy("type").parquet(to)


def append_log(entries: DataFrame, path: str) -> None:
    entries.select(F.to_json(F.struct("timestamp", "operation", "details", "metadata")).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-lines log; malformed lines are left out."""
    return spark.read.text(path).select(F.from_json("value", LOG_ENTRY).alias("e")).where("e.operation is not null").select("e.*")


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last n entries, oldest first."""
    return read_log(spark, path).orderBy(F.desc("timestamp")).limit(n).orderBy("timestamp")


def open_archive(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A block log for reading, and the metadata of its block 1, or defaults; the folder must exist."""
    blocks = spark.read.parquet(path)
    row = latest(blocks.where("block_id = 1")).select("payload").first()
    return blocks, {"version": "1", "metadata": row["payload"] if row else "{}"}


def save_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
