"""Structured Streaming ingest, an addition to what the batch operators offer: each batch is appended exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_once(stream: DataFrame, to: str, checkpoint: str, key: str = "message_id", time: str = "ts", late: str = "1 day") -> StreamingQuery:
    """Append the stream's new rows to Parquet, dropping repeats of a key within the watermark, then stop."""
    fresh = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "type") -> DataFrame:
    """Rows for each window and type, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
