"""A stored inverted index: postings as Parquet files, so that a search reads those of its terms and no text.

Rows (term, email_id) lie in folders by a hash of the term, whose number follows the table: a folder holds the postings
of about SHARD_BYTES of messages, whatever their number. A lookup names its folders as a partition filter and its terms
as a pushed filter, so it reads a folder a term. Rows are ordered by folder only: one whole number, which Spark sorts by
its digits, where terms took comparisons of whole rows and most of the time of a build. While the index is written,
adaptive execution splits large folders over tasks, so a term that most messages have fills several files and no task.
Envelopes lie beside it, without bodies. New messages are appended as more files.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import shared_folder

POSTINGS, ENVELOPES = "term string, email_id long, shard int", "email_id long, message_id string, subject string, sender string, folder string"
SHARD_BYTES, ROW_GROUP = 8 << 20, 4 << 20
#: Raised when tokens, keys or files change, so that no index of an older form is read.
FORMAT = 2


def shard_of(term: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards)).cast("int")


def append_index(postings: DataFrame, folder: str, shards: int, mode: str = "append") -> None:
    """Write postings as files of the index in folder; those of messages that it has already would count twice."""
    rows = postings.select("term", F.col("email_id").cast("long").alias("email_id"), shard_of(F.col("term"), shards).alias("shard"))
    rows = rows.hint("rebalance", F.col("shard")).sortWithinPartitions("shard")
    rows.write.mode(mode).partitionBy("shard").option("parquet.block.size", ROW_GROUP).parquet(folder)


def read_index(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """Postings (term, email_id) of a stored index; having() finds its folders by the column shard."""
    return spark.read.schema(POSTINGS).parquet(folder).withMetadata("shard", {"shards": shards})


def having(postings: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Postings of the terms. Of a stored index only their folders are read."""
    terms = list(dict.fromkeys(terms))
    found = postings.where(F.col("term").isin(terms))
    if "shard" in postings.columns and terms:
        shards = postings.schema["shard"].metadata["shards"]
        found = found.where(reduce(Column.__or__, [F.col("shard") == shard_of(F.lit(t), shards) for t in terms]))
    return found.select("term", "email_id")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _source(df: DataFrame) -> tuple[str, int]:
    """A name for the present files of df by path, size and time, and their bytes; one listing a folder."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders = sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()})
    files = set(df.inputFiles())
    digest, total = hashlib.sha256(), 0
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(conf).listStatus(path):
            name = status.getPath().toUri().getPath()
            if any(f.endswith(name) for f in files) if len(files) < 100 else True:
                digest.update(f"{name}|{status.getLen()}|{status.getModificationTime()}\n".encode())
                total += status.getLen()
    return digest.hexdigest()[:24], total


def stored(messages: DataFrame, postings: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Postings and envelopes of the stored index of messages, which is built at the first call for these files."""
    spark = messages.sparkSession
    name, size = _source(messages)
    shards = max(8, math.ceil(size / SHARD_BYTES))
    folder = f"{shared_folder(spark)}/ledgerloom-index/v{FORMAT}-{name}"
    if not _exists(spark, f"{folder}/{kind}/_SUCCESS"):
        append_index(postings, f"{folder}/{kind}", shards, "overwrite")  # what a lost driver left has no _SUCCESS
    if not _exists(spark, f"{folder}/envelopes/_SUCCESS"):
        messages.select("email_id", "message_id", "subject", "sender", "folder").write.mode("overwrite").parquet(f"{folder}/envelopes")
    return read_index(spark, f"{folder}/{kind}", shards), spark.read.schema(ENVELOPES).parquet(f"{folder}/envelopes")
