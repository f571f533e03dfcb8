"""Canonical views of the test tables as a message store, in Spark and as common table expressions for the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("email_id"), F.concat(F.lit("doc-"), "doc_id").alias("message_id"), F.col("source").alias("folder"), F.substring("text", 1, 60).alias("subject"),
        F.col("lang").alias("sender"), F.col("source").alias("recipient"), F.col("text").alias("body"), F.col("n_chars").alias("size"), F.col("doc_id").alias("write_seq"),
    )


def block_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("block_id"), F.col("event_id").alias("write_seq"), F.col("event_type").alias("type"), "ts", "value", F.col("props").alias("payload"))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    roots = region.select(F.col("r_regionkey").cast("long").alias("folder_id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("path"))
    children = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1000).cast("long").alias("folder_id"), F.col("r_regionkey").cast("long").alias("parent_id"), F.concat("r_name", F.lit("\\"), "n_name").alias("path")
    )
    return roots.unionByName(children)


def update_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """original -> new version of the records of a user, all of them."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("original"))
    return e.where("original is not null").select("original", F.col("event_id").alias("new"))


MESSAGES = """emails AS (SELECT doc_id AS email_id, 'doc-' || doc_id AS message_id, source AS folder, substring(text, 1, 60) AS subject,
  lang AS sender, source AS recipient, text AS body, n_chars AS size, doc_id AS write_seq FROM documents)"""
BLOCKS = "blocks AS (SELECT user_id AS block_id, event_id AS write_seq, event_type AS type, ts, value, props AS payload FROM events)"
TREE = """tree AS (SELECT CAST(r_regionkey AS BIGINT) AS folder_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS path FROM region UNION ALL
  SELECT CAST(n_nationkey + 1000 AS BIGINT), CAST(r_regionkey AS BIGINT), r_name || chr(92) || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"""
LINKS = """links AS (SELECT original, event_id AS new FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS original FROM events)
  WHERE original IS NOT NULL)"""
CUTS = r"""'[ \t\n\r.,!?;:"''()\[\]{}]+'"""
POSTINGS = f"""postings AS (SELECT DISTINCT email_id, unnest(list_filter(string_split_regex(lower(body), {CUTS}), lambda x: length(x) >= 3)) AS term FROM emails)"""
