"""Store operators: latest versions, duplicates, packed blocks, folders, labels, key-value views, statistics.

Write order is an explicit column everywhere; timestamps never decide. Keyed reductions are max_by aggregates, which
combine before the shuffle, rather than windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import joined_hash
from ledgerloom.operators.packing import SPAN, Rule, pack


def latest(log: DataFrame, key: str = "block_id", order: str = "write_seq") -> DataFrame:
    """The last version of each key in write order."""
    others = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(F.struct(order, *others)).alias("__r")).select(key, f"__r.{order}", *(f"__r.{c}" for c in others))


def valid_prefix(log: DataFrame, bad: Column, order: str = "write_seq") -> DataFrame:
    """Rows before the first invalid one: a scan stops there. One number is broadcast."""
    first = log.where(bad).agg(F.min(order).alias("__stop"))
    return log.crossJoin(F.broadcast(first)).where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop")


def packed(messages: DataFrame, threshold: int = 1 << 16, span: int = SPAN) -> DataFrame:
    """Blocks of each folder's messages in write order: a message costs 4 bytes and its size, and one that would exceed
    the threshold opens a block. Equal to a fold over the whole folder; span only sets how much one task holds."""
    return _packing(messages, Rule(threshold, 4, before=True), span)


def batched(messages: DataFrame, target: int = 1 << 16, span: int = SPAN) -> DataFrame:
    """The same, with blocks closed once their sizes reach the target."""
    return _packing(messages, Rule(target, 0, before=False), span)


def _packing(messages: DataFrame, rule: Rule, span: int) -> DataFrame:
    rows = messages.select("email_id", "folder", "size", "write_seq")
    return pack(rows, F.col("folder"), F.col("write_seq"), F.col("size"), rule, span).select("run", "email_id", "size", "block_no", "local_id")


def batch_blocks(packed_rows: DataFrame) -> DataFrame:
    """One row a block, its table of contents in local order."""
    toc = F.sort_array(F.collect_list(F.struct("local_id", "email_id", "size")))
    return packed_rows.groupBy("run", "block_no").agg(toc.alias("toc"), F.sum(F.col("size") + 4).alias("used"))


def decode_batches(blocks: DataFrame) -> DataFrame:
    return blocks.select("run", "block_no", F.explode("toc").alias("e")).select("run", "block_no", "e.local_id", "e.email_id", "e.size")


def envelope(messages: DataFrame) -> DataFrame:
    return messages.withColumn("envelope_hash", joined_hash(F.col("message_id"), F.col("sender"), F.col("recipient"), F.col("write_seq"), F.col("subject"), F.lit(None), F.lit(None), F.lit(None), F.col("size")))


def content_duplicates(messages: DataFrame) -> DataFrame:
    """Each message and the first one with its content; null bodies are one content. The bodies aren't shuffled."""
    hashed = messages.select("email_id", "write_seq", F.sha2("body", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min_by("email_id", "write_seq").alias("kept_id")).withColumnRenamed("h", "g")
    return hashed.join(first, F.col("h").eqNullSafe(F.col("g"))).select("email_id", "kept_id", (F.col("email_id") != F.col("kept_id")).alias("duplicate"))


def identified(messages: DataFrame) -> DataFrame:
    """Messages whose id, where it's null or blank, is a hash of sender, recipient, subject and body."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("sender", "recipient", "subject", "body")]
    own = F.when(F.trim("message_id") != "", F.col("message_id"))
    return messages.withColumn("message_id", F.coalesce(own, F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", *parts), 256))))


def fresh_only(incoming: DataFrame, stored: DataFrame, key: str = "message_id") -> DataFrame:
    """Incoming rows whose key isn't stored; of several with one key the first in write order. Null keys: see identified."""
    one = incoming.groupBy(key).agg(F.min_by(F.struct(*(c for c in incoming.columns if c != key)), "write_seq").alias("r")).select(key, "r.*")
    return one.join(stored.select(key), key, "left_anti")


def current_folder(messages: DataFrame, moves: DataFrame, deleted: DataFrame) -> DataFrame:
    """Folder of each message after moves (email_id, folder, seq), without the deleted."""
    events = messages.select("email_id", "folder", F.lit(-1).cast("long").alias("seq")).unionByName(moves.select("email_id", "folder", "seq"))
    last = events.groupBy("email_id").agg(F.max_by("folder", "seq").alias("folder"))
    return last.join(messages.select("email_id"), "email_id", "left_semi").join(deleted.select("email_id"), "email_id", "left_anti")


def labels_of(labels: DataFrame) -> DataFrame:
    return labels.distinct().groupBy("email_id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"))


def store_stats(messages: DataFrame, postings: DataFrame) -> DataFrame:
    terms = postings.agg(F.count_distinct("term").alias("indexed_words"), F.sum(F.length("term") + 8).alias("index_size"))
    base = messages.agg(F.count("*").alias("emails"), F.count_distinct("folder").alias("folders"), F.sum("size").alias("data_size"))
    return base.crossJoin(F.broadcast(terms)).withColumn("total_size", F.col("data_size") + F.col("index_size"))


def children(tree: DataFrame, path: str) -> DataFrame:
    """Direct children of a folder: its prefix, and no separator after it."""
    prefix = path + "\\"
    return tree.where(F.col("path").startswith(prefix) & (F.instr(F.substr("path", F.lit(len(prefix) + 1)), "\\") == 0))


def subtree(tree: DataFrame, path: str) -> DataFrame:
    return tree.where((F.col("path") == path) | F.col("path").startswith(path + "\\"))


def create_folders(tree: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, status) of wanted folders: created, exists, no_parent or invalid. Of equal ones in a batch one is created."""
    from ledgerloom.functions.text import folder_parent, folder_valid

    have = tree.select(F.col("path").alias("p"), F.lit(True).alias("have"))
    parents = tree.select(F.col("path").alias("q"), F.lit(True).alias("above"))
    counts = wanted.groupBy("path").agg(F.count("*").alias("n"))
    joined = counts.join(have, F.col("path") == F.col("p"), "left").join(parents, folder_parent(F.col("path")) == F.col("q"), "left")
    status = F.when(~folder_valid(F.col("path")), "invalid").when(F.col("have"), "exists").when((folder_parent(F.col("path")) != "") & F.col("above").isNull(), "no_parent").otherwise("created")
    each = joined.select("path", status.alias("status"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return each.select("path", F.when((F.col("status") == "created") & (F.col("i") > 1), "exists").otherwise(F.col("status")).alias("status"))


def delete_folders(tree: DataFrame, members: DataFrame, wanted: DataFrame, with_messages: bool = False) -> DataFrame:
    """(path, status): refused with children, or with messages unless told otherwise; missing where there is none."""
    from ledgerloom.functions.text import folder_parent

    have = tree.select(F.col("path").alias("p"))
    parents = tree.select(folder_parent(F.col("path")).alias("q")).distinct()
    filled = members.select(F.col("folder").alias("f")).distinct()
    joined = wanted.join(have, F.col("path") == F.col("p"), "left").join(parents, F.col("path") == F.col("q"), "left").join(filled, F.col("path") == F.col("f"), "left")
    status = F.when(F.col("p").isNull(), "missing").when(F.col("q").isNotNull(), "has_children").when(F.col("f").isNotNull() & F.lit(not with_messages), "not_empty").otherwise("deleted")
    return joined.select("path", status.alias("status"))


def move_subtree(tree: DataFrame, path: str, to: str) -> DataFrame:
    """The tree after moving a folder under another; a move into itself or its descendants changes nothing."""
    from ledgerloom.functions.text import folder_name

    if to == path or to.startswith(path + "\\"):
        return tree
    target = tree.where(F.col("path") == to).select(F.col("folder_id").alias("__to")).limit(1)
    inside = (F.col("path") == path) | F.col("path").startswith(path + "\\")
    moved = F.concat(F.lit(to + "\\"), folder_name(F.lit(path)), F.substr("path", F.lit(len(path) + 1)))
    out = tree.join(F.broadcast(target), F.lit(True), "left")
    go = inside & F.col("__to").isNotNull()
    return out.select("folder_id", F.when(go & (F.col("path") == path), F.col("__to")).otherwise(F.col("parent_id")).alias("parent_id"), F.when(go, moved).otherwise(F.col("path")).alias("path"))


def segments(log: DataFrame) -> DataFrame:
    """Segments from a log: version, latest value, metadata merged from all versions (the latest of each key wins)."""
    pair = log.select("block_id", "write_seq", "value", "type", F.get_json_object("payload", "$.k").alias("k"))
    meta = pair.groupBy("block_id", "type").agg(F.max_by("k", "write_seq").alias("k"))
    meta = meta.groupBy("block_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "k")))).alias("metadata"))
    last = pair.groupBy("block_id").agg(F.count("*").alias("version"), F.max_by("value", "write_seq").alias("value"))
    return last.join(meta, "block_id")


def key_values(log: DataFrame, deleted: Column, expired: Column) -> DataFrame:
    """Live pairs of an upsert log: the last write of each key, if it's neither a deletion nor expired."""
    return latest(log).where(~deleted & ~expired)


def newest(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each key, and the others marked as pruned."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("pruned", rank > keep)
