"""Hash chains, Merkle roots, existence proofs, version links, checkpoints, orphans and compaction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import GENESIS, chain_hash, joined_hash
from ledgerloom.operators.folds import chain_step, ordered_fold
from ledgerloom.operators.records import ranked
from ledgerloom.session import cut

HOPS = 100


def block_hashes(log: DataFrame) -> DataFrame:
    """Hash of each block over its header fields and payload in a canonical text form, block by block in parallel."""
    own = joined_hash(F.col("block_id"), F.col("write_seq"), F.col("type"), F.col("payload"))
    return log.select("block_id", "write_seq", own.alias("block_hash"))


def hash_chain(hashes: DataFrame, key: str = "block_id") -> DataFrame:
    """Chains of hashes, one a key, in write order: only 64 hex digits a block pass through the fold."""
    return ordered_fold(hashes, key, ["write_seq"], ["block_hash"], chain_step, "seq long, previous_hash string, chain_hash string")


def verify_links(chain: DataFrame, key: str = "block_id", also: tuple[str, ...] = ()) -> DataFrame:
    """Each entry with whether its chain hash is right and its predecessor's hash is the one it names.

    The predecessor comes from a window, not from a second copy of the chain, so the chain is folded once.
    """
    w = W.partitionBy(key).orderBy("seq")
    hash_ok = chain_hash(F.col("previous_hash"), F.col("block_hash")) == F.col("chain_hash")
    before = F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag("chain_hash").over(w)).when(F.col("seq") == 0, F.lit(GENESIS))
    return chain.select(key, "seq", *also, hash_ok.alias("hash_ok"), F.coalesce(F.col("previous_hash") == before, F.lit(False)).alias("link_ok"))


def entry_pairs(chain: DataFrame, key: str = "block_id") -> DataFrame:
    """Each entry that has a successor, and whether that names its hash."""
    w = W.partitionBy(key).orderBy("seq")
    after = F.when(F.lead("seq").over(w) == F.col("seq") + 1, F.lead("previous_hash").over(w))
    return chain.select(key, "seq", (F.col("chain_hash") == after).alias("linked")).where("linked is not null")


def chain_summary(chain: DataFrame, key: str = "block_id") -> DataFrame:
    ok = verify_links(chain, key)
    return ok.agg(F.count("*").alias("entries"), F.count_if(~F.col("hash_ok")).alias("invalid"), F.count_if(~F.col("link_ok")).alias("breaks"))


def heads(chain: DataFrame, key: str = "block_id") -> DataFrame:
    return chain.groupBy(key).agg(F.max_by("chain_hash", "seq").alias("head_hash"), (F.max("seq") + 1).alias("length"))


def merkle_roots(chain: DataFrame, key: str = "block_id") -> DataFrame:
    """Merkle root of each chain: pairs of hex strings are hashed, an odd one with itself, until one is left.

    Levels follow the longest chain; each is one aggregate that halves the rows, and keys stay in their partitions.
    """
    chain = cut(chain.select(key, "seq", F.col("chain_hash").alias("h")))
    longest = chain.agg(F.max("seq")).first()[0]
    level = chain.join(chain.groupBy(key).agg((F.max("seq") + 1).alias("n")), key)
    for _ in range(max(0, math.ceil(math.log2((longest or 0) + 1)))):
        pair = F.sha2(F.concat(F.min_by("h", "seq"), F.max_by("h", "seq")), 256)
        root = F.first("n") == 1
        level = level.groupBy(key, F.floor(F.col("seq") / 2).alias("seq")).agg(F.when(root, F.min_by("h", "seq")).otherwise(pair).alias("h"), F.floor((F.first("n") + 1) / 2).alias("n"))
    return level.select(key, F.col("h").alias("merkle_root"))


def existence_proofs(chain: DataFrame, key: str = "block_id") -> DataFrame:
    """Entry, root of its chain and a digest over both that stands for a signature."""
    chain = cut(chain)  # read twice, folded once
    joined = chain.join(merkle_roots(chain, key), key)
    return joined.select(key, "seq", "block_hash", "chain_hash", "merkle_root", F.sha2(F.concat("block_hash", "chain_hash", "merkle_root"), 256).alias("signature"))


def current_versions(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, current, hops): the end of the chain of updates from each start, HOPS steps at most.

    Pointer doubling: each round joins the links with themselves, so log2(HOPS) rounds do, whatever the lengths. Each
    level is written once and read for the next and for the walk.
    """
    step = links.select(F.col("original").alias("a"), F.col("new").alias("b"), F.lit(1).alias("n"))
    state = starts.select(F.col("id").alias("start"), F.col("id").alias("current"), F.lit(0).alias("hops"))
    levels = [cut(step)]
    for _ in range(int(math.log2(HOPS))):
        far = levels[-1].select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
        levels.append(cut(levels[-1].join(far, "b").select("a", F.col("c").alias("b"), (F.col("n") + F.col("m")).alias("n"))))
    for level in reversed(levels):
        joined = state.join(level, F.col("current") == F.col("a"), "left")
        go = F.col("a").isNotNull() & (F.col("hops") + F.col("n") <= HOPS)
        state = joined.select("start", F.when(go, F.col("b")).otherwise(F.col("current")).alias("current"), F.when(go, F.col("hops") + F.col("n")).otherwise(F.col("hops")).alias("hops"))
    return state


def history(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, version, hops): every version that follows each start, to the end of its chain or to a cycle.

    Each round adds the versions up to twice as far by links of twice the length, until there are no new ones.
    """
    step = cut(links.select(F.col("original").alias("a"), F.col("new").alias("b")).distinct())
    found = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("version"), F.lit(0).alias("hops")).distinct())
    span, n = 1, found.count()
    while True:
        far = found.join(step, F.col("version") == F.col("a")).select("start", F.col("b").alias("version"), (F.col("hops") + span).alias("hops"))
        found = cut(found.unionByName(far).groupBy("start", "version").agg(F.min("hops").alias("hops")))
        more = found.count()
        if more == n:
            return found
        span, n = 2 * span, more
        step = cut(step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct())


def block_status(ids: DataFrame, links: DataFrame, deletes: DataFrame) -> DataFrame:
    out = ids.join(links.select(F.col("original").alias("id"), F.col("new").alias("updated_to")), "id", "left")
    return out.join(deletes.select("id", F.lit(True).alias("gone")), "id", "left").select("id", "updated_to", F.coalesce("gone", F.lit(False)).alias("deleted"))


def checkpoint_candidates(log: DataFrame, types: list[str], least_size: int, before: Column) -> DataFrame:
    return log.where(F.col("type").isin(types) & (F.octet_length("payload") >= least_size) & (F.col("ts") < before))


def checkpoints(log: DataFrame, base: int = 1_000_000_000_000) -> DataFrame:
    """Checkpoint copies of blocks: new ids above base, numbered in write order within their original."""
    return checkpoint_history(log, base).select("original_id", "checkpoint_id", "seq", "payload")


def checkpoint_history(log: DataFrame, base: int = 1_000_000_000_000) -> DataFrame:
    """The same with latest: whether no later one has the same original. A row each, however many an original has."""
    rows = ranked(log.select("block_id", "write_seq", "payload"), "block_id", "write_seq")
    return rows.select(F.col("block_id").alias("original_id"), (F.lit(base) + F.col("write_seq")).alias("checkpoint_id"), (F.col("rank") + 1).cast("int").alias("seq"), "payload", (F.col("rank") == F.col("n") - 1).alias("latest"))


def recover(blocks: DataFrame, marks: DataFrame, readable: Column) -> DataFrame:
    """(block_id, payload, source): the block's own payload where it's readable, else its newest readable checkpoint's."""
    best = marks.where(F.col("checkpoint_ok")).groupBy("original_id").agg(F.max_by("payload", "seq").alias("saved"))
    joined = blocks.join(best, F.col("block_id") == F.col("original_id"), "left")
    source = F.when(readable, "block").when(F.col("saved").isNotNull(), "checkpoint").otherwise("lost")
    return joined.select("block_id", F.when(readable, F.col("payload")).otherwise(F.col("saved")).alias("payload"), source.alias("source"))


def orphans(blocks: DataFrame, references: DataFrame, never: list[str]) -> DataFrame:
    """Blocks that nothing refers to, but for types that are never orphans."""
    return blocks.where(~F.col("type").isin(never)).join(references.select("block_id").distinct(), "block_id", "left_anti")


def compaction(log: DataFrame) -> DataFrame:
    """Sizes before and after keeping the latest version of each block, and what that frees."""
    size = F.octet_length("payload") + 61
    kept = log.groupBy("block_id").agg(F.max_by(size, "write_seq").alias("kept"), F.sum(size).alias("whole"))
    return kept.agg(F.sum("whole").alias("original_size"), F.sum("kept").alias("final_size"), (F.sum("whole") - F.sum("kept")).alias("reclaimed"))
