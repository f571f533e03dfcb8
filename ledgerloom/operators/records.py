"""Records and their frames: checked reads, locations, transactions, tombstones, the offset registry, store set-up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions.hashing import chain_hash

MAGIC, FOOTER = "LOOMBLCK", "KCLBMOOL"


def framed(log: DataFrame) -> DataFrame:
    """Blocks with what a frame keeps of them: magic at both ends, the CRC of the payload, and its length."""
    size = F.octet_length("payload")
    return log.withColumns({"magic": F.lit(MAGIC), "payload_crc": F.crc32("payload"), "length": size, "footer": F.lit(FOOTER)})


def frame_status(frames: DataFrame) -> Column:
    """ok, or the first check that a read of a frame fails: magic, length, checksum."""
    return (
        F.when((F.col("magic") != MAGIC) | (F.col("footer") != FOOTER), "bad_magic")
        .when(~F.octet_length("payload").eqNullSafe(F.col("length")), "bad_length")
        .when(~F.crc32("payload").eqNullSafe(F.col("payload_crc")), "bad_checksum")
        .otherwise("ok")
    )


def checked_read(frames: DataFrame) -> DataFrame:
    """Frames with their status; the payload of those that fail is null."""
    status = frame_status(frames)
    return frames.withColumn("status", status).withColumn("payload", F.when(F.col("status") == "ok", F.col("payload")))


def archive_report(frames: DataFrame, chain_ok: DataFrame) -> DataFrame:
    """One row: whether headers, checksums and chain (columns invalid, breaks) hold, and all of them."""
    state = frames.select(frame_status(frames).alias("status")).agg(F.count_if(F.col("status").isin("bad_magic", "bad_length")).alias("h"), F.count_if(F.col("status") == "bad_checksum").alias("c"))
    joined = state.crossJoin(F.broadcast(chain_ok.select("invalid", "breaks")))  # a row each
    header, checksums, links = F.col("h") == 0, F.col("c") == 0, (F.col("invalid") == 0) & (F.col("breaks") == 0)
    return joined.select(header.alias("headers_ok"), checksums.alias("checksums_ok"), links.alias("chain_ok"), F.lit(True).alias("signature_ok"), (header & checksums & links).alias("valid"))


def locations(packed: DataFrame, envelopes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where the message of each wanted envelope hash lies: (envelope_hash, email_id, run, block_no, local_id)."""
    found = envelopes.join(wanted.select("envelope_hash").distinct(), "envelope_hash", "left_semi")
    return found.select("email_id", "envelope_hash").join(packed, "email_id").select("envelope_hash", "email_id", "run", "block_no", "local_id")


def duplicate_probe(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(email_id, known) of incoming messages: whether the hash of their envelope is among those stored."""
    have = stored.select("envelope_hash").distinct().withColumn("known", F.lit(True))
    return incoming.select("email_id", "envelope_hash").join(have, "envelope_hash", "left").select("email_id", F.coalesce("known", F.lit(False)).alias("known"))


def moved_versions(messages: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows after moves that store a message again under a new id: the old row names the new one as moved_to."""
    new_id = F.concat("message_id", F.lit("_moved_"), F.col("seq").cast("string"))
    each = moves.select("email_id", F.col("folder").alias("to"), "seq")
    both = messages.select("email_id", "message_id", "folder").join(each, "email_id", "left")
    old = both.select("email_id", "message_id", "folder", F.when(F.col("seq").isNotNull(), new_id).alias("moved_to"))
    return old.unionByName(both.where("seq is not null").select("email_id", new_id.alias("message_id"), F.col("to").alias("folder"), F.lit(None).cast("string").alias("moved_to")))


def transactions(steps: DataFrame, tx: str, order: str, failed: Column) -> DataFrame:
    """What becomes of each step: applied where all of its transaction succeed; else those before the first failure are
    undone, the last first (undo_no 1 first), the failing one is failed, and later ones are skipped."""
    stop = steps.groupBy(F.col(tx).alias("__tx")).agg(F.min(F.when(failed, F.col(order))).alias("__stop"))
    joined = steps.join(stop, F.col(tx).eqNullSafe(F.col("__tx")))
    at = F.col(order)
    status = F.when(F.col("__stop").isNull(), "applied").when(at < F.col("__stop"), "undone").when(at == F.col("__stop"), "failed").otherwise("skipped")
    marked = joined.select(tx, order, status.alias("status"))
    undo = F.row_number().over(W.partitionBy(tx, "status").orderBy(F.desc(order)))
    return marked.select(tx, order, "status", F.when(F.col("status") == "undone", undo).alias("undo_no"))


@dataclass
class Compensation:
    """Driver-side steps with their undoing: where one fails, those done are undone, the last first; errors of undoing are kept.

    with Compensation() as steps: steps.do(write, undo=remove)
    """

    undo: list[Callable[[], object]] = field(default_factory=list)
    errors: list[Exception] = field(default_factory=list)

    def __enter__(self) -> Compensation:
        return self

    def do(self, action: Callable[[], object], undo: Callable[[], object]) -> object:
        result = action()
        self.undo.append(undo)
        return result

    def __exit__(self, kind: type | None, *_: object) -> bool:
        while kind is not None and self.undo:
            try:
                self.undo.pop()()
            except Exception as e:  # undoing goes on: the first error is the one that is raised
                self.errors.append(e)
        return False


def chained_writes(heads: DataFrame, incoming: DataFrame, key: str = "block_id") -> DataFrame:
    """Each incoming block (key, named_head, block_hash) that names its chain's head is appended; any other is a tombstone.

    A chain without a head takes the genesis hash. Of several blocks for a key in one batch give the first only.
    """
    from ledgerloom.functions.hashing import GENESIS

    joined = incoming.join(heads.select(key, "head_hash", "length"), key, "left")
    head = F.coalesce("head_hash", F.lit(GENESIS))
    ok = F.col("named_head") == head
    return joined.select(key, F.coalesce("length", F.lit(0).cast("long")).alias("seq"), F.when(ok, "appended").otherwise("tombstone").alias("status"), F.when(ok, chain_hash(head, F.col("block_hash"))).alias("chain_hash"))


def deletion_markers(ids: DataFrame) -> DataFrame:
    """A marker for each record deleted: (id, seq); a record deleted twice has its first."""
    return ids.groupBy("id").agg(F.min("seq").alias("seq"))


def index_rows(messages: DataFrame, packed: DataFrame) -> DataFrame:
    """The six indexes as rows (index_name, key, email_id): message id, envelope hash, content hash, folder, sender, location."""
    m = messages.join(packed.select("email_id", "run", "block_no", "local_id"), "email_id")
    keys = {
        "message_id": F.col("message_id"), "envelope_hash": F.col("envelope_hash"), "content_hash": F.sha2("body", 256), "folder": F.col("folder"), "sender": F.col("sender"),
        "location": F.concat_ws(":", "run", F.col("block_no").cast("string"), F.col("local_id").cast("string")),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("index_name"), c.alias("key")) for k, c in keys.items()))
    return m.select("email_id", F.explode(pairs).alias("e")).select("e.index_name", "e.key", "email_id")


def registry(log: DataFrame, cleaned: int) -> DataFrame:
    """The offset registry (block_id, offset, outdated) after a log of add, remove and mark, and one cleanup at `cleaned`.

    A removed entry leaves the registry and is outdated; cleanup drops outdated marks of entries that are registered, so
    what was marked before it counts again.
    """
    last = lambda kind: F.max(F.when(F.col("op") == kind, F.col("write_seq")))
    state = log.groupBy("block_id").agg(last("add").alias("a"), last("remove").alias("r"), last("mark").alias("m"))
    low = F.lit(-1).cast("long")
    registered = F.col("a") > F.coalesce("r", low)
    marked = F.greatest(F.coalesce("m", low), F.coalesce("r", low))
    outdated = (marked >= 0) & ~(registered & (marked < cleaned))
    return state.select("block_id", F.when(registered, F.col("a")).otherwise(low).alias("offset"), outdated.alias("outdated")).where((F.col("offset") >= 0) | F.col("outdated"))


NEW_STORE = ((0, "header", '{"version":1}'), (1, "metadata", '{"folders":1}'), (2, "folder_tree", '{"root":-1}'), (3, "wal", "[]"))


def new_store(spark, now: int = 0) -> DataFrame:  # noqa: ANN001
    """The first blocks of a store: header, metadata, folder tree with a root without parent, and an empty log."""
    rows = [F.struct(F.lit(i).cast("long").alias("block_id"), F.lit(now + i).cast("long").alias("write_seq"), F.lit(kind).alias("type"), F.lit(payload).alias("payload")) for i, kind, payload in NEW_STORE]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class MaintenanceSettings:
    """Defaults of maintenance: hours between runs, bytes that start one, least age in hours, versions and backups kept."""

    interval_hours: int = 24
    threshold_bytes: int = 1 << 30
    least_age_hours: int = 24
    key_versions: int = 5
    backups: int = 3
    phases: tuple[tuple[str, int], ...] = (("backup", 10), ("identify", 30), ("verify", 50), ("compact", 80), ("rebuild", 100))


def log_entries(superseded: DataFrame, at: Column) -> DataFrame:
    """Entries for the maintenance log, one for each kind of block: how many superseded blocks go, and how many bytes."""
    each = superseded.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))
    details = F.concat(F.col("n").cast("string"), F.lit(" blocks of "), F.col("type"), F.lit(", "), F.col("bytes").cast("string"), F.lit(" bytes"))
    return each.select(at.alias("timestamp"), F.lit("delete_blocks").alias("operation"), details.alias("details"))


def quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float], nearest: set[str] = frozenset(), cuts: int = 64) -> DataFrame:
    """Exact quantiles of value by key, without holding a key's values in one task: (key, n, one column a share).

    Approximate quantiles cut a key's values into ranges; counts by range tell where each wanted rank lies, and only within
    ranges are values ranked. Quantiles are interpolated; those in `nearest` are sorted[int(n * share)]. Null values are left out.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("__k"), F.col(value).cast("double").alias("__v"))
    edges = rows.groupBy("__k").agg(F.percentile_approx("__v", [i / cuts for i in range(1, cuts)], 1000).alias("__e"), F.count("*").alias("__n"))
    place = F.size(F.filter("__e", lambda e: e < F.col("__v")))
    placed = rows.join(edges.withColumnRenamed("__k", "__k2"), F.col("__k").eqNullSafe(F.col("__k2"))).select("__k", "__v", "__n", place.alias("__b"))
    counts = placed.groupBy("__k", "__b").agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    before = F.sum("__c").over(W.partitionBy("__k").orderBy("__b")) - F.col("__c")
    ranges = counts.select("__k", "__b", "__c", "__n", before.alias("__before"))
    wanted = []
    for name, share in shares.items():
        if name in nearest:
            wanted.append((name, F.least(F.floor(F.col("__n") * share), F.col("__n") - 1), F.lit(1.0)))
        else:
            at = (F.col("__n") - 1) * share
            wanted += [(name, F.floor(at), 1 - (at - F.floor(at))), (name, F.floor(at) + 1, at - F.floor(at))]
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), weight.cast("double").alias("weight")) for name, rank, weight in wanted))
    sought = ranges.select("__k", "__b", "__before", "__c", "__n", F.explode(ranks).alias("w")).where("w.weight > 0 and w.rank >= __before and w.rank < __before + __c")
    hit = sought.select("__k", "__b").distinct().select(F.col("__k").alias("__k3"), F.col("__b").alias("__b3"))
    inside = placed.join(hit, F.col("__k").eqNullSafe(F.col("__k3")) & (F.col("__b") == F.col("__b3")), "left_semi")
    ranked = inside.select(F.col("__k").alias("__k4"), F.col("__b").alias("__b4"), "__v", (F.row_number().over(W.partitionBy("__k", "__b").orderBy("__v")) - 1).alias("__r"))
    found = sought.join(ranked, F.col("__k").eqNullSafe(F.col("__k4")) & (F.col("__b") == F.col("__b4")) & (F.col("w.rank") - F.col("__before") == F.col("__r")))
    out = [F.sum(F.when(F.col("w.name") == name, F.col("w.weight") * F.col("__v"))).alias(name) for name in shares]
    return found.groupBy("__k", "__n").agg(*out).select(F.col("__k").alias(key), F.col("__n").alias("n"), *shares)


def ranked(rows: DataFrame, key: str, order: str, span: int = 1 << 16) -> DataFrame:
    """rows with rank, from 0 by order within each key, and n, the key's rows. Rows are ranked within ranges of `span` of
    order and the ranges by their counts, so no task holds more of a key than a range. order: whole numbers."""
    cut = rows.withColumn("__o", F.col(order).cast("long")).withColumn("__s", F.expr(f"__o div {span}"))
    counts = cut.groupBy(key, "__s").agg(F.count("*").alias("__c"))
    w = W.partitionBy(key)
    begins = counts.select(F.col(key).alias("__k"), F.col("__s").alias("__s2"), (F.sum("__c").over(w.orderBy("__s")) - F.col("__c")).alias("__before"), F.sum("__c").over(w).alias("n"))
    joined = cut.join(begins, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__s") == F.col("__s2")))
    rank = F.col("__before") + F.row_number().over(W.partitionBy(key, "__s").orderBy(order)) - 1
    return joined.select(*(F.col(c) for c in rows.columns), rank.alias("rank"), "n")


def quarters(rows: DataFrame, key: str, order: str, span: int = 1 << 16) -> DataFrame:
    """rows with quarter, as ntile(4) over each key's rows by order gives it."""
    rank, each, extra = F.col("rank"), F.floor(F.col("n") / 4), F.col("n") % 4
    long = extra * (each + 1)  # ranks in the longer quarters
    quarter = F.when(rank < long, F.floor(rank / (each + 1))).otherwise(extra + F.floor((rank - long) / F.greatest(each, F.lit(1))))
    return ranked(rows, key, order, span).select(*(F.col(c) for c in rows.columns), (quarter + 1).cast("int").alias("quarter"))
