"""Registered queries of integrity, versions, maintenance and analysis, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import integrity as I
from ledgerloom.operators import search as S
from ledgerloom.operators import store as O
from ledgerloom.operators.folds import adaptive_step, ordered_fold, window_step
from ledgerloom.plans.views import BLOCKS, CUTS, LINKS, MESSAGES, block_log, messages, table, update_links

_B, _M = f"WITH {BLOCKS}", f"WITH {MESSAGES}"
_CHAINED = f"""WITH RECURSIVE {BLOCKS}, h AS (SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY write_seq) - 1 AS seq, write_seq,
sha256(block_id || '|' || write_seq || '|' || type || '|' || payload) AS block_hash FROM blocks),
c AS (SELECT block_id, seq, write_seq, block_hash, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || block_hash) AS chain_hash FROM h WHERE seq = 0
UNION ALL SELECT h.block_id, h.seq, h.write_seq, h.block_hash, c.chain_hash, sha256(c.chain_hash || h.block_hash) FROM c JOIN h ON h.block_id = c.block_id AND h.seq = c.seq + 1)"""
_MERKLE = f"""{_CHAINED}, top AS (SELECT block_id, max(seq) + 1 AS n FROM c GROUP BY block_id),
m AS (SELECT c.block_id, 0 AS lvl, CAST(c.seq AS BIGINT) AS i, c.chain_hash AS h, CAST(t.n AS BIGINT) AS n FROM c JOIN top t USING (block_id)
UNION ALL SELECT block_id, lvl, i, h, n FROM (SELECT block_id, lvl + 1 AS lvl, i // 2 AS i, sha256(h || coalesce(lead(h) OVER (PARTITION BY block_id ORDER BY i), h)) AS h, (n + 1) // 2 AS n, i AS was FROM m WHERE n > 1) WHERE was % 2 = 0)"""
_ROOTS = f"{_MERKLE}, roots AS (SELECT block_id, h AS merkle_root FROM m WHERE n = 1)"
_FAR = "TIMESTAMP '2024-01-10'"


def _chain(s, d):  # noqa: ANN001, ANN202
    return I.hash_chain(I.block_hashes(block_log(s, d)))


def _tampered(s, d):  # noqa: ANN001, ANN202
    c = _chain(s, d)
    return c.withColumn("block_hash", F.when((F.col("block_id") == 42) & (F.col("seq") == 3), F.sha2(F.lit("changed"), 256)).otherwise(F.col("block_hash")))


def _starts(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("id")).select("id")


def _sizes(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), F.col("source").alias("category"))


def _arrivals(s, d):  # noqa: ANN001, ANN202
    e = table(s, d, "events")
    return e.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.round(F.col("value") * 1000)).cast("long").alias("size"))


def _next_mean(s, d):  # noqa: ANN001, ANN202
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(0, 49)
    return _arrivals(s, d).withColumn("mean", F.avg("size").over(w))


def _references(s, d):  # noqa: ANN001, ANN202
    return block_log(s, d).select(F.get_json_object("payload", "$.k").cast("long").alias("block_id"))


def _marks(s, d):  # noqa: ANN001, ANN202
    return I.checkpoints(block_log(s, d)).withColumn("checkpoint_ok", F.col("checkpoint_id") % 3 != 0)


def _bucket(size):  # noqa: ANN001, ANN202
    out = F.lit("over 100K")
    for top in (100, 50, 25, 10, 5, 1):
        out = F.when(size <= top * 1024, f"to {top}K").otherwise(out)
    return out


def _distribution(s, d):  # noqa: ANN001, ANN202
    sizes = _sizes(s, d)
    total = sizes.agg(F.count("*").alias("n"))
    return sizes.groupBy(_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("n_in"), F.min("size").alias("least"), F.max("size").alias("most")).crossJoin(F.broadcast(total)).select("bucket", "n_in", "least", "most", (F.col("n_in") * 100.0 / F.col("n")).alias("percent"))


def _upper_median(s, d):  # noqa: ANN001, ANN202
    """sorted[n / 2] by counts of values: one row a distinct size, not one a message, goes through the window."""
    counts = _sizes(s, d).groupBy("category", "size").agg(F.count("*").alias("n"))
    w = W.partitionBy("category")
    below = F.sum("n").over(w.orderBy("size"))
    ranked = counts.select("category", "size", below.alias("upto"), F.sum("n").over(w).alias("all"))
    return ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("category").agg(F.min("size").alias("median"))


def _snapshots(s, d):  # noqa: ANN001, ANN202
    day = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))
    return day.select("day", "n", "bytes", (F.col("bytes") - F.lag("bytes").over(W.orderBy("day"))).alias("growth"))  # one row a day


QUERIES = {
    "ch1_block_hashes": lambda s, d: I.block_hashes(block_log(s, d)),
    "ch2_hash_chain": lambda s, d: _chain(s, d).select("block_id", "seq", "previous_hash", "chain_hash"),
    "ch3_verify_entries": lambda s, d: I.verify_links(_tampered(s, d)),
    "ch4_verify_chain": lambda s, d: I.chain_summary(_tampered(s, d)),
    "ch5_merkle_roots": lambda s, d: I.merkle_roots(_chain(s, d)),
    "ch6_heads": lambda s, d: I.heads(_chain(s, d)),
    "ch8_verified_read": lambda s, d: (
        block_log(s, d)
        .join(I.verify_links(_tampered(s, d), also=("write_seq",)).where("hash_ok and link_ok").select("block_id", "write_seq"), ["block_id", "write_seq"])
        .select("block_id", "write_seq", "type")
    ),
    "ch9_archive_verification": lambda s, d: (
        I.chain_summary(_chain(s, d))
        .select((F.col("invalid") == 0).alias("hashes_ok"), (F.col("breaks") == 0).alias("links_ok"), ((F.col("invalid") == 0) & (F.col("breaks") == 0)).alias("valid"))
    ),
    "ch10_existence_proofs": lambda s, d: I.existence_proofs(_chain(s, d)),
    "snk6_chain_export": lambda s, d: _chain(s, d).where("seq between 2 and 5").select("block_id", "seq", "block_hash", "chain_hash"),
    "snk7_proof_json": lambda s, d: I.heads(_chain(s, d)).select("block_id", F.to_json(F.struct("block_id", "head_hash", "length")).alias("json")),
    "jn7_entry_pairs": lambda s, d: I.entry_pairs(_chain(s, d)),
    "jn8_chain_entry_or_none": lambda s, d: (
        table(s, d, "orders")
        .select(F.col("o_orderkey").alias("block_id"))
        .join(I.heads(_chain(s, d)), "block_id", "left")
        .select("block_id", "head_hash")
    ),
    "agg4_archive_stats": lambda s, d: (
        block_log(s, d)
        .groupBy("type")
        .agg(F.count("*").alias("n"), F.max("write_seq").alias("last_seq"), F.max_by("payload", "write_seq").alias("last_payload"))
    ),
    "ver1_updates": lambda s, d: update_links(s, d),
    "ver3_current": lambda s, d: I.current_versions(update_links(s, d), _starts(s, d)),
    "ver4_history": lambda s, d: I.history(update_links(s, d), _starts(s, d)),
    "ver5_status": lambda s, d: (
        I.block_status(table(s, d, "events").select(F.col("event_id").alias("id")), update_links(s, d), table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id")))
    ),
    "cp1_checkpoints": lambda s, d: (
        I.checkpoints(I.checkpoint_candidates(block_log(s, d), ["click", "view"], 8, F.lit("2024-01-10").cast("timestamp")))
    ),
    "cp2_recover": lambda s, d: I.recover(O.latest(block_log(s, d)), _marks(s, d), F.col("block_id") % 2 == 0),
    "cp3_history": lambda s, d: I.checkpoint_history(block_log(s, d)).select("original_id", "checkpoint_id", "seq", "latest"),
    "cp4_prune": lambda s, d: (
        O.newest(I.checkpoints(block_log(s, d)), "original_id", "seq", 3)
        .groupBy("original_id")
        .agg(F.count_if("pruned").alias("pruned"), F.count_if(~F.col("pruned")).alias("kept"))
    ),
    "tk3_newest": lambda s, d: O.newest(block_log(s, d), "block_id", "write_seq", 3).where("not pruned").select("block_id", "write_seq"),
    "mnt1_superseded": lambda s, d: (
        block_log(s, d)
        .join(O.latest(block_log(s, d)).select("block_id", "write_seq"), ["block_id", "write_seq"], "left_anti")
        .select("block_id", "write_seq", "type")
    ),
    "mnt2_orphans": lambda s, d: I.orphans(O.latest(block_log(s, d)), _references(s, d), ["signup"]).select("block_id", "type"),
    "jn5_orphan_anti_join": lambda s, d: I.orphans(O.latest(block_log(s, d)), _references(s, d), []).select("block_id"),
    "jn6_referenced": lambda s, d: O.latest(block_log(s, d)).join(_references(s, d).distinct(), "block_id", "left_semi").select("block_id"),
    "mnt4_compaction": lambda s, d: I.compaction(block_log(s, d)),
    "mnt5_backups": lambda s, d: O.newest(block_log(s, d), "type", "write_seq", 3).where("not pruned").select("type", "write_seq"),
    "mnt6_reindex": lambda s, d: O.latest(block_log(s, d)).select("block_id", "write_seq"),
    "agg7_distribution": _distribution,
    "agg7_upper_median": _upper_median,
    "agg8_categories": lambda s, d: (
        _sizes(s, d)
        .groupBy("category")
        .agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.floor(F.sum("size") / F.count("*")).alias("mean"))
    ),
    "agg10_time_batches": lambda s, d: (
        ordered_fold(_arrivals(s, d), "user_id", ["event_id"], ["at", "size"], window_step(86_400.0), "batch int")
        .select("user_id", "event_id", "batch")
    ),
    "agg11_size_or_time": lambda s, d: (
        ordered_fold(_arrivals(s, d), "user_id", ["event_id"], ["at", "size"], window_step(86_400.0, 50_000), "batch int")
        .select("user_id", "event_id", "batch")
    ),
    "agg12_adaptive_batches": lambda s, d: (
        ordered_fold(_next_mean(s, d), "user_id", ["event_id"], ["size", "mean"], adaptive_step(), "batch int")
        .select("user_id", "event_id", "batch")
    ),
    "agg13_fill_rate": lambda s, d: (
        O.packed(messages(s, d))
        .groupBy("run", "block_no")
        .agg(F.sum(F.col("size") + 4).alias("used"))
        .groupBy("run")
        .agg((F.sum("used") * 100.0 / (F.count("*") * 65536)).alias("fill_percent"))
    ),
    "agg20_snapshots": _snapshots,
    "jn10_both_differences": lambda s, d: (
        S.postings(messages(s, d))
        .where("term = 'with'")
        .select("email_id")
        .exceptAll(messages(s, d).where("folder = 'src0'").select("email_id"))
        .select("email_id", F.lit("extra").alias("side"))
        .unionByName(messages(s, d).where("folder = 'src0'").select("email_id").exceptAll(S.postings(messages(s, d)).where("term = 'with'").select("email_id")).select("email_id", F.lit("missing").alias("side")))
    ),
}

_L = f"{_B}, l AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY write_seq DESC) = 1)"
_REF = "r AS (SELECT DISTINCT CAST(json_extract(payload, '$.k') AS BIGINT) AS ref FROM blocks)"
_BAD = "block_id = 42 AND seq = 3"
_ARR = "a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS at, CAST(round(value * 1000) AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)"
_BUCKETS = "CASE " + " ".join(f"WHEN n_chars <= {k * 1024} THEN 'to {k}K'" for k in (1, 5, 10, 25, 50, 100)) + " ELSE 'over 100K' END"
_CP = "cp AS (SELECT block_id AS original_id, 1000000000000 + write_seq AS checkpoint_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY write_seq) AS INTEGER) AS seq, payload FROM blocks)"


def _batches(close: str) -> str:
    return f"""WITH RECURSIVE {_ARR}, f AS (SELECT user_id, event_id, rn, 0 AS batch, a.at AS start, size AS used FROM a WHERE rn = 1
UNION ALL SELECT a.user_id, a.event_id, a.rn, CASE WHEN {close} THEN f.batch + 1 ELSE f.batch END, CASE WHEN {close} THEN a.at ELSE f.start END, CASE WHEN {close} THEN a.size ELSE f.used + a.size END
FROM f JOIN a ON a.user_id = f.user_id AND a.rn = f.rn + 1) SELECT user_id, event_id, batch FROM f"""


def _pack_sql() -> str:
    from ledgerloom.plans.store import _PACK

    return _PACK


ORACLE_SQL = {
    "ch1_block_hashes": f"{_B} SELECT block_id, write_seq, sha256(block_id || '|' || write_seq || '|' || type || '|' || payload) AS block_hash FROM blocks",
    "ch2_hash_chain": f"{_CHAINED} SELECT block_id, seq, previous_hash, chain_hash FROM c",
    "ch3_verify_entries": f"{_CHAINED} SELECT block_id, seq, NOT ({_BAD}) AS hash_ok, true AS link_ok FROM c",
    "ch4_verify_chain": f"{_CHAINED} SELECT count(*) AS entries, count(*) FILTER (WHERE {_BAD}) AS invalid, 0 AS breaks FROM c",
    "ch5_merkle_roots": f"{_ROOTS} SELECT block_id, merkle_root FROM roots",
    "ch6_heads": f"{_CHAINED} SELECT block_id, arg_max(chain_hash, seq) AS head_hash, max(seq) + 1 AS length FROM c GROUP BY block_id",
    "ch8_verified_read": f"{_CHAINED} SELECT block_id, write_seq, type FROM c JOIN blocks USING (block_id, write_seq) WHERE NOT ({_BAD})",
    "ch9_archive_verification": "SELECT true AS hashes_ok, true AS links_ok, true AS valid",
    "ch10_existence_proofs": f"{_ROOTS} SELECT block_id, seq, block_hash, chain_hash, merkle_root, sha256(block_hash || chain_hash || merkle_root) AS signature FROM c JOIN roots USING (block_id)",
    "snk6_chain_export": f"{_CHAINED} SELECT block_id, seq, block_hash, chain_hash FROM c WHERE seq BETWEEN 2 AND 5",
    "snk7_proof_json": f"""{_CHAINED} SELECT block_id, '{{"block_id":' || block_id || ',"head_hash":"' || arg_max(chain_hash, seq) || '","length":' || (max(seq) + 1) || '}}' AS json FROM c GROUP BY block_id""",
    "jn7_entry_pairs": f"{_CHAINED} SELECT a.block_id, a.seq, a.chain_hash = b.previous_hash AS linked FROM c a JOIN c b ON a.block_id = b.block_id AND b.seq = a.seq + 1",
    "jn8_chain_entry_or_none": f"{_CHAINED}, h2 AS (SELECT block_id, arg_max(chain_hash, seq) AS head_hash FROM c GROUP BY block_id) SELECT o_orderkey AS block_id, head_hash FROM orders LEFT JOIN h2 ON o_orderkey = block_id",
    "agg4_archive_stats": f"{_B} SELECT type, count(*) AS n, max(write_seq) AS last_seq, arg_max(payload, write_seq) AS last_payload FROM blocks GROUP BY type",
    "ver1_updates": f"WITH {LINKS} SELECT original, new FROM links",
    "ver3_current": f"""WITH RECURSIVE {LINKS}, s AS (SELECT min(event_id) AS id FROM events GROUP BY user_id), h AS (SELECT id AS start, id AS version, 0 AS hops FROM s
UNION ALL SELECT start, new, hops + 1 FROM h JOIN links ON original = version WHERE hops < 100) SELECT start, arg_max(version, hops) AS current, max(hops) AS hops FROM h GROUP BY start""",
    "ver4_history": f"""WITH RECURSIVE {LINKS}, s AS (SELECT min(event_id) AS id FROM events GROUP BY user_id), h AS (SELECT id AS start, id AS version, 0 AS hops FROM s
UNION ALL SELECT start, new, hops + 1 FROM h JOIN links ON original = version) SELECT start, version, hops FROM h""",
    "ver5_status": f"WITH {LINKS} SELECT event_id AS id, new AS updated_to, event_type = 'error' AS deleted FROM events LEFT JOIN links ON original = event_id",
    "cp1_checkpoints": f"""{_B} SELECT block_id AS original_id, 1000000000000 + write_seq AS checkpoint_id, CAST(row_number() OVER (PARTITION BY block_id ORDER BY write_seq) AS INTEGER) AS seq, payload
FROM blocks WHERE type IN ('click', 'view') AND octet_length(encode(payload)) >= 8 AND ts < {_FAR}""",
    "cp2_recover": f"""{_L}, {_CP}, b AS (SELECT original_id, arg_max(payload, seq) AS saved FROM cp WHERE checkpoint_id % 3 <> 0 GROUP BY original_id)
SELECT block_id, CASE WHEN block_id % 2 = 0 THEN payload ELSE saved END AS payload, CASE WHEN block_id % 2 = 0 THEN 'block' WHEN saved IS NOT NULL THEN 'checkpoint' ELSE 'lost' END AS source FROM l LEFT JOIN b ON block_id = original_id""",
    "cp3_history": f"{_B}, {_CP} SELECT original_id, checkpoint_id, seq, checkpoint_id = max(checkpoint_id) OVER (PARTITION BY original_id) AS latest FROM cp",
    "cp4_prune": f"{_B}, {_CP} SELECT original_id, greatest(count(*) - 3, 0) AS pruned, least(count(*), 3) AS kept FROM cp GROUP BY original_id",
    "tk3_newest": f"{_B} SELECT block_id, write_seq FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY write_seq DESC) <= 3",
    "mnt1_superseded": f"{_B} SELECT block_id, write_seq, type FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY write_seq DESC) > 1",
    "mnt2_orphans": f"{_L}, {_REF} SELECT block_id, type FROM l WHERE type <> 'signup' AND block_id NOT IN (SELECT ref FROM r WHERE ref IS NOT NULL)",
    "jn5_orphan_anti_join": f"{_L}, {_REF} SELECT block_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE ref = block_id)",
    "jn6_referenced": f"{_L}, {_REF} SELECT block_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE ref = block_id)",
    "mnt4_compaction": f"""{_L}, z AS (SELECT (SELECT sum(octet_length(encode(payload)) + 61) FROM blocks) AS o, (SELECT sum(octet_length(encode(payload)) + 61) FROM l) AS f)
SELECT CAST(o AS BIGINT) AS original_size, CAST(f AS BIGINT) AS final_size, CAST(o - f AS BIGINT) AS reclaimed FROM z""",
    "mnt5_backups": f"{_B} SELECT type, write_seq FROM blocks QUALIFY row_number() OVER (PARTITION BY type ORDER BY write_seq DESC) <= 3",
    "mnt6_reindex": f"{_B} SELECT block_id, max(write_seq) AS write_seq FROM blocks GROUP BY block_id",
    "agg7_distribution": f"SELECT {_BUCKETS} AS bucket, count(*) AS n_in, min(n_chars) AS least, max(n_chars) AS most, count(*) * 100.0 / (SELECT count(*) FROM documents) AS percent FROM documents GROUP BY 1",
    "agg7_upper_median": "SELECT source AS category, list_sort(list(n_chars))[count(*) // 2 + 1] AS median FROM documents GROUP BY source",
    "agg8_categories": "SELECT source AS category, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, CAST(sum(n_chars) // count(*) AS BIGINT) AS mean FROM documents GROUP BY source",
    "agg10_time_batches": _batches("a.at - f.start > 86400"),
    "agg11_size_or_time": _batches("a.at - f.start > 86400 OR f.used + a.size > 50000"),
    "agg12_adaptive_batches": f"""WITH RECURSIVE {_ARR}, w AS (SELECT *, avg(size) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS mean FROM a),
z AS (SELECT *, CASE WHEN mean > 100000 THEN 2097152 WHEN mean > 10000 THEN 1048576 ELSE 524288 END AS cap FROM w),
f AS (SELECT user_id, event_id, rn, 0 AS batch, size AS used FROM z WHERE rn = 1 UNION ALL SELECT z.user_id, z.event_id, z.rn,
CASE WHEN f.used > 0 AND f.used + z.size > z.cap THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + z.size > z.cap THEN z.size ELSE f.used + z.size END
FROM f JOIN z ON z.user_id = f.user_id AND z.rn = f.rn + 1) SELECT user_id, event_id, batch FROM f""",
    "agg13_fill_rate": f"{_pack_sql()}, b AS (SELECT run, block_no, sum(size + 4) AS used FROM f GROUP BY run, block_no) SELECT run, CAST(sum(used) * 100.0 / (count(*) * 65536) AS DOUBLE) AS fill_percent FROM b GROUP BY run",
    "agg20_snapshots": "SELECT day, n, bytes, bytes - lag(bytes) OVER (ORDER BY day) AS growth FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1)",
    "jn10_both_differences": f"""{_M}, p AS (SELECT DISTINCT email_id FROM (SELECT email_id, unnest(string_split_regex(lower(body), {CUTS})) AS term FROM emails) WHERE term = 'with'), e AS (SELECT email_id FROM emails WHERE folder = 'src0')
SELECT email_id, 'extra' AS side FROM (SELECT email_id FROM p EXCEPT SELECT email_id FROM e) UNION ALL SELECT email_id, 'missing' FROM (SELECT email_id FROM e EXCEPT SELECT email_id FROM p)""",
}
