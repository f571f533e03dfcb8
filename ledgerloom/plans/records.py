"""Registered queries of records, frames, transactions and the registry, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.operators import integrity as I
from ledgerloom.operators import records as R
from ledgerloom.operators import store as O
from ledgerloom.plans.analysis import _CHAINED, _L, _ROOTS, _chain
from ledgerloom.plans.store import _ENVELOPE, _PACK, CUT, _moves
from ledgerloom.plans.views import BLOCKS, MESSAGES, block_log, messages, table

_B, _M = f"WITH {BLOCKS}", f"WITH {MESSAGES}"


def _frames(s, d):  # noqa: ANN001, ANN202
    """Frames of the log, of which some are damaged: payloads changed or cut short, and a footer overwritten."""
    f, n = R.framed(block_log(s, d)), F.col("write_seq")
    payload = F.when(n % 97 == 1, F.regexp_replace("payload", "k", "q")).when(n % 89 == 2, F.substring("payload", 1, 3)).otherwise(F.col("payload"))
    return f.withColumns({"payload": payload, "footer": F.when(n % 83 == 3, F.lit("?")).otherwise(F.col("footer"))})


_STATUS = "CASE WHEN write_seq % 83 = 3 THEN 'bad_magic' WHEN write_seq % 97 = 1 THEN 'bad_checksum' WHEN write_seq % 89 = 2 THEN 'bad_length' ELSE 'ok' END"


def _labelled(s, d):  # noqa: ANN001, ANN202
    return O.envelope(messages(s, d)).join(table(s, d, "labels").select(F.col("doc_id").alias("email_id")).distinct(), "email_id", "left_semi")


def _ops(s, d):  # noqa: ANN001, ANN202
    op = F.when(F.col("type").isin("click", "view"), "add").when(F.col("type") == "signup", "remove").when(F.col("type") == "purchase", "mark")
    return block_log(s, d).select("block_id", "write_seq", op.alias("op")).where("op is not null")


def _codecs(s, d):  # noqa: ANN001, ANN202
    every = messages(s, d).select("email_id", F.col("body").cast("binary").alias("raw"), F.explode(F.array(*map(F.lit, range(5)))).alias("codec"))
    return every.select("email_id", "codec", "raw", H.codec_round_trip("raw", "codec").alias("back"))


def _latency(s, d):  # noqa: ANN001, ANN202
    """Mean, median and 95th percentile of each type, and how far its last quarter is above its first, in percent."""
    e = table(s, d, "events").select("event_type", "event_id", "value")
    mean = lambda q: F.avg(F.when(F.col("quarter") == q, F.col("value")))
    ends = R.quarters(e, "event_type", "event_id").groupBy("event_type").agg(F.avg("value").alias("mean"), ((mean(4) - mean(1)) / mean(1) * 100).alias("degradation"))
    return ends.join(R.quantiles(e, "event_type", "value", {"median": 0.5, "p95": 0.95}, nearest={"p95"}), "event_type").select("event_type", "mean", "median", "p95", "degradation")


def _safe(s, d):  # noqa: ANN001, ANN202
    """Superseded blocks before a time that no payload refers to."""
    log = block_log(s, d)
    old = log.join(O.latest(log).select("block_id", F.col("write_seq").alias("newest")), "block_id").where("write_seq < newest").where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))
    refs = log.select(F.get_json_object("payload", "$.k").cast("long").alias("write_seq")).distinct()
    return old.join(refs, "write_seq", "left_anti").select("block_id", "write_seq")


def _incoming(s, d):  # noqa: ANN001, ANN202
    last = I.heads(_chain(s, d))
    named = F.when(F.col("block_id") % 2 == 0, F.col("head_hash")).otherwise(F.lit(H.GENESIS))
    return last.select("block_id", named.alias("named_head"), F.sha2(F.concat(F.lit("new"), F.col("block_id").cast("string")), 256).alias("block_hash"))


QUERIES = {
    "src3_checked_read": lambda s, d: R.checked_read(_frames(s, d)).select("block_id", "write_seq", "status", "payload"),
    "agg18_checksums": lambda s, d: R.checked_read(_frames(s, d)).groupBy("type", "status").agg(F.count("*").alias("n")),
    "ch9_full_verification": lambda s, d: R.archive_report(_frames(s, d), I.chain_summary(_chain(s, d))),
    "flt3_probe": lambda s, d: R.duplicate_probe(O.envelope(messages(s, d)), _labelled(s, d)),
    "flt4_locations": lambda s, d: R.locations(O.packed(messages(s, d)), O.envelope(messages(s, d)), _labelled(s, d)),
    "flt10_sliding": lambda s, d: (
        O.latest(block_log(s, d))
        .select("block_id", F.greatest(F.col("ts") + F.expr("interval 1 day"), F.lit("2024-01-25").cast("timestamp") + F.expr("interval 12 hours")).alias("expires"))
    ),
    "flt12_with_deleted": lambda s, d: (
        O.latest(block_log(s, d))
        .select("block_id", (F.col("type") == "error").alias("deleted"))
        .where("block_id >= 5")
    ),
    "tk5_by_sequence": lambda s, d: _chain(s, d).select("block_id", "seq", "write_seq").orderBy("block_id", F.desc("seq")),
    "mut2_all_indexes": lambda s, d: R.index_rows(O.envelope(messages(s, d)), O.packed(messages(s, d))),
    "mut3b_moved_versions": lambda s, d: R.moved_versions(messages(s, d), _moves(s, d)),
    "mut1_missing_ids": lambda s, d: (
        O.fresh_only(O.identified(_unnamed(s, d)), O.identified(_unnamed(s, d).where("email_id % 4 = 0")))
        .select("email_id")
    ),
    "agg15_null_bodies": lambda s, d: O.content_duplicates(messages(s, d).withColumn("body", F.when(F.col("email_id") % 9 != 0, F.col("body")))),
    "tx1_transactions": lambda s, d: R.transactions(block_log(s, d), "block_id", "write_seq", (F.col("type") == "error") & (F.col("value") > 90)),
    "ver2_deletes": lambda s, d: (
        R.deletion_markers(table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq")))
    ),
    "ch7_chained_writes": lambda s, d: R.chained_writes(I.heads(_chain(s, d)), _incoming(s, d)),
    "snk7_full_proof": lambda s, d: (
        I.existence_proofs(_chain(s, d))
        .select("block_id", "seq", F.to_json(F.struct("block_id", "seq", "block_hash", "chain_hash", "merkle_root", "signature")).alias("json"))
    ),
    "seg2_registry": lambda s, d: R.registry(_ops(s, d), 500),
    "sf9_new_store": lambda s, d: R.new_store(s),
    "sf12_tree_index": lambda s, d: _tree_index(s, d),
    "sf14_log_entries": lambda s, d: R.log_entries(_superseded(s, d), F.lit(CUT).cast("timestamp")),
    "fn16_codecs": lambda s, d: _codecs(s, d).select("email_id", "codec", (F.col("raw") == F.col("back")).alias("same")),
    "fn17_raw_payload": lambda s, d: block_log(s, d).select("write_seq", F.decode(F.col("payload").cast("binary"), "UTF-8").alias("payload")),
    "agg14_latency": _latency,
    "mnt3_safe_to_delete": _safe,
}


def _unnamed(s, d):  # noqa: ANN001, ANN202
    return messages(s, d).withColumn("message_id", F.when(F.col("email_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("email_id") % 3 == 1, F.lit(" ")).otherwise(F.col("message_id")))


def _superseded(s, d):  # noqa: ANN001, ANN202
    log = block_log(s, d)
    return log.join(O.latest(log).select("block_id", "write_seq"), ["block_id", "write_seq"], "left_anti")


def _tree_index(s, d):  # noqa: ANN001, ANN202
    """Folder path to the block that holds it now: each user's folder is written anew by each of its events."""
    log = block_log(s, d).select(F.concat(F.lit("root\\"), "type").alias("path"), F.col("write_seq").alias("folder_block"), "write_seq")
    return log.groupBy("path").agg(F.max_by("folder_block", "write_seq").alias("folder_block"), F.count("*").alias("versions"))


_ID = "coalesce(CASE WHEN email_id % 3 = 2 THEN message_id END, 'sha256:' || sha256(concat_ws(chr(31), sender, recipient, subject, body)))"
ORACLE_SQL = {
    "src3_checked_read": f"{_B} SELECT block_id, write_seq, {_STATUS} AS status, CASE WHEN {_STATUS} = 'ok' THEN payload END AS payload FROM blocks",
    "agg18_checksums": f"{_B} SELECT type, {_STATUS} AS status, count(*) AS n FROM blocks GROUP BY 1, 2",
    "ch9_full_verification": f"{_B}, t AS (SELECT {_STATUS} AS st FROM blocks) SELECT bool_and(st NOT IN ('bad_magic', 'bad_length')) AS headers_ok, bool_and(st <> 'bad_checksum') AS checksums_ok, true AS chain_ok, true AS signature_ok, bool_and(st = 'ok') AS valid FROM t",
    "flt3_probe": f"{_M} SELECT email_id, email_id IN (SELECT doc_id FROM labels) AS known FROM emails",
    "flt4_locations": f"{_PACK}, e AS (SELECT email_id, {_ENVELOPE} AS envelope_hash FROM emails WHERE email_id IN (SELECT doc_id FROM labels)) SELECT envelope_hash, email_id, run, block_no, local_id FROM f JOIN e USING (email_id)",
    "flt10_sliding": f"{_L} SELECT block_id, greatest(ts + INTERVAL 1 DAY, TIMESTAMP '2024-01-25 12:00:00') AS expires FROM l",
    "flt12_with_deleted": f"{_L} SELECT block_id, type = 'error' AS deleted FROM l WHERE block_id >= 5",
    "tk5_by_sequence": f"{_CHAINED} SELECT block_id, seq, write_seq FROM c",
    "mut2_all_indexes": f"""{_PACK}, e AS (SELECT f.*, m.message_id, m.sender, m.folder, m.body, {_ENVELOPE.replace('size', 'm.size')} AS envelope_hash FROM f JOIN emails m USING (email_id))
SELECT 'message_id' AS index_name, message_id AS key, email_id FROM e UNION ALL SELECT 'envelope_hash', envelope_hash, email_id FROM e UNION ALL SELECT 'content_hash', sha256(body), email_id FROM e
UNION ALL SELECT 'folder', folder, email_id FROM e UNION ALL SELECT 'sender', sender, email_id FROM e UNION ALL SELECT 'location', run || ':' || block_no || ':' || local_id, email_id FROM e""",
    "mut3b_moved_versions": f"""{_M} SELECT email_id, message_id, folder, CASE WHEN email_id % 7 = 0 THEN message_id || '_moved_' || write_seq END AS moved_to FROM emails
UNION ALL SELECT email_id, message_id || '_moved_' || write_seq, 'archive', NULL FROM emails WHERE email_id % 7 = 0""",
    "mut1_missing_ids": f"""{_M}, i AS (SELECT email_id, write_seq, {_ID} AS id FROM emails) SELECT arg_min(email_id, write_seq) AS email_id FROM i WHERE id NOT IN (SELECT id FROM i WHERE email_id % 4 = 0) GROUP BY id""",
    "agg15_null_bodies": f"{_M}, n AS (SELECT email_id, CASE WHEN email_id % 9 <> 0 THEN body END AS body FROM emails) SELECT email_id, kept_id, email_id <> kept_id AS duplicate FROM (SELECT email_id, min(email_id) OVER (PARTITION BY body) AS kept_id FROM n)",
    "tx1_transactions": f"""{_B}, t AS (SELECT block_id, write_seq, min(CASE WHEN type = 'error' AND value > 90 THEN write_seq END) OVER (PARTITION BY block_id) AS stop FROM blocks),
u AS (SELECT block_id, write_seq, CASE WHEN stop IS NULL THEN 'applied' WHEN write_seq < stop THEN 'undone' WHEN write_seq = stop THEN 'failed' ELSE 'skipped' END AS status FROM t)
SELECT block_id, write_seq, status, CASE WHEN status = 'undone' THEN CAST(row_number() OVER (PARTITION BY block_id, status ORDER BY write_seq DESC) AS INTEGER) END AS undo_no FROM u""",
    "ver2_deletes": "SELECT user_id AS id, min(event_id) AS seq FROM events WHERE event_type = 'error' GROUP BY user_id",
    "ch7_chained_writes": f"""{_CHAINED}, g AS (SELECT block_id, arg_max(chain_hash, seq) AS head, max(seq) + 1 AS n FROM c GROUP BY block_id)
SELECT block_id, n AS seq, CASE WHEN block_id % 2 = 0 THEN 'appended' ELSE 'tombstone' END AS status, CASE WHEN block_id % 2 = 0 THEN sha256(head || sha256('new' || block_id)) END AS chain_hash FROM g""",
    "snk7_full_proof": f"""{_ROOTS} SELECT block_id, seq, '{{"block_id":' || block_id || ',"seq":' || seq || ',"block_hash":"' || block_hash || '","chain_hash":"' || chain_hash || '","merkle_root":"' || merkle_root || '","signature":"' || sha256(block_hash || chain_hash || merkle_root) || '"}}' AS json
FROM c JOIN roots USING (block_id)""",
    "seg2_registry": f"""{_B}, s AS (SELECT block_id, max(write_seq) FILTER (WHERE type IN ('click', 'view')) AS a, coalesce(max(write_seq) FILTER (WHERE type = 'signup'), -1) AS r, coalesce(max(write_seq) FILTER (WHERE type = 'purchase'), -1) AS m FROM blocks GROUP BY block_id),
z AS (SELECT block_id, CASE WHEN a > r THEN a ELSE -1 END AS "offset", greatest(m, r) >= 0 AND NOT coalesce(a > r AND greatest(m, r) < 500, false) AS outdated FROM s WHERE a IS NOT NULL OR r >= 0 OR m >= 0)
SELECT * FROM z WHERE "offset" >= 0 OR outdated""",
    "sf9_new_store": """SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'header', '{"version":1}'), (1, 1, 'metadata', '{"folders":1}'), (2, 2, 'folder_tree', '{"root":-1}'), (3, 3, 'wal', '[]')) t(block_id, write_seq, type, payload)""",
    "sf12_tree_index": f"{_B} SELECT 'root' || chr(92) || type AS path, max(write_seq) AS folder_block, count(*) AS versions FROM blocks GROUP BY type",
    "sf14_log_entries": f"{_L} SELECT TIMESTAMP '{CUT}' AS timestamp, 'delete_blocks' AS operation, count(*) || ' blocks of ' || b.type || ', ' || CAST(sum(octet_length(encode(b.payload))) AS BIGINT) || ' bytes' AS details FROM blocks b JOIN l ON b.block_id = l.block_id WHERE b.write_seq < l.write_seq GROUP BY b.type",
    "fn16_codecs": f"{_M} SELECT email_id, unnest([0, 1, 2, 3, 4]) AS codec, true AS same FROM emails",
    "fn17_raw_payload": f"{_B} SELECT write_seq, payload FROM blocks",
    "agg14_latency": """WITH q AS (SELECT *, ntile(4) OVER (PARTITION BY event_type ORDER BY event_id) AS quarter FROM events),
g AS (SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.5) AS median, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95, avg(value) FILTER (WHERE quarter = 1) AS a, avg(value) FILTER (WHERE quarter = 4) AS b FROM q GROUP BY event_type)
SELECT event_type, mean, median, p95, (b - a) / a * 100 AS degradation FROM g""",
    "mnt3_safe_to_delete": f"{_L} SELECT b.block_id, b.write_seq FROM blocks b JOIN l ON b.block_id = l.block_id WHERE b.write_seq < l.write_seq AND b.ts < TIMESTAMP '2024-01-10' AND b.write_seq NOT IN (SELECT CAST(json_extract(payload, '$.k') AS BIGINT) FROM blocks WHERE json_extract(payload, '$.k') IS NOT NULL)",
}
