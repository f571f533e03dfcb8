"""Registered queries of the store, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import text as X
from ledgerloom.operators import search as S
from ledgerloom.operators import store as O
from ledgerloom.plans.views import BLOCKS, MESSAGES, POSTINGS, TREE, block_log, folder_tree, messages, table

_M, _B, _T = f"WITH {MESSAGES}", f"WITH {BLOCKS}", f"WITH {TREE}"
_R = f"WITH RECURSIVE {MESSAGES}"
_SHA = "sha256(concat_ws('|', {}))"
_ENVELOPE = "sha256(message_id || '|' || sender || '|' || recipient || '|' || write_seq || '|' || subject || '||||' || size)"
MOVED, GONE, TO, CUT = 7, 11, "archive", "2024-01-03 00:00:00"


def _moves(s, d):  # noqa: ANN001, ANN202
    return messages(s, d).where(F.col("email_id") % MOVED == 0).select("email_id", F.lit(TO).alias("folder"), F.col("write_seq").alias("seq"))


def _current(s, d):  # noqa: ANN001, ANN202
    return O.current_folder(messages(s, d), _moves(s, d), messages(s, d).where(F.col("email_id") % GONE == 0))


def _labels(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "labels").select(F.col("doc_id").alias("email_id"), F.explode(F.array(F.concat(F.lit("quality-"), "quality"), F.concat(F.lit("toxic-"), "toxic"))).alias("label"))


def _wanted(s, d):  # noqa: ANN001, ANN202
    return folder_tree(s, d).select(F.explode(F.array(F.concat("path", F.lit("\\new")), F.col("path"), F.concat(F.lit("none\\"), "path"), F.concat("path", F.lit("\\")))).alias("path"))


def _numbers(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "orders").select("o_orderkey")


QUERIES = {
    "src1_log_scan": lambda s, d: O.valid_prefix(block_log(s, d), F.col("value") > 60).select("block_id", "write_seq", "type"),
    "src3_point_read": lambda s, d: O.latest(block_log(s, d).where("block_id = 42")).select("block_id", "write_seq", "type", "payload"),
    "src4_locations": lambda s, d: O.latest(block_log(s, d)).select("block_id", "write_seq", F.octet_length("payload").alias("length")),
    "src5_packed_read": lambda s, d: (
        O.packed(messages(s, d))
        .where("block_no = 1 and local_id < 3")
        .select("run", "block_no", "local_id", "email_id")
    ),
    "src7_batch_decode": lambda s, d: O.decode_batches(O.batch_blocks(O.packed(messages(s, d)))),
    "src11_migrate_type": lambda s, d: block_log(s, d).where("type = 'purchase'").select("block_id", "write_seq", "payload"),
    "src12_assessment": lambda s, d: (
        block_log(s, d)
        .groupBy("type")
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes"), (F.sum(F.octet_length("payload")) * 1.03).alias("estimated_bytes"), (F.count("*") * 0.01).alias("estimated_seconds"))
    ),
    "snk2_packed_append": lambda s, d: O.packed(messages(s, d)),
    "snk3_batch_blocks": lambda s, d: O.batch_blocks(O.packed(messages(s, d))).select("run", "block_no", F.size("toc").alias("n"), "used"),
    "snk8_log_tail": lambda s, d: (
        block_log(s, d)
        .select("write_seq", F.from_json("payload", "k int").k.alias("k"))
        .where("k is not null")
        .orderBy(F.desc("write_seq"))
        .limit(20)
    ),
    "fn5_preview": lambda s, d: (
        messages(s, d)
        .select("email_id", X.preview(F.col("subject"), F.col("sender"), F.lit("2024-03-05").cast("date")).alias("preview"))
    ),
    "fn6_envelope_hash": lambda s, d: O.envelope(messages(s, d)).select("email_id", "envelope_hash"),
    "fn7_content_hash": lambda s, d: messages(s, d).select("email_id", H.content_hash(F.col("body")).alias("content_hash")),
    "fn8_message_ids": lambda s, d: (
        messages(s, d)
        .select("email_id", H.message_id(F.concat("message_id", "subject", "sender", "recipient")).alias("hashed_id"))
    ),
    "fn9_compound_keys": lambda s, d: (
        _numbers(s, d)
        .select(X.compound_key(F.floor(F.col("o_orderkey") / 10), F.col("o_orderkey") % 10).alias("key"))
        .select("key", X.parse_key(F.col("key")).block.alias("block"), X.parse_key(F.col("key")).local.alias("local"))
    ),
    "fn10_crc32": lambda s, d: messages(s, d).select("email_id", F.crc32("body").alias("crc")),
    "fn11_codec_flags": lambda s, d: (
        _numbers(s, d)
        .select("o_orderkey", X.with_codec(F.col("o_orderkey").cast("int"), (F.col("o_orderkey") % 5).cast("int")).alias("flags"))
        .select("o_orderkey", "flags", X.codec_of(F.col("flags")).alias("codec"))
    ),
    "fn12_block_type": lambda s, d: _numbers(s, d).select("o_orderkey", X.block_type((F.col("o_orderkey") - 1) * 7_000_000_000).alias("type")),
    "fn13_block_size": lambda s, d: _numbers(s, d).select("o_orderkey", X.adaptive_block_mb(F.col("o_orderkey") * 100_000_000).alias("mb")),
    "fn14_segment_group": lambda s, d: _numbers(s, d).select("o_orderkey", X.segment_group(F.col("o_orderkey")).alias("grp")),
    "fn15_folder_paths": lambda s, d: (
        folder_tree(s, d)
        .select("path", X.folder_parent(F.col("path")).alias("parent"), X.folder_name(F.col("path")).alias("name"), X.folder_join(F.col("path"), F.lit("x")).alias("child"), X.folder_valid(F.col("path")).alias("valid"))
    ),
    "fn16_gzip_round_trip": lambda s, d: (
        messages(s, d)
        .select("email_id", F.col("body").cast("binary").alias("raw"))
        .select("email_id", "raw", H.gzip_round_trip("raw").alias("back"))
        .select("email_id", (F.col("raw") == F.col("back")).alias("same"))
    ),
    "fn17_json_payload": lambda s, d: (
        block_log(s, d)
        .select("write_seq", F.to_json(F.struct(F.col("block_id").alias("blockId"), F.col("type"))).alias("json"))
        .select("write_seq", F.get_json_object("json", "$.blockId").cast("long").alias("block_id"), F.get_json_object("json", "$.type").alias("type"))
    ),
    "fn19_utf8_bytes": lambda s, d: messages(s, d).select("email_id", X.utf8_bytes(F.col("body")).alias("bytes")),
    "fn20_human_bytes": lambda s, d: _numbers(s, d).select("o_orderkey", X.human_bytes(F.col("o_orderkey") * 100_000).alias("size")),
    "flt1_get_by_id": lambda s, d: messages(s, d).where("email_id = 77").select("email_id", "folder", "subject"),
    "flt2_get_by_message_id": lambda s, d: messages(s, d).where("message_id = 'doc-99'").select("email_id", "message_id"),
    "flt3_get_by_envelope": lambda s, d: O.envelope(messages(s, d)).where(F.col("envelope_hash").startswith("0")).select("email_id", "envelope_hash"),
    "flt5_contains": lambda s, d: messages(s, d).where(F.instr(F.lower("body"), "tion") > 0).select("email_id"),
    "flt6_archive_search": lambda s, d: (
        block_log(s, d)
        .where(F.col("ts").between(F.lit("2024-01-02").cast("timestamp"), F.lit(CUT).cast("timestamp")) & (F.col("type") == "click") & F.get_json_object("payload", "$.k").isNotNull())
        .select("block_id", "write_seq")
    ),
    "flt7_checkpoint_filter": lambda s, d: (
        block_log(s, d)
        .where(F.col("type").isin("click", "view") & (F.octet_length("payload") >= 9) & (F.col("ts") < F.lit(CUT).cast("timestamp")))
        .select("write_seq")
    ),
    "flt8_retention": lambda s, d: (
        block_log(s, d)
        .where(F.col("ts") < F.lit(CUT).cast("timestamp") - F.expr("interval 24 hours"))
        .select("write_seq")
    ),
    "flt9_children": lambda s, d: O.children(folder_tree(s, d), "ASIA").select("path"),
    "flt10_live_pairs": lambda s, d: (
        O.key_values(block_log(s, d), F.col("type") == "error", F.col("ts") + F.expr("interval 1 day") <= F.lit("2024-01-02").cast("timestamp"))
        .select("block_id", "write_seq")
    ),
    "flt11_outdated": lambda s, d: (
        block_log(s, d)
        .join(block_log(s, d).groupBy("block_id").agg(F.max("write_seq").alias("write_seq")), ["block_id", "write_seq"], "left_anti")
        .select("block_id", "write_seq")
    ),
    "flt12_seek_forward": lambda s, d: _numbers(s, d).where("o_orderkey >= 500").orderBy("o_orderkey").limit(10),
    "flt12_seek_back": lambda s, d: _numbers(s, d).where("o_orderkey <= 500").orderBy(F.desc("o_orderkey")).limit(10),
    "flt13_mailbox_rules": lambda s, d: (
        messages(s, d)
        .where("not (folder = 'src1' and write_seq < 100)")
        .select("email_id", F.when((F.col("folder") == "src0") & (F.col("write_seq") < 300), "archive").otherwise(F.col("folder")).alias("folder"))
    ),
    "jn1_folder_listing": lambda s, d: (
        _current(s, d)
        .join(messages(s, d).select("email_id", "subject", "size"), "email_id")
        .select("folder", "email_id", "subject", "size")
    ),
    "jn4_data_left_metadata": lambda s, d: (
        messages(s, d)
        .select("email_id", "size")
        .join(table(s, d, "labels").select(F.col("doc_id").alias("email_id"), "quality"), "email_id", "left")
    ),
    "jn9_verify_listing": lambda s, d: (
        _moves(s, d)
        .select("email_id")
        .join(messages(s, d).where("folder = 'src0'").select("email_id"), "email_id", "left_semi")
    ),
    "agg2_store_stats": lambda s, d: O.store_stats(messages(s, d), S.postings(messages(s, d))),
    "agg3_simple_stats": lambda s, d: (
        messages(s, d)
        .agg(F.count("*").alias("emails"), (F.count("*") * 4).alias("search_indexes"), F.count_distinct("folder").alias("folders"))
    ),
    "agg5_latest": lambda s, d: O.latest(block_log(s, d)).select("block_id", "write_seq", "type", "value"),
    "agg9_greedy_packing": lambda s, d: (
        O.packed(messages(s, d))
        .groupBy("run", "block_no")
        .agg(F.count("*").alias("n"), F.sum(F.col("size") + 4).alias("used"))
    ),
    "agg9b_batch_packing": lambda s, d: O.batched(messages(s, d)),
    "agg15_duplicates": lambda s, d: O.content_duplicates(messages(s, d)),
    "agg16_index_metadata": lambda s, d: (
        messages(s, d)
        .agg(F.max("write_seq").alias("last_updated"), F.count("*").alias("total_indexed"), F.lit(1).alias("version"))
    ),
    "agg17_live_count": lambda s, d: O.latest(block_log(s, d)).where("type <> 'error'").agg(F.count("*").alias("n")),
    "agg19_folder_counters": lambda s, d: (
        messages(s, d)
        .groupBy("folder")
        .agg(F.count_if(F.col("email_id") % 3 == 0).alias("unread"), F.count("*").alias("total"))
    ),
    "tk4_last_rows": lambda s, d: block_log(s, d).orderBy(F.desc("write_seq")).limit(15).select("write_seq", "type"),
    "set6_superseded_sources": lambda s, d: (
        block_log(s, d)
        .where("type = 'error'")
        .select("block_id")
        .unionByName(block_log(s, d).where("value > 50").select("block_id"))
        .distinct()
    ),
    "mut1_store": lambda s, d: O.fresh_only(messages(s, d), messages(s, d).where(F.col("email_id") % 5 < 2)).select("email_id", "message_id"),
    "mut2_envelopes": lambda s, d: O.envelope(messages(s, d)).select("email_id", "message_id", "folder", "sender", "size", "envelope_hash"),
    "mut3_move": lambda s, d: O.current_folder(messages(s, d), _moves(s, d), messages(s, d).where("false")),
    "mut4_delete": lambda s, d: _current(s, d),
    "mut5_labels": lambda s, d: O.labels_of(_labels(s, d)),
    "fld1_create": lambda s, d: O.create_folders(folder_tree(s, d), _wanted(s, d)),
    "fld2_delete": lambda s, d: (
        O.delete_folders(folder_tree(s, d), folder_tree(s, d).where("folder_id % 2 = 0").select(F.col("path").alias("folder")), _wanted(s, d))
    ),
    "fld3_move_subtree": lambda s, d: O.move_subtree(folder_tree(s, d), "ASIA", "EUROPE"),
    "fld3_move_refused": lambda s, d: O.move_subtree(folder_tree(s, d), "ASIA", "ASIA\\CHINA"),
    "fld4_subtree": lambda s, d: O.subtree(folder_tree(s, d), "AFRICA").select("folder_id", "path"),
    "fld5_listing": lambda s, d: O.envelope(messages(s, d).where("folder = 'src0'")).select("email_id", "subject", "sender", "envelope_hash"),
    "fld6_listing_after_moves": lambda s, d: _current(s, d).groupBy("folder").agg(F.count("*").alias("n"), F.min("email_id").alias("first_id")),
    "seg1_segments": lambda s, d: (
        O.segments(block_log(s, d))
        .select("block_id", "version", "value", F.col("metadata")["click"].alias("click"), F.col("metadata")["view"].alias("view"))
    ),
    "seg2_offsets": lambda s, d: (
        _numbers(s, d)
        .join(block_log(s, d).select(F.col("block_id").alias("o_orderkey"), "write_seq").groupBy("o_orderkey").agg(F.max("write_seq").alias("w")), "o_orderkey", "left")
        .select("o_orderkey", F.coalesce("w", F.lit(-1).cast("long")).alias("offset_or_none"))
    ),
    "kv1_upserts": lambda s, d: O.latest(block_log(s, d)).where("type <> 'signup'").select("block_id", "value"),
    "sf1_ids": lambda s, d: messages(s, d).select("email_id"),
    "sf12_folder_index": lambda s, d: messages(s, d).groupBy("folder").agg(F.max_by("email_id", "write_seq").alias("block_id")),
    "sf15_next_ids": lambda s, d: folder_tree(s, d).groupBy("parent_id").agg((F.max("folder_id") + 1).alias("next_id")),
}

_RUN = "folder"


def _fold(cost: str, start: str, move: str) -> str:
    """Recursive common table expression of a packing fold."""
    return f"""{_R}, o AS (SELECT *, {_RUN} AS run, row_number() OVER (PARTITION BY {_RUN} ORDER BY write_seq) AS rn FROM emails),
f AS (SELECT run, rn, email_id, size, 0 AS block_no, 0 AS local_id, {start} AS used FROM o WHERE rn = 1
UNION ALL SELECT o.run, o.rn, o.email_id, o.size, {move} FROM f JOIN o ON o.run = f.run AND o.rn = f.rn + 1)"""


_PACK = _fold("size", "CAST(size + 4 AS BIGINT)", """CASE WHEN f.used + o.size + 4 > 65536 THEN f.block_no + 1 ELSE f.block_no END,
CASE WHEN f.used + o.size + 4 > 65536 THEN 0 ELSE f.local_id + 1 END, CASE WHEN f.used + o.size + 4 > 65536 THEN o.size + 4 ELSE f.used + o.size + 4 END""")
_BATCH = _fold("size", "CAST(size AS BIGINT)", """CASE WHEN f.used >= 65536 THEN f.block_no + 1 ELSE f.block_no END,
CASE WHEN f.used >= 65536 THEN 0 ELSE f.local_id + 1 END, CASE WHEN f.used >= 65536 THEN o.size ELSE f.used + o.size END""")
_LATEST = f"{_B}, l AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY write_seq DESC) = 1)"
_CUR = f"{_M}, c AS (SELECT email_id, CASE WHEN email_id % {MOVED} = 0 THEN '{TO}' ELSE folder END AS folder FROM emails)"
_WANTED = "wanted AS (SELECT unnest([path || chr(92) || 'new', path, 'none' || chr(92) || path, path || chr(92)]) AS path FROM tree)"
_PARENT = "regexp_extract({}, '^(.*)\\\\[^\\\\]*$', 1)"
_HUMAN = " ".join(f"WHEN x < {1024 ** (p + 1)} THEN printf('%.2f {u}', round(x / {1024.0**p}, 2))" for p, u in ((0, "B"), (1, "KB"), (2, "MB"), (3, "GB")))
ORACLE_SQL = {
    "src1_log_scan": f"{_B} SELECT block_id, write_seq, type FROM blocks WHERE write_seq < coalesce((SELECT min(write_seq) FROM blocks WHERE value > 60), 9223372036854775807)",
    "src3_point_read": f"{_LATEST} SELECT block_id, write_seq, type, payload FROM l WHERE block_id = 42",
    "src4_locations": f"{_LATEST} SELECT block_id, write_seq, octet_length(encode(payload)) AS length FROM l",
    "src5_packed_read": f"{_PACK} SELECT run, block_no, local_id, email_id FROM f WHERE block_no = 1 AND local_id < 3",
    "src7_batch_decode": f"{_PACK} SELECT run, block_no, local_id, email_id, size FROM f",
    "src11_migrate_type": f"{_B} SELECT block_id, write_seq, payload FROM blocks WHERE type = 'purchase'",
    "src12_assessment": f"{_B} SELECT type, count(*) AS n, CAST(sum(octet_length(encode(payload))) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(payload))) * 1.03 AS DOUBLE) AS estimated_bytes, CAST(count(*) * 0.01 AS DOUBLE) AS estimated_seconds FROM blocks GROUP BY type",
    "snk2_packed_append": f"{_PACK} SELECT run, email_id, size, block_no, local_id FROM f",
    "snk3_batch_blocks": f"{_PACK} SELECT run, block_no, count(*) AS n, CAST(sum(size + 4) AS BIGINT) AS used FROM f GROUP BY run, block_no",
    "snk8_log_tail": f"{_B} SELECT write_seq, CAST(json_extract(payload, '$.k') AS INTEGER) AS k FROM blocks WHERE json_extract(payload, '$.k') IS NOT NULL ORDER BY write_seq DESC LIMIT 20",
    "fn5_preview": f"{_M} SELECT email_id, subject || ' - ' || sender || ' (03/05/2024)' AS preview FROM emails",
    "fn6_envelope_hash": f"{_M} SELECT email_id, {_ENVELOPE} AS envelope_hash FROM emails",
    "fn7_content_hash": f"{_M} SELECT email_id, sha256(body) AS content_hash FROM emails",
    "fn9_compound_keys": "SELECT (o_orderkey // 10) || ':' || (o_orderkey % 10) AS key, o_orderkey // 10 AS block, CAST(o_orderkey % 10 AS INTEGER) AS local FROM orders",
    "fn11_codec_flags": "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey & 65280 ELSE (o_orderkey & 65280) | ((o_orderkey % 5) * 2) | 1 END AS INTEGER) AS flags, CAST(o_orderkey % 5 AS INTEGER) AS codec FROM orders",
    "fn12_block_type": """SELECT o_orderkey, CASE WHEN x IN (0, 1) THEN 'Metadata' WHEN x = 3 THEN 'WAL' WHEN x = 2 THEN 'FolderTree' WHEN x // 10000000000000 = 1 THEN 'Folder'
WHEN x // 10000000000000 = 2 THEN 'Segment' WHEN x // 10000000000000 = 3 THEN 'Cleanup' ELSE 'Metadata' END AS type FROM (SELECT o_orderkey, (o_orderkey - 1) * 7000000000 AS x FROM orders)""",
    "fn13_block_size": "SELECT o_orderkey, CASE WHEN g < 5 THEN 50 WHEN g < 25 THEN 100 WHEN g < 100 THEN 250 WHEN g < 500 THEN 500 ELSE 1024 END AS mb FROM (SELECT o_orderkey, o_orderkey * 100000000 / 1073741824.0 AS g FROM orders)",
    "fn14_segment_group": "SELECT o_orderkey, o_orderkey // 1000 AS grp FROM orders",
    "fn15_folder_paths": f"{_T} SELECT path, {_PARENT.format('path')} AS parent, string_split(path, chr(92))[-1] AS name, path || chr(92) || 'x' AS child, true AS valid FROM tree",
    "fn17_json_payload": f"{_B} SELECT write_seq, block_id, type FROM blocks",
    "fn19_utf8_bytes": f"{_M} SELECT email_id, octet_length(encode(body)) AS bytes FROM emails",
    "fn20_human_bytes": f"SELECT o_orderkey, CASE {_HUMAN} ELSE printf('%.2f TB', round(x / {1024.0**4}, 2)) END AS size FROM (SELECT o_orderkey, o_orderkey * 100000 AS x FROM orders)",
    "flt1_get_by_id": f"{_M} SELECT email_id, folder, subject FROM emails WHERE email_id = 77",
    "flt2_get_by_message_id": f"{_M} SELECT email_id, message_id FROM emails WHERE email_id = 99",
    "flt3_get_by_envelope": f"{_M} SELECT email_id, {_ENVELOPE} AS envelope_hash FROM emails WHERE {_ENVELOPE} LIKE '0%'",
    "flt5_contains": f"{_M} SELECT email_id FROM emails WHERE contains(lower(body), 'tion')",
    "flt6_archive_search": f"{_B} SELECT block_id, write_seq FROM blocks WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '{CUT}' AND type = 'click' AND json_extract(payload, '$.k') IS NOT NULL",
    "flt7_checkpoint_filter": f"{_B} SELECT write_seq FROM blocks WHERE type IN ('click', 'view') AND octet_length(encode(payload)) >= 9 AND ts < TIMESTAMP '{CUT}'",
    "flt8_retention": f"{_B} SELECT write_seq FROM blocks WHERE ts < TIMESTAMP '{CUT}' - INTERVAL 24 HOUR",
    "flt9_children": f"{_T} SELECT path FROM tree WHERE parent_id = (SELECT folder_id FROM tree WHERE path = 'ASIA')",
    "flt10_live_pairs": f"{_LATEST} SELECT block_id, write_seq FROM l WHERE type <> 'error' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-02'",
    "flt11_outdated": f"{_B} SELECT block_id, write_seq FROM blocks QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY write_seq DESC) > 1",
    "flt12_seek_forward": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 500 ORDER BY 1 LIMIT 10",
    "flt12_seek_back": "SELECT o_orderkey FROM orders WHERE o_orderkey <= 500 ORDER BY 1 DESC LIMIT 10",
    "flt13_mailbox_rules": f"{_M} SELECT email_id, CASE WHEN folder = 'src0' AND write_seq < 300 THEN 'archive' ELSE folder END AS folder FROM emails WHERE NOT (folder = 'src1' AND write_seq < 100)",
    "jn1_folder_listing": f"{_CUR} SELECT c.folder, email_id, subject, size FROM c JOIN emails USING (email_id) WHERE email_id % {GONE} <> 0",
    "jn4_data_left_metadata": f"{_M} SELECT email_id, size, quality FROM emails LEFT JOIN labels ON doc_id = email_id",
    "jn9_verify_listing": f"{_M} SELECT email_id FROM emails WHERE email_id % {MOVED} = 0 AND folder = 'src0'",
    "agg2_store_stats": f"""{_M}, {POSTINGS}, p AS (SELECT count(DISTINCT term) AS indexed_words, CAST(sum(length(term) + 8) AS BIGINT) AS index_size FROM postings),
m AS (SELECT count(*) AS emails, count(DISTINCT folder) AS folders, CAST(sum(size) AS BIGINT) AS data_size FROM emails) SELECT *, data_size + index_size AS total_size FROM m, p""",
    "agg3_simple_stats": f"{_M} SELECT count(*) AS emails, count(*) * 4 AS search_indexes, count(DISTINCT folder) AS folders FROM emails",
    "agg5_latest": f"{_LATEST} SELECT block_id, write_seq, type, value FROM l",
    "agg9_greedy_packing": f"{_PACK} SELECT run, block_no, count(*) AS n, CAST(sum(size + 4) AS BIGINT) AS used FROM f GROUP BY run, block_no",
    "agg9b_batch_packing": f"{_BATCH} SELECT run, email_id, size, block_no, local_id FROM f",
    "agg15_duplicates": f"{_M} SELECT email_id, kept_id, email_id <> kept_id AS duplicate FROM (SELECT email_id, min(email_id) OVER (PARTITION BY body) AS kept_id FROM emails)",
    "agg16_index_metadata": f"{_M} SELECT max(write_seq) AS last_updated, count(*) AS total_indexed, 1 AS version FROM emails",
    "agg17_live_count": f"{_LATEST} SELECT count(*) AS n FROM l WHERE type <> 'error'",
    "agg19_folder_counters": f"{_M} SELECT folder, count(*) FILTER (WHERE email_id % 3 = 0) AS unread, count(*) AS total FROM emails GROUP BY folder",
    "tk4_last_rows": f"{_B} SELECT write_seq, type FROM blocks ORDER BY write_seq DESC LIMIT 15",
    "set6_superseded_sources": f"{_B} SELECT DISTINCT block_id FROM blocks WHERE type = 'error' OR value > 50",
    "mut1_store": f"{_M} SELECT email_id, message_id FROM emails WHERE email_id % 5 >= 2",
    "mut2_envelopes": f"{_M} SELECT email_id, message_id, folder, sender, size, {_ENVELOPE} AS envelope_hash FROM emails",
    "mut3_move": f"{_CUR} SELECT email_id, folder FROM c",
    "mut4_delete": f"{_CUR} SELECT email_id, folder FROM c WHERE email_id % {GONE} <> 0",
    "mut5_labels": "SELECT doc_id AS email_id, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM (SELECT doc_id, unnest(['quality-' || quality, 'toxic-' || toxic]) AS l FROM labels) GROUP BY doc_id",
    "fld1_create": f"""{_T}, {_WANTED} SELECT path, CASE WHEN path LIKE '%' || chr(92) THEN 'invalid' WHEN path IN (SELECT path FROM tree) THEN 'exists'
WHEN {_PARENT.format('path')} <> '' AND {_PARENT.format('path')} NOT IN (SELECT path FROM tree) THEN 'no_parent' ELSE 'created' END AS status FROM wanted""",
    "fld2_delete": f"""{_T}, {_WANTED} SELECT path, CASE WHEN path NOT IN (SELECT path FROM tree) THEN 'missing' WHEN path IN (SELECT {_PARENT.format('path')} FROM tree) THEN 'has_children'
WHEN path IN (SELECT path FROM tree WHERE folder_id % 2 = 0) THEN 'not_empty' ELSE 'deleted' END AS status FROM wanted""",
    "fld3_move_subtree": f"""{_T} SELECT folder_id, CASE WHEN path = 'ASIA' THEN (SELECT folder_id FROM tree WHERE path = 'EUROPE') ELSE parent_id END AS parent_id,
CASE WHEN path = 'ASIA' OR starts_with(path, 'ASIA' || chr(92)) THEN 'EUROPE' || chr(92) || path ELSE path END AS path FROM tree""",
    "fld3_move_refused": f"{_T} SELECT folder_id, parent_id, path FROM tree",
    "fld4_subtree": f"{_T} SELECT folder_id, path FROM tree WHERE path = 'AFRICA' OR starts_with(path, 'AFRICA' || chr(92))",
    "fld5_listing": f"{_M} SELECT email_id, subject, sender, {_ENVELOPE} AS envelope_hash FROM emails WHERE folder = 'src0'",
    "fld6_listing_after_moves": f"{_CUR} SELECT folder, count(*) AS n, min(email_id) AS first_id FROM c WHERE email_id % {GONE} <> 0 GROUP BY folder",
    "seg1_segments": f"""{_B} SELECT block_id, count(*) AS version, arg_max(value, write_seq) AS value, arg_max(json_extract_string(payload, '$.k'), write_seq) FILTER (WHERE type = 'click') AS click,
arg_max(json_extract_string(payload, '$.k'), write_seq) FILTER (WHERE type = 'view') AS view FROM blocks GROUP BY block_id""",
    "seg2_offsets": f"{_LATEST} SELECT o_orderkey, coalesce(write_seq, -1) AS offset_or_none FROM orders LEFT JOIN l ON block_id = o_orderkey",
    "kv1_upserts": f"{_LATEST} SELECT block_id, value FROM l WHERE type <> 'signup'",
    "sf1_ids": "SELECT doc_id AS email_id FROM documents",
    "sf12_folder_index": f"{_M} SELECT folder, max(email_id) AS block_id FROM emails GROUP BY folder",
    "sf15_next_ids": f"{_T} SELECT parent_id, max(folder_id) + 1 AS next_id FROM tree GROUP BY parent_id",
}
