"""Small literal cases of operators, sources and streaming that SQL doesn't cover."""

import datetime
import hashlib

from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import text as X
from ledgerloom.operators import integrity as I
from ledgerloom.operators import search as S
from ledgerloom.operators import store as O
from ledgerloom.sources import blocklog as B
from ledgerloom.sources import eml as E


def mails(spark, *rows):
    return spark.createDataFrame([(i, f"m{i}", "f", s, "a@x", "b@x", b, len(b or ""), i) for i, s, b in rows], "email_id long, message_id string, folder string, subject string, sender string, recipient string, body string, size long, write_seq long")


def test_field_search_counts_fields(spark):
    got = S.field_search(mails(spark, (1, "Alpha", "alpha beta"), (2, "x", "ALPHA"), (3, None, None)), "alpha").collect()
    assert [(r.email_id, r.relevance, r.matched_fields) for r in got] == [(1, 2.0, "subject,body"), (2, 1.5, "body")]


def test_and_is_within_or(spark):
    m = S.postings(mails(spark, (1, "", "red green blue"), (2, "", "red green"), (3, "", "red")))
    both = {r.email_id for r in S.search_all(m, "red green").collect()}
    some = {r.email_id for r in S.search_any(m, "red green").collect()}
    assert both == {1, 2} and both <= some == {1, 2, 3}
    assert S.search_all(m, "pink red").count() == 0 and S.search_all(m, "red pink").count() == 3 and S.search_all(m, "").count() == 0


def test_latest_by_write_order_not_time(spark):
    rows = spark.createDataFrame([(1, 1, "b", datetime.datetime(2024, 1, 2)), (1, 2, "a", datetime.datetime(2024, 1, 1)), (2, 3, "", None)], "block_id long, write_seq long, payload string, ts timestamp")
    assert {(r.block_id, r.payload) for r in O.latest(rows).collect()} == {(1, "a"), (2, "")}


def test_packing_never_exceeds(spark):
    m = mails(spark, *((i, "", "x" * (i * 37 % 90)) for i in range(200)))
    used = O.batch_blocks(O.packed(m, threshold=100)).select("used", F.size("toc").alias("n")).collect()
    assert all(r.used <= 100 or r.n == 1 for r in used) and sum(r.n for r in used) == 200


def test_tampering_shows_once(spark):
    log = spark.createDataFrame([(1, i, "t", str(i)) for i in range(9)], "block_id long, write_seq long, type string, payload string")
    chain = I.hash_chain(I.block_hashes(log))
    assert I.chain_summary(chain).first().asDict() == {"entries": 9, "invalid": 0, "breaks": 0}
    forged = chain.withColumn("chain_hash", F.when(F.col("seq") == 4, F.sha2(F.lit("x"), 256)).otherwise(F.col("chain_hash")))
    assert I.chain_summary(forged).first().asDict() == {"entries": 9, "invalid": 1, "breaks": 1}


def test_merkle_by_hand(spark):
    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(5)]
    two = lambda a, b: hashlib.sha256((a + b).encode()).hexdigest()
    level = list(h)
    while len(level) > 1:
        level = [two(level[i], level[min(i + 1, len(level) - 1)]) for i in range(0, len(level), 2)]
    chain = spark.createDataFrame([(1, i, x) for i, x in enumerate(h)] + [(2, 0, h[0])], "block_id long, seq long, chain_hash string")
    assert {r.block_id: r.merkle_root for r in I.merkle_roots(chain).collect()} == {1: level[0], 2: h[0]}


def test_versions_stop_at_cycles_and_hops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(900, 901), (901, 900)], "original long, new long")
    starts = spark.createDataFrame([(0,), (149,), (900,), (777,)], "id long")
    assert {r.start: r.hops for r in I.current_versions(links, starts).collect()} == {0: 100, 149: 1, 900: 100, 777: 0}
    assert I.history(links, starts.where("id = 900")).count() == 2


def test_history_has_no_hop_limit(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(150)] + [(900, 901), (901, 902), (902, 901)], "original long, new long")
    got = {(r.start, r.version, r.hops) for r in I.history(links, spark.createDataFrame([(0,), (900,), (777,)], "id long")).collect()}
    assert got == {(0, i, i) for i in range(151)} | {(900, 900, 0), (900, 901, 1), (900, 902, 2), (777, 777, 0)}


def test_moving_into_a_descendant_is_refused(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "a\\b"), (3, 2, "a\\b\\c"), (4, None, "ab")], "folder_id long, parent_id long, path string")
    assert O.move_subtree(tree, "a", "a\\b").collect() == tree.collect()
    assert {r.path for r in O.move_subtree(tree, "a\\b", "ab").collect()} == {"a", "ab\\b", "ab\\b\\c", "ab"}


def test_functions(spark):
    row = spark.range(1).select(
        X.parse_key(F.lit("7:3")).alias("k"), X.parse_key(F.lit("7")).alias("none"), X.first_term(F.lit("Big AND small")).alias("t"), X.folder_valid(F.lit("a\\\\b")).alias("v"),
        H.message_id(F.lit("x")).alias("id"), H.gunzipped(H.gzipped(F.lit(b""))).alias("z"),
    ).first()
    assert (row.k.block, row.k.local, row.none, row.t, row.v, bytes(row.z)) == (7, 3, None, "big", False, b"")
    assert row.id == H.z_base_32(hashlib.sha3_256(b"x").digest())


def test_eml_files(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <1>\r\nFrom: A <a@x>\r\nTo: b@x, c@x\r\nSubject: =?utf-8?q?h=C3=A9?=\r\n\r\nhello\r\n")
    (tmp_path / "b.eml").write_bytes(b"\n")
    (tmp_path / "c.eml").write_bytes(b"\xff\xfe no header at all")
    got = {r.file: r for r in E.read_eml(spark, str(tmp_path)).collect()}
    assert (got["a.eml"].subject, got["a.eml"].sender, got["a.eml"].recipients, got["a.eml"].ok) == ("hé", "a@x", "b@x; c@x", True)
    report = E.import_report(E.read_eml(spark, str(tmp_path))).first()
    assert (report.imported, report.failed, E.import_errors(E.read_eml(spark, str(tmp_path))).count()) == (1, 2, 2)


def test_magic_scan(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"..MAGMAGIC..MAGIC")
    assert [r.position for r in B.magic_positions(spark, str(tmp_path), b"MAGIC").collect()] == [5, 12]


def test_logs_and_archives(spark, tmp_path):
    entries = spark.createDataFrame([(datetime.datetime(2024, 1, i), "op", str(i), {"k": "v"}) for i in range(1, 6)], B.LOG_ENTRY)
    B.append_log(entries, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.txt").write_text("not json\n")
    assert [r.details for r in B.log_tail(spark, str(tmp_path / "log"), 2).collect()] == ["4", "5"]
    blocks = spark.createDataFrame([(1, 1, "m", "old"), (1, 2, "m", "new"), (5, 3, "s", "x")], "block_id long, write_seq long, type string, payload string")
    B.append_blocks(blocks, str(tmp_path / "blocks"))
    assert B.open_archive(spark, str(tmp_path / "blocks"))[1]["metadata"] == "new"
    B.compact_blocks(spark, str(tmp_path / "blocks"), str(tmp_path / "small"))
    assert spark.read.parquet(str(tmp_path / "small")).count() == 2
    B.save_index(blocks.select("block_id", "write_seq"), str(tmp_path / "index"))
    assert B.load_index(spark, str(tmp_path / "index"), "block_id long, write_seq long").count() == 3


def test_stream_drops_repeats(spark, tmp_path):
    from ledgerloom.streaming.ingest import ingest_once, windowed_counts

    spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 1))], "message_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("message_id string, ts timestamp").parquet(str(tmp_path / "in"))
    ingest_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert windowed_counts(stream, by="message_id").isStreaming


def test_empty_tables(spark):
    none = mails(spark, (1, "a", "b")).where("false")
    assert O.packed(none).count() == 0 and S.field_search(none, "a").count() == 0 and O.content_duplicates(none).count() == 0
    log = spark.createDataFrame([], "block_id long, write_seq long, type string, payload string")
    assert I.chain_summary(I.hash_chain(I.block_hashes(log))).first().entries == 0
