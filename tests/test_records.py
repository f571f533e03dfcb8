"""Values that SQL can't check: CRCs, ids, codecs, ranges of files, compensation, and exact quantiles."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import hashing as H
from ledgerloom.operators import records as R
from ledgerloom.plans.views import messages
from ledgerloom.sources import blocklog as B


def test_crc_and_ids_of_all_messages(spark, sf_dir):
    rows = {r.email_id: r for r in messages(spark, sf_dir).collect()}
    for r in catalog.queries()["fn10_crc32"](spark, sf_dir).collect():
        assert r.crc == zlib.crc32(rows[r.email_id].body.encode())
    for r in catalog.queries()["fn8_message_ids"](spark, sf_dir).collect():
        m = rows[r.email_id]
        assert r.hashed_id == H.z_base_32(hashlib.sha3_256((m.message_id + m.subject + m.sender + m.recipient).encode()).digest())


def test_unknown_codec_is_refused(spark):
    df = spark.createDataFrame([(bytearray(b"abc" * 50), 9)], "raw binary, codec int")
    with pytest.raises(Exception, match="no codec 9"):
        df.select(H.compressed("raw", "codec")).collect()


def test_magic_across_ranges(spark, tmp_path):
    rng = random.Random(4)
    content = bytes(rng.choice(b"AB") for _ in range(500))
    (tmp_path / "x.bin").write_bytes(content)
    (tmp_path / "empty.bin").write_bytes(b"")
    want = [i for i in range(len(content)) if content[i : i + 3] == b"ABA"]
    for span in (1, 7, 64, 1000):
        assert sorted(r.position for r in B.magic_positions(spark, str(tmp_path), b"ABA", span).collect()) == want


def test_compensation_undoes_the_last_first():
    done = []
    with pytest.raises(ValueError), R.Compensation() as steps:
        steps.do(lambda: done.append("a"), lambda: done.append("undo a"))
        steps.do(lambda: done.append("b"), lambda: 1 / 0)
        raise ValueError
    assert done == ["a", "b", "undo a"] and len(steps.errors) == 1
    with R.Compensation() as steps:
        steps.do(lambda: done.append("c"), lambda: done.append("undo c"))
    assert done[-1] == "c"


def test_quantiles_by_brute_force(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, 1.0, 2.5, rng.random() * 100])) for k, n in (("hot", 900), ("cold", 7), (None, 40), ("one", 1)) for _ in range(n)]
    got = {r.k: r for r in R.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"low": 0.1, "median": 0.5, "p95": 0.95}, nearest={"p95"}).collect()}
    for k in got:
        v = sorted(x for key, x in rows if key == k and x is not None)
        at = lambda share: (len(v) - 1) * share
        mix = lambda share: v[int(at(share))] + (v[min(int(at(share)) + 1, len(v) - 1)] - v[int(at(share))]) * (at(share) % 1)
        assert (got[k].n, got[k].p95) == (len(v), v[int(len(v) * 0.95)]) and abs(got[k].low - mix(0.1)) < 1e-9 and abs(got[k].median - mix(0.5)) < 1e-9


def test_quarters_equal_ntile(spark):
    df = spark.range(1003).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 100_003).alias("o")).where("k < 2 or o < 9000")
    both = R.quarters(df, "k", "o", span=1000).selectExpr("k", "quarter", "ntile(4) over (partition by k order by o) as want")
    assert both.where("quarter <> want").count() == 0 and both.count() == df.count()


def test_moves_name_the_new_version(spark):
    m = spark.createDataFrame([(1, "a", "in"), (2, "b", "in")], "email_id long, message_id string, folder string")
    moves = spark.createDataFrame([(2, "out", 9)], "email_id long, folder string, seq long")
    assert sorted(map(tuple, R.moved_versions(m, moves).fillna("-").collect())) == [(1, "a", "in", "-"), (2, "b", "in", "b_moved_9"), (2, "b_moved_9", "out", "-")]


def test_settings():
    s = R.MaintenanceSettings()
    assert (s.interval_hours, s.threshold_bytes, s.least_age_hours, s.key_versions, s.backups, [p for _, p in s.phases]) == (24, 1 << 30, 24, 5, 3, [10, 30, 50, 80, 100])
