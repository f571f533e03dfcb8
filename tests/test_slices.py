"""Python work by slices: results of odd rows, what a worker holds, and how often headers and messages are read."""

import email.headerregistry
import random

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import hashing as H
from ledgerloom.functions import slices as L
from ledgerloom.plans.ingest import QUERIES
from ledgerloom.sources import eml as E


def test_slices_cover_all_rows_and_are_bounded():
    rng = random.Random(1)
    rows = [None if rng.random() < 0.1 else b"x" * int(rng.paretovariate(0.6) * 1000 % (3 << 20)) for _ in range(2000)]
    column = pa.array([b"before", *rows], pa.binary()).slice(1)
    got = list(L.slices(column))
    assert [i for start, n in got for i in range(start, start + n)] == list(range(len(rows)))
    assert all(n == 1 or n <= L.SLICE_ROWS and sum(len(x or b"") for x in rows[start : start + n]) <= L.SLICE_BYTES for start, n in got)
    assert list(L.slices(pa.array([], pa.binary()))) == [(0, 0)]


def test_a_header_that_returns_is_read_once(monkeypatch):
    raw = b"From: a@x\r\nTo: b@x, c@x\r\nSubject: once\r\nMessage-ID: <once>\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n"
    reads, real = [], email.headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(email.headerregistry.HeaderRegistry, "__call__", lambda self, name, value: reads.append(name) or real(self, name, value))
    assert len({E.parse_one(raw) for _ in range(50)}) == 1
    assert len(reads) <= 10


def test_named_fields_are_those_of_the_whole_message(spark):
    raws = [b"From: a@x\r\nTo: b@x, c@x\r\n\r\nhi\r\n", b"", None, b"no header", b"Content-Type: text/plain; charset=nope\r\nTo: a@x\r\n\r\nhi\xff", b"To: " + b"u@x, " * 300 + b"v@x\r\n\r\n"]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x)) for i, x in enumerate(raws)], "i int, raw binary")
    whole = df.select("i", E.parse_eml(F.col("raw")).alias("m")).select("i", "m.*")
    some = df.select("i", E.parse_eml(F.col("raw"), "ok", "recipients", "error").alias("m")).select("i", "m.*")
    assert some.columns == ["i", "ok", "recipients", "error"] and some.orderBy("i").collect() == whole.select(some.columns).orderBy("i").collect()
    assert [r.ok for r in some.orderBy("i").collect()] == [True, False, False, False, False, True]


def test_a_query_works_on_each_message_once(spark, sf_dir):
    import __spark_entry__

    for name in ("src10_import_errors", "src10_import_report", "fn18_recipients", "fn16_gzip_round_trip", "fn16_codecs"):
        plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
    assert [f.name for f in QUERIES["fn18_recipients"](spark, sf_dir).schema] == ["email_id", "recipients"]


def test_codecs_of_odd_rows(spark):
    rows = [(i, n, None if x is None else bytearray(x)) for i, (n, x) in enumerate((n, x) for n in range(5) for x in (b"", None, b"a", b"ab" * 5000))]
    df = spark.createDataFrame(rows, "i int, codec int, raw binary")
    back = df.select("raw", H.codec_round_trip("raw", "codec").alias("a"), H.unpacked(H.compressed("raw", "codec"), "codec", F.octet_length("raw")).alias("b"), H.gzip_round_trip("raw").alias("c"), H.gunzipped(H.gzipped("raw")).alias("d"))
    assert all(r.raw == r.a == r.b == r.c == r.d for r in back.collect())


def test_a_worker_holds_a_slice_of_what_it_makes():
    batch = pa.array([random.Random(i).randbytes(2000) for i in range(20_000)], pa.binary())
    before, most = pa.total_allocated_bytes(), 0
    for _ in H.gzip_round_trip.func(iter([batch])):
        most = max(most, pa.total_allocated_bytes() - before)
    assert most < 8 << 20
