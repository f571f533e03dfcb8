"""Packing across spans, nulls and ties in the store, long paths, long chains."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import integrity, store
from ledgerloom.operators.folds import ordered_fold
from ledgerloom.operators.packing import Rule, pack


def fold(sizes, rule):
    """Plain greedy packing, row by row."""
    out, block, local, used = [], 0, -1 if rule.before else 0, 0
    for size in sizes:
        cost = max(size or 0, 0) + rule.prefix
        if rule.before:
            if local >= 0 and used + cost > rule.limit:
                block, local, used = block + 1, -1, 0
            local, used = local + 1, used + cost
            out.append((block, local))
        else:
            used += cost
            out.append((block, local))
            block, local, used = (block + 1, 0, 0) if used >= rule.limit else (block, local + 1, used)
    return out


def test_packing_equals_a_fold_over_the_whole_run(spark):
    rng = random.Random(3)
    rows = [(r, i, rng.choice([None, 0, 1, 5, 20, 50, 99, 100, 101, 250])) for r, n in (("hot", 400), ("cold", 37), (None, 55), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "folder string, o long, size long")
    for rule in (Rule(100, 4, True), Rule(100, 0, False), Rule(30, 4, True)):
        for span in (1, 7, 1000):
            got = {(x.run, x.o): (x.block_no, x.local_id) for x in pack(df, F.col("folder"), F.col("o"), F.col("size"), rule, span).collect()}
            for r in ("hot", "cold", None, "one"):
                mine = [x for x in rows if x[0] == r]
                assert [got[r, x[1]] for x in mine] == fold([x[2] for x in mine], rule)
    assert pack(df.where("false"), F.col("folder"), F.col("o"), F.col("size"), Rule(9, 4, True)).count() == 0


def test_blocks_run_on_across_spans_of_write_seq(spark):
    df = spark.createDataFrame([(i, "f", 100, w) for i, w in enumerate((99_998, 99_999, 100_000, 100_001, 700_000))], "email_id long, folder string, size long, write_seq long")
    assert sorted((r.email_id, r.block_no, r.local_id) for r in store.packed(df, threshold=320).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 0), (4, 1, 1)]


def test_null_bodies_and_ids(spark):
    df = spark.createDataFrame([(1, None, 1, "a"), (2, None, 2, "a"), (3, "x", 3, None), (4, "x", 4, "")], "email_id long, body string, write_seq long, message_id string")
    assert sorted((r.email_id, r.kept_id, r.duplicate) for r in store.content_duplicates(df).collect()) == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 3, True)]
    full = df.withColumns({"sender": F.lit("s"), "recipient": F.lit(None).cast("string"), "subject": F.col("email_id").cast("string")})
    kept = store.fresh_only(store.identified(full), store.identified(full).where("false"))
    assert sorted(r.email_id for r in kept.collect()) == [1, 3, 4]  # 3 and 4 have no id, and differ
    again = store.fresh_only(store.identified(full), store.identified(full))
    assert again.count() == 0


def test_long_paths_move_whole(spark):
    tail = "\\".join("x" * 99 for _ in range(120))
    df = spark.createDataFrame([(1, None, "a"), (2, 1, f"a\\{tail}"), (3, None, "b")], "folder_id long, parent_id long, path string")
    assert {r.folder_id: r.path for r in store.move_subtree(df, "a", "b").collect()} == {1: "b\\a", 2: f"b\\a\\{tail}", 3: "b"}
    assert store.children(df, "a").count() == 0


def test_one_of_equal_new_folders_is_created(spark):
    tree = spark.createDataFrame([(1, None, "a")], "folder_id long, parent_id long, path string")
    wanted = spark.createDataFrame([("a\\n",), ("a\\n",), ("a",), ("none\\n",)], "path string")
    assert sorted((r.path, r.status) for r in store.create_folders(tree, wanted).collect()) == [("a", "exists"), ("a\\n", "created"), ("a\\n", "exists"), ("none\\n", "no_parent")]


def test_null_keys_are_one_run_of_a_fold(spark):
    df = spark.createDataFrame([(k, i) for k in (None, 1 << 60, (1 << 60) + 1) for i in range(4)], "k long, i long")
    step = lambda state, values: ((state or 0) + 1, (state or 0,))
    got = sorted((r.k or 0, r.i, r.n) for r in ordered_fold(df, "k", ["i"], ["i"], step, "n int").collect())
    assert got == sorted((k, i, i) for k in (0, 1 << 60, (1 << 60) + 1) for i in range(4))


def test_broken_links_are_found(spark):
    hashes = spark.createDataFrame([(1, i, f"h{i}") for i in range(5)], "block_id long, write_seq long, block_hash string")
    chain = integrity.hash_chain(hashes)
    bad = chain.withColumn("previous_hash", F.when(F.col("seq") == 3, F.lit("?")).otherwise(F.col("previous_hash")))
    assert {r.seq: (r.hash_ok, r.link_ok) for r in integrity.verify_links(bad).collect()} == {i: (i != 3, i != 3) for i in range(5)}
    assert {r.seq: r.linked for r in integrity.entry_pairs(bad).collect()} == {0: True, 1: True, 2: False, 3: True}
    gone = integrity.verify_links(chain.where("seq <> 2"))
    assert {r.seq: r.link_ok for r in gone.collect()} == {0: True, 1: True, 3: False, 4: True}
