"""The stored index: what a lookup reads, appends, and the same results as from the texts."""

from ledgerloom.operators import search as S
from ledgerloom.operators.inverted import append_index, having, read_index, stored
from ledgerloom.plans.views import messages


def test_lookup_reads_its_folders_and_pushes_its_terms(spark, sf_dir):
    index, _ = stored(messages(spark, sf_dir), S.postings(messages(spark, sf_dir)), "body")
    plan = having(index, ["with", "from"])._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [from,with])" in plan or "In(term, [with,from])" in plan
    assert "PartitionFilters: [((shard" in plan.replace("isnotnull(shard", "((shard") or "shard#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "text" not in plan


def test_appended_messages_are_found(spark, sf_dir, tmp_path):
    every = messages(spark, sf_dir)
    folder = str(tmp_path / "index")
    for part in ("email_id % 2 = 0", "email_id % 2 = 1"):
        append_index(S.postings(every.where(part)), folder, 8)
    index = read_index(spark, folder, 8)
    assert sorted(index.select("term", "email_id").collect()) == sorted(S.postings(every).select("term", "email_id").collect())
    for query in ("the with from", "the zzzunknownzzz with", "zzzunknownzzz the", ""):
        assert sorted(S.search_all(index, query).collect()) == sorted(S.search_all(S.postings(every), query).collect())


def test_a_lookup_of_no_term_is_empty(spark, sf_dir, tmp_path):
    append_index(S.postings(messages(spark, sf_dir).where("false")), str(tmp_path / "none"), 4)
    assert having(read_index(spark, str(tmp_path / "none"), 4), []).count() == 0
    assert having(read_index(spark, str(tmp_path / "none"), 4), ["with"]).count() == 0


def test_folders_follow_the_table(spark, sf_dir, tmp_path, monkeypatch):
    from ledgerloom.operators import inverted

    every = messages(spark, sf_dir)
    monkeypatch.setattr(inverted, "_source", lambda df: ("a-table-of-6-gb", 6 << 30))
    monkeypatch.setattr(inverted, "shared_folder", lambda s: str(tmp_path))
    built, _ = stored(every, S.postings(every), "body")
    assert built.schema["shard"].metadata["shards"] >= 256
    files = [p for p in (tmp_path / "ledgerloom-index").rglob("*.parquet") if "shard=" in str(p)]
    assert len({p.parent for p in files}) > 100
    assert sorted(having(built, ["with", "from"]).collect()) == sorted(having(S.postings(every), ["with", "from"]).collect())
