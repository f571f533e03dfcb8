"""What every operator and stage gives for nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

import itertools
import math

import numpy as np
import pytest

from ledgerloom.llm import bpe, language_id, lattice, packing, repetition, rule_ensemble, simhash_graph, substring_dedup, suffix_merge, transport

TWICE = " ".join(f"t{i}" for i in range(60))
LONG = " ".join(f"l{i % 90_000}" for i in range(200_000))  # over a megabyte; its second half repeats the first in part
ROWS = [(0, None), (1, ""), (2, " \n\t "), (3, "x"), (4, "é漢"), (5, LONG), (6, TWICE), (7, TWICE), (7, TWICE), (None, TWICE)]
NAMES = "__id __spans span_id spans kept_id kept_rank keep predicted doc bucket at Label TEXT2".split()
SCHEMA = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if t and "t" in t else "xx", len(t or ""), *NAMES) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df, *columns):
    return sorted(((r["doc_id"], *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_bpe(docs, none):
    got = by_id(bpe.encode(docs), "n_bytes", "lossless")
    sizes = {i: None if t is None else len(t.encode()) for i, t in ROWS}
    assert got == sorted(((i, sizes[i], None if sizes[i] is None else True) for i in (0, 1, 2, 3, 4, 5, 6, 7, 7)), key=repr)
    assert {r.doc_id: r.tokens for r in bpe.encode(docs).where("doc_id < 2").collect()} == {0: None, 1: []}
    assert bpe.encode(none).count() == 0


def test_bpe_tables_of_like_vocabularies(spark, tmp_path):
    import base64

    paths = []
    for k, pair in enumerate(((b"ab", b"bc"), (b"bc", b"ab"))):
        tokens = [bytes([b]) for b in range(256)] + [*pair, b"zz"]
        paths.append(tmp_path / f"{k}.vocab")
        paths[-1].write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    abc = spark.createDataFrame([(1, "abc")], "doc_id long, text string").coalesce(1)
    assert [bpe.encode(abc, vocabulary=str(p)).first().tokens for p in (*paths, paths[0])] == [[256, 99], [97, 256], [256, 99]]


def test_language(docs, none):
    got = {(r.doc_id, r.text_ is None): r for r in language_id.identify(docs).withColumnsRenamed({"predicted": "text_"}).collect()}
    assert [(i, True) in got for i in (0, 1, 2)] == [True] * 3 and [(i, False) in got for i in (3, 4, 5, 6, 7)] == [True] * 5
    assert all(got[i, True].ambiguous and not got[i, True].keep for i in (0, 1, 2))
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and {0, 1, 2, None}.isdisjoint(r.doc_id for r in kept.collect()) and [r.doc_id for r in kept.where("doc_id = 7").collect()] == [7, 7]
    assert language_id.identify(none).count() == 0 and language_id.keep_identified(none).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(docs).collect()
    placed = {}
    for r in got:
        placed.setdefault(r.doc_id, []).extend(range(r.start_token, r.start_token + r.n_tokens))
    assert {i: len(x) for i, x in placed.items()} == {3: 1, 4: 1, 5: 200_000, 6: 60, 7: 120} and sorted(placed[5]) == list(range(200_000))
    assert packing.pack_documents(none).count() == 0


def test_quality_rules(docs, none):
    got = by_id(repetition.repetition_rules(docs), "n_tokens", "longest_repeat", "covered_fraction", "keep")
    assert got == sorted([*((i, n, 0, 0.0, True) for i, n in ((0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (6, 60), (7, 60), (7, 60))), (5, 200_000, 110_000, 1.0, False)], key=repr)
    kept = repetition.keep_unrepetitive(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7]
    assert repetition.repetition_rules(none).count() == 0 and repetition.keep_unrepetitive(none).count() == 0


@pytest.mark.parametrize("run", [substring_dedup.repeated_intervals, suffix_merge.merged_intervals])
def test_intervals(docs, none, run):
    assert by_id(run(docs), "kind", "start_token", "end_token") == sorted([(5, "remove", 90_000, 200_000), (5, "repeat", 0, 200_000), (6, "repeat", 0, 60), (7, "remove", 0, 60), (7, "repeat", 0, 60)], key=repr)
    assert run(none).count() == 0


def test_removal(docs, none):
    cut = substring_dedup.remove_repeats(docs)
    texts = {r.doc_id: r for r in cut.where("doc_id <> 7 or doc_id is null").collect()}
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert texts[0].text is None and texts[6].text == TWICE and texts[None].text == TWICE and texts[5].text.split() == LONG.split()[:90_000] and texts[5].n_chars == len(texts[5].text)
    assert {r.text for r in cut.where("doc_id = 7").collect()} == {TWICE}  # rows that share an id stay as they are
    assert texts[5]["__spans"] == "__spans" and substring_dedup.remove_repeats(none).count() == 0


def test_a_text_that_is_removed_whole(spark):
    df = spark.createDataFrame([(1, TWICE, 5), (2, TWICE, 5)], "doc_id long, text string, n_chars long")
    assert by_id(substring_dedup.remove_repeats(df), "text", "n_chars") == [(1, TWICE, 5), (2, "", 0)]


def test_classifier(docs, none, spark):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rule_ensemble.classify(docs, labels).collect()}
    assert set(got) == set(range(8)) and (got[0].quality, got[0].toxicity) == (got[1].quality, got[1].toxicity)
    assert rule_ensemble.classify(none, labels).count() == 0
    assert all(r.quality is None and r.keep for r in rule_ensemble.classify(docs, labels.where("false")).collect())


def test_lm(docs, none):
    got = [(r.doc_id, r.n_words, r.log_prob, r.bits_per_byte) for r in lattice.score(docs).collect()]
    assert sorted(x[:2] for x in got) == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 200_000), (6, 60), (7, 60), (7, 60)]
    assert all(p == 0.0 and b is None for i, _, p, b in got if i < 3) and len({p for i, _, p, _ in got if i in (6, 7)}) == 1
    assert all(math.isfinite(p) and p < 0 for i, _, p, _ in got if i > 2) and lattice.score(none).count() == 0


def test_streams(docs, none):
    got = transport.text_transport_index(docs)
    units = {i: -(-len(t.encode()) // 8192) for i, t in ROWS if t and i is not None}
    assert {(r.doc_id, r.program): r["count"] for r in got.groupBy("doc_id", "program").count().collect()} == {(i, k): n * (2 if i == 7 else 1) for i, n in units.items() for k in (1, 2)}
    assert got.where("doc_id = 5 and not complete").count() == got.where("doc_id = 5 and breaks = 1").count() == len([i for i in range(units[5]) if i % 7 == 3])
    assert transport.text_transport_index(none).count() == 0


def test_near_duplicates(docs, none):
    assert by_id(simhash_graph.near_duplicates(docs, shards=2), "group_id", "keep", "n_links") == [*((i, i, True, 0) for i in range(7)), (7, 6, False, 0)]
    kept = simhash_graph.keep_one_of_each(docs, shards=2)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(7))
    again = docs.where("doc_id = 7")
    assert [r.doc_id for r in simhash_graph.keep_one_of_each(again, shards=2).collect()] == [7]  # one of the rows that are equal
    assert simhash_graph.near_duplicates(none).count() == 0 and simhash_graph.keep_one_of_each(none).count() == 0


def test_links_of_near_copies(spark):
    words = TWICE.split()
    texts = [TWICE, TWICE, " ".join([*words[:59], "z"]), " ".join(["y", *words[1:]]), " ".join(f"u{i}" for i in range(60))]
    got = by_id(simhash_graph.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=2), "group_id", "n_links")
    assert [g for _, g, _ in got] == [0, 0, 0, 0, 4] and got[0][2] == got[1][2] and got[4][2] == 0
    assert sum(n for i, _, n in got if i in (0, 2, 3)) >= 4  # three texts have two links at least


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf_dir}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_edge_cases(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", "s", len(t or "")) for i, t in ROWS] + [(100 + i, " ".join(f"n{i * 50 + k}" for k in range(30)), "en", "s", 9) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    placed = {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
    assert placed == {3: 1, 4: 1, 6: 60} | {100 + i: 30 for i in range(20)}


# brute force


def plain_features(text):
    fold = [b | 32 if 65 <= b <= 90 or 97 <= b <= 122 else b if b >= 128 else 32 for b in text.encode()]
    counts = {}
    for size in (1, 2, 3):
        for i in range(len(fold) - size + 1):
            gram = 0
            for b in fold[i : i + size]:
                gram = (gram * 257 + b) % (1 << 32)
            slot = ((gram * 2654435761 + size * 40503) % (1 << 32) >> 7) % language_id.DIMENSIONS
            counts[slot] = counts.get(slot, 0) + 1
    norm = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(v) / norm for k, v in counts.items()}


def test_decoding_by_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 3000")
    model = language_id.train(df)
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in language_id.identify(df, model=model).collect():
        x = plain_features(texts[r.doc_id])
        loss = {}
        outputs = [sum(v * float(model.weights[k, j]) for k, v in x.items()) + float(model.bias[j]) for j in range(model.code.shape[1])]
        for name, word in zip(model.languages, model.code.tolist()):
            loss[name] = sum(math.log1p(math.exp(-bit * out)) for bit, out in zip(word, outputs)) / len(word)
        best, second = sorted(loss, key=loss.get)[:2]
        assert (r.predicted, r.runner_up) == (best, second) or abs(loss[best] - loss[r.predicted]) < 1e-5
        assert abs(r.margin - (loss[second] - loss[best])) < 1e-4


def test_scores_by_brute_force(spark):
    texts = ["the cat", "the the hat", "a", "catcat hat", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    v = lattice.corpus_weights(df, lattice.load(lattice.VOCABULARY))
    p = {s: math.exp(w) for s, w in zip(v.surfaces, v.log_p)}

    def total(word):
        return sum(p[word[:k]] * (total(word[k:]) if k < len(word) else 1.0) for k in range(1, len(word) + 1) if word[:k] in p)

    for r in lattice.score(df, weights=v).collect():
        words = (texts[r.doc_id] or "").split()
        want = sum(math.log(total(b" " + w.encode())) for w in words)
        size = sum(len(w.encode()) for w in words)
        assert math.isclose(r.log_prob, want, rel_tol=1e-9, abs_tol=1e-9) and (r.n_words, r.n_bytes) == (len(words), size)
        assert r.bits_per_byte is None if not size else math.isclose(r.bits_per_byte, -want / math.log(2) / size, rel_tol=1e-9)


def maximal(words, least):
    """Number of repeats of least words or more that can't be made longer at either end with all their places."""
    n, found = len(words), 0
    for size in range(least, n):
        places = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in places.values():
            before, after = ([words[i + d] if 0 <= i + d < n else (None, i) for i in at] for d in (-1, size))
            found += len(at) > 1 and len(set(before)) > 1 and len(set(after)) > 1
    return found


def test_maximal_repeats_and_limits_by_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, size, n)) for n, size in itertools.product((0, 3, 20, 60), (2, 3, 8, 100)) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in repetition.repetition_rules(df).collect():
        words = texts[r.doc_id].split()
        assert r.maximal_repeats == maximal(words, repetition.LEAST), texts[r.doc_id]
        spans = {}
        for size in range(1, len(words)):
            for i in range(len(words) - size + 1):
                spans.setdefault(tuple(words[i : i + size]), []).append(i)
        repeats = {k: v for k, v in spans.items() if len(v) > 1}
        longest = max(map(len, repeats), default=0)
        covered = len({i + j for k, v in repeats.items() if len(k) >= repetition.LEAST for i in v for j in range(len(k))})
        places = len({i for k, v in repeats.items() if len(k) == longest for i in v})
        keep = longest <= repetition.MAX_LONGEST and (max(longest, covered) < repetition.MAX_SHARE * len(words) or longest < repetition.LEAST)
        keep &= covered - (2 * longest if places == 2 else 0) <= repetition.MAX_FRACTION * len(words)
        assert (r.longest_repeat, r.covered_tokens, r.keep) == (longest, covered, keep)


def test_a_hot_passage_fills_no_task(spark):
    """One passage in all of many texts: what the buckets get follows contents, not places."""
    from ledgerloom.llm import marks

    n = 20_000
    df = spark.range(0, n, 1, 4).selectExpr("id as doc_id", f"concat('{TWICE} a', id) as text")
    got = substring_dedup.repeated_intervals(df).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"repeat": n, "remove": n - 1}
    sent = df.mapInArrow(substring_dedup._scatter(40, 8), substring_dedup._BUCKETS).where("kind = 0").selectExpr("sum(length(hashes)) / 8 as n").first().n
    assert sent <= 4 * 21 + n + 100  # 21 windows of the passage from each of four tasks, one more window a text
    assert marks.Sent(0).known(np.array([1], np.uint64), np.array([1]), np.array([1]), np.array([True])).tolist() == [False]
