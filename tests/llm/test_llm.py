"""The ten operators: brute-force versions, edge cases, and SQL."""

import base64
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from oracle import connect, same

from ledgerloom.llm import bpe, language_id, lattice, packing, queries, repetition, rule_ensemble, simhash_graph, substring_dedup, suffix_merge, transport
from ledgerloom.llm import text as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, predicted string, keep string, stream binary"


def docs(spark, *texts, langs=None, ids=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", len(t or ""), "clash", "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf_dir):
    same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir).sql(queries.ORACLE_SQL[name]))


EDGES = [None, "", " \n\t ", "x", "é漢", "w " * 3000, "the same text twice over here", "the same text twice over here"]


@pytest.mark.parametrize(
    "run",
    [
        lambda s, d: bpe.encode(d),
        lambda s, d: language_id.identify(d),
        lambda s, d: packing.pack_documents(d),
        lambda s, d: repetition.repetition_rules(d),
        lambda s, d: substring_dedup.repeated_intervals(d),
        lambda s, d: substring_dedup.remove_repeats(d),
        lambda s, d: rule_ensemble.classify(d, s.createDataFrame([(0, 1, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")),
        lambda s, d: rule_ensemble.classify(d, s.createDataFrame([], "doc_id long, quality int, toxic int")),
        lambda s, d: lattice.score(d),
        lambda s, d: transport.text_transport_index(d),
        lambda s, d: transport.transport_index(d),
        lambda s, d: simhash_graph.near_duplicates(d),
        lambda s, d: suffix_merge.merged_intervals(d),
        lambda s, d: simhash_graph.keep_one_of_each(repetition.keep_unrepetitive(language_id.keep_identified(d))),
    ],
)
def test_edges(run, spark):
    full = docs(spark, *EDGES, ids=[0, 1, 2, 3, 4, 5, 5, None])
    run(spark, full).collect()
    assert run(spark, full.where("false")).count() == 0
    run(spark, docs(spark, None, None)).collect()


# 1


def test_bpe_equals_reference_encoder(spark):
    rng = random.Random(1)
    alphabet = "abcdehilnorstz ABC  \n\t'sll.,!0123éüß漢字😀\u00a0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)] + ["a" * 3000, "don't  stop", "<|endoftext|>"]
    v = bpe.load(bpe.VOCABULARY)
    exact = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(docs(spark, *texts)).collect()}
    assert all(got[i].tokens == exact.encode_ordinary(t) and got[i].lossless for i, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs(spark, *texts, None))).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[len(texts)] is None


def test_bpe_other_vocabulary(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cab"]
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    v = bpe.load(str(tmp_path / "v"))
    exact = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    every = ["".join(p) for n in range(1, 8) for p in itertools.product("abc", repeat=n)]
    ids, at = bpe.Encoder(v)(every)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [exact.encode_ordinary(t) for t in every]


# 2


def test_language_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(d.where("doc_id % 2 = 0"))
    held = d.where("doc_id % 2 = 1 and n_chars > 40")
    got = {r.doc_id: r for r in language_id.identify(held, model=model).collect()}
    right = [got[r.doc_id].predicted == r.lang for r in held.select("doc_id", "lang").collect()]
    assert np.mean(right) >= 0.97


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9):
        code = language_id.codewords(n)
        gap = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert gap >= (1 if n == 2 else 2) and (n < 4 or gap >= 4)


# 3


def best(sizes, capacity):
    found = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                k = bins.index(room)
                go(i + 1, [*bins[:k], room - sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    go(0, [])
    return found[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(1500):
        c = rng.choice([10, 15, 20, 30])
        sizes = [rng.randint(max(1, c // rng.choice([3, 4, 6, 10])), c - 1) for _ in range(rng.randint(1, 8))]
        fixed, left = packing.reduce(sizes, c)
        assert sorted(sum(fixed, []) + left) == sorted(sizes) and all(sum(f) <= c for f in fixed)
        assert best(sizes, c) == len(fixed) + best(left, c)


def test_packing_places_every_token(spark):
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 700)) for _ in range(120)]
    rows = packing.pack_documents(docs(spark, *texts), capacity=256, group_rests=50).collect()
    used, pieces = {}, {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.n_tokens
        pieces.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
    assert max(used.values()) <= 256
    for i, t in enumerate(texts):
        at = 0
        for start, n in sorted(pieces.get(i, [])):
            assert start == at
            at += n
        assert at == len(t.split())


# 4


def repeats(tokens, least):
    n, covered, longest = len(tokens), set(), 0
    for i in range(n):
        reach = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and tokens[i + k] == tokens[j + k]:
                k += 1
            reach = max(reach, k)
        longest = max(longest, reach)
        if reach >= least:
            covered |= set(range(i, i + reach))
    return len(covered), longest


def test_repetition_by_brute_force(spark):
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(0, 70), rng.choice([2, 3, 30])) for _ in range(60)] + ["a a a a a a a a", "A b c d e a B c D e"]
    got = {r.doc_id: (r.covered_tokens, r.longest_repeat) for r in repetition.repetition_rules(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [repeats(t.lower().split(), repetition.LEAST) for t in texts]


def test_mostly_repeated_short_texts_go(spark):
    w = [f"v{i}" for i in range(200)]
    twice = w[:49] + ["x"] + w[:49]
    thrice = w[:30] + ["x"] * 3 + w[:30] + ["y"] * 4 + w[:30] + ["z"] * 3
    framed = w[:20] + w[50:150] + w[:20]
    short = w[:10] + w[50:75] + w[:10]
    texts = [" ".join(t) for t in (twice, thrice, framed, short)] + ["", None]
    got = {r.doc_id: r.keep for r in repetition.repetition_rules(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(6)] == [False, False, True, True, True, True]


# 5 and 10


def windows(texts, width):
    seen, out = {}, {"repeat": {}, "remove": {}}
    for d, t in enumerate(texts):
        w = t.split()
        for p in range(len(w) - width + 1):
            seen.setdefault(tuple(w[p : p + width]), []).append((d, p))
    for places in seen.values():
        for k, (d, p) in enumerate(places):
            for kind in (["repeat"] if len(places) > 1 else []) + (["remove"] if k else []):
                out[kind].setdefault(d, set()).update(range(p, p + width))
    return out


@pytest.mark.parametrize("run", [lambda d: substring_dedup.repeated_intervals(d, width=8), lambda d: suffix_merge.merged_intervals(d, width=8, seed=3)])
def test_repeats_by_brute_force(run, spark):
    rng = random.Random(6)
    passage = words(rng, 12)
    texts = [words(rng, rng.randrange(0, 60), rng.choice([2, 60])) + rng.choice(["", " " + passage]) for _ in range(80)] + ["la " * 50, "la " * 30]
    got = {"repeat": {}, "remove": {}}
    for r in run(docs(spark, *texts)).collect():
        got[r.kind].setdefault(r.doc_id, set()).update(range(r.start_token, r.end_token))
    assert got == windows(texts, 8)


def test_interleave_orders_suffixes():
    rng = np.random.default_rng(7)
    for _ in range(30):
        sizes = rng.integers(1, 12, 9)
        symbols, stops = rng.integers(0, 3, sizes.sum()), np.repeat(np.cumsum(sizes), sizes)
        shard = np.repeat(np.arange(9) // 3, sizes)
        merged, lcp = suffix_merge.interleave(symbols, stops, shard, 6)
        cut = [tuple(symbols[p : min(stops[p], p + 6)]) for p in merged]
        assert sorted(merged.tolist()) == list(range(len(symbols))) and cut == sorted(cut)
        for k in range(1, len(cut)):
            shared = next((i for i, (a, b) in enumerate(zip(cut[k - 1], cut[k])) if a != b), min(len(cut[k]), len(cut[k - 1])))
            assert lcp[k] == (6 if cut[k] == cut[k - 1] else shared)


def test_removal_keeps_the_first_copy(spark):
    passage = " ".join(f"p{i}" for i in range(45))
    got = {r.doc_id: (r.text, r.n_chars, r.keep) for r in substring_dedup.remove_repeats(docs(spark, f"a {passage} z", f"b\n{passage}  y", passage, None)).collect()}
    assert got == {0: (f"a {passage} z", len(passage) + 4, "clash"), 1: ("b\ny", 3, "clash"), 2: ("", 0, "clash"), 3: (None, 0, "clash")}


# 6


def test_classifier_held_out(spark):
    rng = random.Random(8)
    good = [words(rng, 60) + "." for _ in range(250)]
    bad = [(words(rng, 60)).upper().replace(" ", "!! ") for _ in range(120)]
    toxic = [words(rng, 50) + " vilest scoundrel " + words(rng, 5) for _ in range(80)]
    d = docs(spark, *good, *bad, *toxic)
    labels = spark.createDataFrame([(i, int(not 250 <= i < 370), int(i >= 370)) for i in range(450)], "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(d, labels.where("doc_id % 2 = 0"))
    assert 0 < len(model.quality.rules) < 60 and any("scou" in x for x in model.lexicon.values())
    got = {r.doc_id: r.keep for r in rule_ensemble.classify(d, labels, model=model).collect()}
    assert np.mean([got[i] == (i < 250) for i in range(1, 450, 2)]) > 0.98


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    m = rule_ensemble.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), ("a", "b", "c"), trees=10)
    got = [r.p for r in spark.createDataFrame(x.tolist(), "a double, b double, c double").coalesce(1).select(m.expression().alias("p")).collect()]
    assert np.allclose(got, m.predict(x))


# 7


def test_lattice_by_brute_force():
    v = lattice.load(lattice.VOCABULARY)
    p = {s: math.exp(x) for s, x in zip(v.surfaces, v.log_p)}

    def split(w):
        return [[]] if not w else [[w[:k], *rest] for k in range(1, len(w) + 1) if w[:k] in p for rest in split(w[k:])]

    some = ["the", "a", "undo", "éa", "x" * 9, "漢"]
    data, at = T.utf8(pa.array(some))
    ways = [split(b" " + w.encode()) for w in some]
    assert np.allclose(lattice.log_marginals(data, at[:-1], at[1:], v), [math.log(sum(math.prod(p[s] for s in way) for way in w)) for w in ways])
    uses = lattice.expected_uses(data, at[:-1], at[1:], np.ones(len(some)), v)
    want = {}
    for w in ways:
        total = sum(math.prod(p[s] for s in way) for way in w)
        for way in w:
            for s in way:
                want[s] = want.get(s, 0) + math.prod(p[t] for t in way) / total
    assert np.allclose([want.get(s, 0) for s in v.surfaces], uses)


def test_corpus_weights_fit_the_corpus(spark):
    d = docs(spark, *["theta sigma theta"] * 20)
    v = lattice.load(lattice.VOCABULARY)
    before, after = (lattice.score(d, weights=w).first().log_prob for w in (v, lattice.corpus_weights(d, v)))
    assert after > before
    long = "q" * 5000
    assert math.isfinite(lattice.score(docs(spark, long), weights=v).first().log_prob)


# 8


def test_transport_round_trip_and_faults(spark):
    data = bytes(range(256)) * 200
    stream = transport.mux(data)
    units, counts = transport.parse(stream)
    assert b"".join(u[8] for u in units) == data and all(u[9] for u in units) and counts["breaks"] == 0 and counts["programs"] == 1
    assert [u[7] for u in units] == [i % transport.KEY_EVERY == 0 for i in range(len(units))] and [u[6] for u in units] == [i * transport.TICKS for i in range(len(units))]
    rows = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    units, counts = transport.parse(b"".join(rows[:10] + rows[11:]))
    assert counts["breaks"] == 1 and [u[9] for u in units].count(False) == 1
    units, counts = transport.parse(b"".join(rows[:10] + rows[9:]))
    assert counts["duplicates"] == 1 and b"".join(u[8] for u in units) == data
    units, counts = transport.parse(b"junk" + b"".join(rows[:30]) + b"\x47noise" + b"".join(rows[30:]))
    assert counts["lost_sync"] == 2 and b"".join(u[8] for u in units) == data
    for framed in (b"".join(b"abcd" + r for r in rows), b"".join(r + b"x" * 16 for r in rows)):
        assert b"".join(u[8] for u in transport.parse(framed)[0]) == data
    assert transport.parse(b"")[0] == [] and transport.parse(b"\x47" * 1000)[0] == []
    big = 1 << 32
    assert transport._ticks(transport._stamp(2, big + 12345)) == big + 12345
    d = transport.with_streams(docs(spark, "abc", None, "x" * 20_000))
    assert {(r.doc_id, r.unit): bytes(r.payload) for r in transport.transport_payloads(d).collect()}[0, 0] == b"abc"
    assert transport.transport_health(d).where("doc_id = 2").first().breaks == 0


# 9


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(10)
    texts = []
    for _ in range(60):
        w = words(rng, rng.randrange(30, 120), 100_000).split()
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            c = list(w)
            for _ in range(len(c) // 25 + 1):
                c[rng.randrange(len(c))] = f"e{rng.random()}"
            texts.append(" ".join(c))
    texts += [texts[0].upper(), texts[1] + " ", "", ""]

    def features(t):
        w = t.lower().split()
        return set(w) | set(zip(w, w[1:]))

    sets, root = [features(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= simhash_graph.JACCARD * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: r.group_id for r in simhash_graph.near_duplicates(docs(spark, *texts), shards=3).collect()}
    together = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if root[i] == root[j]]
    assert np.mean([got[i] == got[j] for i, j in together]) >= 0.95
    assert all(root[i] == root[j] for i, j in itertools.combinations(range(len(texts)), 2) if got[i] == got[j])


def test_copies_within_templates_by_brute_force(spark):
    rng, texts = random.Random(12), []
    for _ in range(4):
        template = words(rng, 80, 100_000).split()
        for _ in range(25):
            w = list(template)
            for i in rng.sample(range(80), 12):
                w[i] = f"f{rng.random()}"
            for _ in range(3):
                c = list(w)
                c[rng.randrange(80)] = f"e{rng.random()}"
                texts.append(" ".join(c))
    sets, root = [set(w) | set(zip(w, w[1:])) for w in map(str.split, texts)], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= simhash_graph.JACCARD * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert len(set(root)) >= 80
    got = {r.doc_id: r.group_id for r in simhash_graph.near_duplicates(docs(spark, *texts), shards=3).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_graph_recall_and_wide_groups():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, (1500, 4), dtype=np.uint64)
    near = base[:200].copy()
    near[:, 0] ^= rng.integers(0, 1 << 30, 200, dtype=np.uint64)
    group = np.repeat(base[:1], 300, 0)
    group[:, 1] ^= rng.integers(0, 1 << 20, 300, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, near, group]), axis=0)
    graph, share = simhash_graph.audited(prints, simhash_graph.RADIUS, 24, 400, 0.95)
    q, p, _ = graph.search(prints)
    eq, ep, _ = simhash_graph.exact_hits(prints, prints, simhash_graph.RADIUS)
    found, true = set(zip(q.tolist(), p.tolist())), set(zip(eq.tolist(), ep.tolist()))
    assert share >= 0.95 and found <= true and len(found) / len(true) >= 0.95


def test_small_groups_of_other_shards_beside_a_large_one():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    copies = np.concatenate([np.repeat(base[:1], 400, 0), base[1:2001]])
    for k in range(40):
        at = rng.integers(0, 256, len(copies))
        copies[np.arange(len(copies)), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    prints = np.unique(np.concatenate([base, copies]), axis=0)
    prints = prints[rng.permutation(len(prints))]
    half, ids = len(prints) // 2, np.arange(len(prints))
    blobs = [(0, 0, ids[:half].tobytes(), prints[:half].tobytes()), (0, 1, ids[half:].tobytes(), prints[half:].tobytes())]
    batch = pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.int32()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in (2, 3))], ["shard", "kind", "ids", "prints"])
    G = simhash_graph
    found = {(a, b) for out in G._search_shard(1, G.RADIUS, G.BEAM, G.AUDIT, G.RECALL)([batch]) for kind, a, b in zip(*(out.column(c).to_pylist() for c in ("kind", "a", "b"))) if kind == 2}
    q, p, _ = G.exact_hits(prints[:half], prints[half:], G.RADIUS)
    single = np.bincount(q, minlength=len(prints) - half)[q] == 1
    true = set(zip((q[single] + half).tolist(), p[single].tolist()))
    assert len(true) > 500 and len(true & found) >= 0.92 * len(true)


def test_a_failed_audit_keeps_links_every_second_time(monkeypatch):
    rng, G, built = np.random.default_rng(29), simhash_graph, []
    prints = rng.integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    for i in range(300):
        copy = prints[i].copy()
        for at in rng.choice(256, 60, replace=False):
            copy[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        prints[i + 300] = copy
    init = G.Graph.__init__
    monkeypatch.setattr(G.Graph, "__init__", lambda self, *a: (built.append(1), init(self, *a))[1])
    graph, share = G.audited(prints, G.RADIUS, 8, 400, 0.95, None, 1)
    assert len(graph.bits) > 1 and len(built) == 1 + int(np.log2(len(graph.bits))) // 2 and share >= 0.9


def test_look_ups_compare_few_whole_prints_and_find_lone_copies(monkeypatch):
    rng, G, compared = np.random.default_rng(31), simhash_graph, [0]
    prints = rng.integers(0, 1 << 63, (20_000, 4), dtype=np.uint64)
    graph, queries = G.Graph(prints, G.RADIUS, G.BEAM, G.TABLES), rng.integers(0, 1 << 63, (4000, 4), dtype=np.uint64)
    queries[:1000] = prints[:1000]
    for i in range(1000):
        for at in rng.choice(256, 55, replace=False):
            queries[i, at // 64] ^= np.uint64(1) << np.uint64(at % 64)
    plain = G.hamming
    monkeypatch.setattr(G, "hamming", lambda a, b: (compared.__setitem__(0, compared[0] + len(b)), plain(a, b))[1])
    q, p, _ = graph.search(queries)
    assert compared[0] < 30 * len(queries)
    assert len({i for i, j in zip(q.tolist(), p.tolist()) if i == j < 1000}) >= 950


def test_large_groups_give_rows_in_proportion():
    rng, G = np.random.default_rng(17), simhash_graph
    prints = rng.integers(0, 1 << 63, (6000, 4), dtype=np.uint64)
    prints[:3000] = prints[0]
    for _ in range(20):
        at = rng.integers(0, 256, 3000)
        prints[np.arange(3000), at // 64] ^= np.uint64(1) << (at % 64).astype(np.uint64)
    prints, ids = prints[np.argsort(rng.random(6000), kind="stable")], np.arange(6000)
    blobs = [(0, 0, ids[:3000].tobytes(), prints[:3000].tobytes()), (0, 1, ids[3000:].tobytes(), prints[3000:].tobytes())]
    batch = pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.int32()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in (2, 3))], ["shard", "kind", "ids", "prints"])
    rows = [r for out in G._search_shard(1, G.RADIUS, G.BEAM, G.AUDIT, G.RECALL)([batch]) for r in zip(*(out.column(c).to_pylist() for c in ("kind", "a", "b")))]
    q, p, _ = G.exact_hits(prints, prints, G.RADIUS)
    large = np.flatnonzero(np.bincount(q) > 1000)
    assert len(rows) < 10 * len(prints) < len(q) // 100
    links = [(a, b) for kind, a, b in rows if kind in (1, 2, 4, 5)]
    roots, _ = G.spanning(6000, *np.array(links).T, np.zeros(len(links)))
    assert len(large) > 2900 and len(np.unique(roots[large])) == 1


def test_large_template_by_brute_force(spark):
    rng, texts = random.Random(19), []
    template = words(rng, 80, 100_000).split()
    for _ in range(150):
        w = list(template)
        for i in rng.sample(range(80), 12):
            w[i] = f"f{rng.random()}"
        for _ in range(3):
            c = list(w)
            c[rng.randrange(80)] = f"e{rng.random()}"
            texts.append(" ".join(c))
    sets, root = [set(w) | set(zip(w, w[1:])) for w in map(str.split, texts)], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= simhash_graph.JACCARD * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    assert 100 < len(set(root)) <= 150
    got = {r.doc_id: r.group_id for r in simhash_graph.near_duplicates(docs(spark, *texts), shards=2).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_tiles_compare_all_pairs_between_groups():
    rng = np.random.default_rng(23)
    sets = [np.sort(rng.choice(90, 40, replace=False)).astype("<u8") for _ in range(60)]
    packed = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for x in sets]
    near = bytes(32)
    def run(i, j, tile):
        table = pa.table({"doc_id": np.arange(60), "tile": np.array(tile), "label": np.arange(60), "print": pa.array([near] * 60, pa.binary()), "features": pa.array(packed, pa.binary())})
        out = simhash_graph._compare(simhash_graph.RADIUS, 0.35)(tuple(map(pa.scalar, (0, i, j))), table)
        return list(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    true = {(a, b) for a, b in itertools.combinations(range(60), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.35 * len(np.union1d(sets[a], sets[b]))}
    halves = [0] * 30 + [1] * 30
    for got, want in ((run(0, 0, [0] * 60), true), (run(0, 1, halves), {(a, b) for a, b in true if a < 30 <= b})):
        assert set(got) <= want and len(got) < 60
        roots = [simhash_graph.spanning(60, *np.array(sorted(e)).T, np.zeros(len(e)))[0].tolist() for e in (set(got), want)]
        assert roots[0] == roots[1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7)], "a long, b long")
    for most in (0, 100):
        got = {r.id: r.root for r in simhash_graph.components(edges, most).collect()}
        assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}
    assert simhash_graph.components(edges.where("a = 7 and b = 7")).count() == simhash_graph.components(edges.where("a = 7 and b = 7"), 0).count() == 0


# the pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = P.run(spark, sf_dir)
    assert packed.columns == ["bin_id", "position", "doc_id", "piece", "start_token", "n_tokens", "fixed"] and len(P.STAGES) == 5
    for _, stage in P.STAGES[:4]:
        kept = stage(spark, d, sf_dir)
        assert kept.columns == d.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {r.doc_id for r in d.select("doc_id").collect()}
        d = spark.createDataFrame(kept.collect(), kept.schema)
    left = {r.doc_id: len(r.text.split()) for r in d.select("doc_id", "text").collect()}
    got = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert got == {k: n for k, n in left.items() if n}
