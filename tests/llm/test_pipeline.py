"""The classifier's query and the whole pipeline against plain versions on a small fixture."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import regex
from test_edges import plain_features

from ledgerloom.llm import language_id, packing, repetition, rule_ensemble, simhash_graph, substring_dedup


def plain_statistics(text, lexicon):
    """The statistics of a text by Python's regular expressions alone."""
    n = len(text)
    words = regex.split(r"[\s\p{posix_punct}]+", text.lower())
    many = max(len(words), 1)
    share = lambda pattern: len(regex.findall(pattern, text)) / max(n, 1)
    out = [n, len(words), n / many, len(set(words)) / many, share(r"\p{Lu}"), share("[0-9]"), share(r"[|&%$#*<>{}=_~^@\\]"), share("!")]
    out += [len(re.findall("[.?;:]", text)) / many, text.count("\n") / many]
    return out + [sum(w[: rule_ensemble.STEM] in stems for w in words) / many for stems in map(set, lexicon.values())]


def test_scores_of_the_classifier_by_plain_rules(spark, sf_dir):
    df, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rule_ensemble.train(df, labels)
    assert model.quality.rules and model.toxicity.rules
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    wrong = 0
    for r in rule_ensemble.classify(df, labels, model=model).collect():
        x = plain_statistics(texts[r.doc_id], model.lexicon)
        want = []
        for head in (model.quality, model.toxicity):
            total = head.bias + sum(w for rule, w in head.rules if all((x[j] > t) == above for j, above, t in rule))
            want.append(1 / (1 + math.exp(-total)))
        wrong += not np.allclose([r.quality, r.toxicity], want, atol=1e-9)
        assert r.keep == (r.quality >= 0.5 and r.toxicity < 0.5)
    assert wrong <= len(texts) // 100  # the two languages' ideas of spaces and punctuation differ in a few characters


@pytest.fixture
def corpus():
    rng = random.Random(21)
    vocabulary = {"aa": [f"ba{i}na" for i in range(300)], "bb": [f"zu{i}xy" for i in range(300)]}
    rows, number = [], itertools.count()

    def add(words, lang):
        rows.append((next(number), " ".join(words), lang, "s", len(" ".join(words))))

    passage = [f"pass{i}age" for i in range(55)]
    for lang in ("aa", "bb"):
        for k in range(25):
            words = [rng.choice(vocabulary[lang]) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 90))]
            add(words, lang)
            if k % 5 == 0:  # an exact copy and near ones
                add(words, lang)
                add([w if i % 12 else f"e{i}" for i, w in enumerate(words)], lang)
            if k % 6 == 0:  # repeats itself
                add(words[:12] * 6, lang)
            if k % 8 == 0:
                add([*(f"{w}q{k}" for w in words), *passage, f"end{k}"], lang)
    add([], "aa")
    return rows


def test_pipeline_by_brute_force(spark, corpus, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(corpus, schema).write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    docs = {r[0]: r[1].split() for r in corpus}
    # 1: language
    model = language_id.train(df)

    def clear(words):
        if not words:
            return False
        x = plain_features(" ".join(words))
        loss = sorted(sum(math.log1p(math.exp(-b * (sum(v * float(model.weights[k, j]) for k, v in x.items()) + float(model.bias[j])))) for j, b in enumerate(code)) / len(code) for code in model.code.tolist())
        return loss[1] - loss[0] >= language_id.MARGIN

    docs = {i: w for i, w in docs.items() if clear(w)}

    # 2: quality
    def fine(words):
        spans = {}
        for size in range(1, len(words)):
            for i in range(len(words) - size + 1):
                spans.setdefault(tuple(words[i : i + size]), []).append(i)
        repeats = {k: v for k, v in spans.items() if len(v) > 1}
        longest = max(map(len, repeats), default=0)
        covered = len({i + j for k, v in repeats.items() if len(k) >= repetition.LEAST for i in v for j in range(len(k))})
        places = len({i for k, v in repeats.items() if len(k) == longest for i in v})
        keep = longest <= repetition.MAX_LONGEST and (max(longest, covered) < repetition.MAX_SHARE * len(words) or longest < repetition.LEAST)
        return keep and covered - (2 * longest if places == 2 else 0) <= repetition.MAX_FRACTION * len(words)

    docs = {i: w for i, w in docs.items() if fine(w)}
    # 3: near-duplicates
    sets, root = {i: set(w) | set(zip(w, w[1:])) for i, w in docs.items()}, {i: i for i in docs}
    for i, j in itertools.combinations(sorted(docs), 2):
        if len(sets[i] & sets[j]) >= simhash_graph.JACCARD * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
    docs = {i: w for i, w in docs.items() if root[i] == i}
    # 4: passages
    seen, width = set(), substring_dedup.WIDTH
    drop = {i: set() for i in docs}
    for i in sorted(docs):
        for p in range(len(docs[i]) - width + 1):
            window = tuple(docs[i][p : p + width])
            if window in seen:
                drop[i] |= set(range(p, p + width))
            seen.add(window)
    assert any(drop.values())
    docs = {i: [t for k, t in enumerate(w) if k not in drop[i]] for i, w in docs.items()}
    # 5: packing
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    placed, bins = {}, {}
    for r in got:
        placed.setdefault(r.doc_id, []).extend(range(r.start_token, r.start_token + r.n_tokens))
        bins.setdefault(r.bin_id, []).append((r.position, r.n_tokens))
    assert {i: sorted(x) for i, x in placed.items()} == {i: list(range(len(w))) for i, w in docs.items() if w}
    want = packing.pack(sorted((len(w) for w in docs.values() if w), reverse=True), packing.CAPACITY)
    assert sorted(sorted(n for _, n in b) for b in bins.values()) == sorted(sorted(b) for b, _ in want)
    assert all(sorted(p for p, _ in b) == list(range(len(b))) for b in bins.values())
    assert 20 < len(docs) < len(corpus)
