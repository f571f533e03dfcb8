"""Operator 6: quality classifier by a sparse rule ensemble, compiled into Spark column expressions.

Statistics of a text are built-in column expressions. Boosted trees on a bounded labelled sample give paths, each a
conjunction of comparisons of statistics; a lasso logistic regression keeps few of these rules; the model becomes one
column expression, so scoring is a scan without Python. There are two heads: quality, and toxicity, which also has the
shares of words that begin like those of two lexicons, which the sample itself gives: all beginnings of four characters
that nearly only toxic rows have, and all that toxic rows have three times as often as the whole sample.

The sample has about `sample` rows of `labels`, drawn by a hash of the id: the bound is this parameter, and what
reaches the driver are numbers for each sampled row and the lexicon, never texts. Scores and statistics cover all rows.

Results for edge cases: a null text counts as empty; its statistics are 0. Rows without an id are left out; rows that
share an id are scored one by one; labels that contradict each other for an id count as bad and toxic. Without labels,
or with an empty table, scores are null and keep is true; with labels of one class only, that class's share is the
score. Null labels are ignored. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import cut, keyed, spread

SAMPLE, TREES, DEPTH, PENALTY, STEM = 6000, 40, 3, 0.004, 4
STATISTICS = ("n_chars", "n_words", "word_length", "distinct_words", "upper", "digits", "symbols", "exclamations", "stops", "lines")


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"[\s\p{Punct}]+")


def _begin(words: Column, stems: list[str]) -> Column:
    """Number of words that begin like one of the stems: a look-up in a set for each, however many stems there are."""
    return F.size(F.filter(words, lambda w: F.substring(w, 1, STEM).isin(stems)))


def statistics(text: Column, lexicon: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """Column expressions of a text without nulls; shares are of characters, stops and lines of words.

    One pass over the text leaves the characters that are counted, so each count reads these alone.
    """
    n, w = F.length(text), words(text)
    many = F.greatest(F.size(w), F.lit(1))
    few = F.regexp_replace(text, r"[^\p{Lu}0-9|&%$#*<>{}=_~^@\\!.?;:\n]+", "")
    share = lambda pattern: F.regexp_count(few, F.lit(pattern)) / F.greatest(n, F.lit(1))
    out = {
        "n_chars": n,
        "n_words": F.size(w),
        "word_length": n / many,
        "distinct_words": F.size(F.array_distinct(w)) / many,
        "upper": share(r"\p{Lu}"),
        "digits": share(r"[0-9]"),
        "symbols": share(r"[|&%$#*<>{}=_~^@\\]"),
        "exclamations": share(r"!"),
        "stops": F.regexp_count(few, F.lit(r"[.?;:]")) / many,
        "lines": F.regexp_count(few, F.lit(r"\n")) / many,
    }
    for name, stems in (lexicon or {}).items():
        out[name] = (_begin(w, stems) if stems else F.lit(0)) / many
    return {k: c.cast("double") for k, c in out.items()}


Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, threshold


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def expression(self) -> Column:
        """Probability, as a column expression over columns with the statistics' names."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [(F.col(self.names[j]) > t) if above else (F.col(self.names[j]) <= t) for j, above, t in rule])

        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.bias - sum((holds(rule, x) * w for rule, w in self.rules), np.zeros(len(x)))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= x[:, j] > t if above else x[:, j] <= t
    return out


def _split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[int, float] | None:
    """Statistic and threshold of the largest fall in squared error; the first of equals."""
    best, found, n = 1e-9, None, len(g)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(g[order])
        k = np.arange(1, n)
        gain = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k) - s[-1] ** 2 / n
        gain[(v[1:] <= v[:-1]) | (k < least) | (n - k < least)] = -1
        i = int(np.argmax(gain)) if n > 1 else -1
        if i >= 0 and gain[i] > best:
            best, found = gain[i], (j, float((v[i] + v[i + 1]) / 2))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 5) -> list[Rule]:
    """All paths from the root of boosted trees, each tree fitted to the residuals of half of the rows."""
    rng, f, found = np.random.default_rng(seed), np.zeros(len(y)), {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-f))
        rows = rng.random(len(y)) < 0.5
        if rows.sum() < 2 * least:
            rows[:] = True

        def grow(path: Rule, inside: np.ndarray) -> None:
            sampled = inside & rows
            split = _split(x[sampled], residual[sampled], least) if len(path) < depth and sampled.sum() >= 2 * least else None
            if split is None:
                if sampled.any():
                    p = 1 / (1 + np.exp(-f[sampled]))
                    step = residual[sampled].sum() / max((p * (1 - p)).sum(), 1e-6)
                    leaves.append((inside, float(np.clip(step, -4, 4))))
                return
            for above in (False, True):
                longer = (*path, (split[0], above, split[1]))
                found[longer] = None
                grow(longer, inside & (x[:, split[0]] > split[1] if above else x[:, split[0]] <= split[1]))

        leaves: list[tuple[np.ndarray, float]] = []
        grow((), np.ones(len(y), bool))
        for inside, step in leaves:
            f[inside] += 0.1 * step
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on standardised columns, by the accelerated proximal gradient."""
    mean, spread = z.mean(0), np.maximum(z.std(0), 1e-3)
    s = (z - mean) / spread
    step = 4 / max(np.linalg.norm(s.T @ s / len(y), 2), 1e-9) if s.shape[1] else 1.0
    w, b = np.zeros(s.shape[1]), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c = w, b
    for k in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(s @ v + c, -30, 30))) - y
        u = v - step * (s.T @ r) / len(y)
        u, d = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - r.mean()
        pull = k / (k + 3)
        v, c, w, b = u + pull * (u - w), d + pull * (d - b), u, d
    return b - float((w * mean / spread).sum()), w / spread


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Ensemble:
    if len(np.unique(y)) < 2:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        return Ensemble(names, float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y, trees, depth)
    if not rules:
        return Ensemble(names, float(np.log(y.mean() / (1 - y.mean()))), ())
    z = np.column_stack([holds(r, x) for r in rules]).astype(float)
    bias, weights = lasso(z, y, penalty)
    return Ensemble(names, bias, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, list[str]]
    quality: Ensemble
    toxicity: Ensemble


def _least_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of three tokens in a row (of the whole text, where it has fewer)."""
    for rows, data, offsets in T.chunks(batches, "text"):
        starts, ends, bounds = T.tokens(data, offsets)
        hashes = T.token_hashes(T.LOWER[data], starts, ends)
        out = np.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64)
        first, row = T.windows(bounds, 3)
        out[np.unique(row)] = np.iinfo(np.uint64).max
        np.minimum.at(out, row, T.window_hashes(hashes, first, 3))
        yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in ("doc_id", "text", "q", "t")), pa.array(out.view(np.int64))], ["doc_id", "text", "q", "t", "least"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 23) -> Model | None:
    """Fit both heads on about `sample` labelled rows, drawn by a hash of the id."""
    one = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t"))
    one = one.where("doc_id is not null and q is not null and t is not null")
    n = one.count()
    if not n:
        return None
    drawn = one.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < min(1 << 20, -(-(sample << 20) // n)))
    drawn = drawn.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("t").alias("t"))
    rows = spread(keyed(docs, id_col, text_col)).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id")
    # of near copies one counts, else the words of a text that is copied often would pass for a class's own
    rows = rows.mapInArrow(_least_run, "doc_id long, text string, q double, t double, least long")
    rows = cut(rows.groupBy("least").agg(F.min(F.struct("doc_id", "q", "t", "text")).alias("r")).select("r.*").repartition(docs.sparkSession.sparkContext.defaultParallelism))  # a bounded sample, dealt out
    total = rows.agg(F.count("*").alias("n"), F.sum("t").alias("t")).first()
    if not total["n"]:
        return None
    seen = rows.select("t", F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.substring(w, 1, STEM)))).alias("w")).where(F.length("w") == STEM).groupBy("w").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    base = (total["t"] or 0) / total["n"]
    lexicon = {}
    for name, share in (("listed", max(0.9, base)), ("hinted", min(0.9, 3 * base))):
        stems = seen.where((F.col("t") >= max(3.0, 0.01 * (total["t"] or 0))) & (F.col("t") >= share * F.col("n")))
        lexicon[name] = sorted(r["w"] for r in stems.collect())
    names = (*STATISTICS, *lexicon)
    facts = rows.select("doc_id", "q", "t", *(c.alias(k) for k, c in statistics(F.col("text"), lexicon).items())).collect()
    facts.sort(key=tuple)
    x = np.array([[r[k] for k in names] for r in facts], float)
    q, t = (np.array([r[k] for r in facts], float) for k in ("q", "t"))
    return Model(lexicon, fit(x, q, names), fit(x, t, names))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, threshold: float = 0.5, **options: int) -> DataFrame:
    """(doc_id, quality, toxicity, keep): probabilities, and whether the first reaches and the second misses threshold."""
    model = model or train(docs, labels, id_col, text_col, **options)
    rows = spread(keyed(docs, id_col, text_col)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", none.alias("quality"), none.alias("toxicity"), F.lit(True).alias("keep"))
    facts = rows.select("doc_id", *(c.alias(k) for k, c in statistics(F.col("text"), model.lexicon).items()))
    scored = facts.select("doc_id", model.quality.expression().alias("quality"), model.toxicity.expression().alias("toxicity"))
    return scored.select("*", ((F.col("quality") >= threshold) & (F.col("toxicity") < threshold)).alias("keep"))
