"""Operator 2: language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits; one binary logistic classifier a bit predicts it from hashed n-grams of one to
three bytes. Decoding sums the logistic loss of all bits against each codeword and takes the language of least loss.
Where the runner-up is closer than `margin` (mean loss a bit), or the text has fewer than `letters` letters, the row is
flagged ambiguous. Letters are those of ASCII, and all other characters but those of the blocks of Latin-1 signs, general
punctuation to symbols (U+2000 to U+2FFF), CJK punctuation and pictographs.

Training takes a bounded sample of labelled rows: about `per_language` for each label, drawn by a hash of the id, so a
larger table costs one more pass and no more memory. Up to five languages get the exhaustive code; more get random
codewords of 15 bits a language at a fixed seed, the set with the largest least distance out of 64 draws.

Results for edge cases: null and empty texts, and texts without a letter, have language null and are ambiguous (so the
filter rejects them). Rows without an id are left out; rows without a label are predicted and not trained on. With no
labelled row at all, or an empty table, every language is null; with one language all texts with letters get it. Rows
that share an id are judged one by one. Only the id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import kept, keyed, spread

DIMENSIONS, PER_LANGUAGE, MARGIN, LETTERS, ROWS = 4096, 400, 0.02, 1, 512
_SCHEMA = "doc_id long, predicted string, runner_up string, margin double, ambiguous boolean, keep boolean"

#: Letters in lower case, bytes of non-ASCII characters as they are, anything else a space.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, each 1 or -1
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray


def _letters(data: np.ndarray) -> np.ndarray:
    """Whether a letter begins at each byte of UTF-8."""
    second = np.append(data[1:], np.uint8(0)) if len(data) else data
    signs = (data == 0xC2) | (data == 0xE2) | ((data == 0xE3) & (second == 0x80)) | ((data == 0xF0) & (second == 0x9F))
    return (((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)) | ((data >= 0xC2) & ~signs)


def features(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of hashed n-gram counts, each row of length 1, and the number of letters of each row."""
    n = len(offsets) - 1
    folded = _FOLD[data]
    letters = np.diff(np.concatenate([[0], np.cumsum(_letters(data))])[offsets])
    rows = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.zeros(n * dimensions, np.int64)
    gram = folded
    for size in (1, 2, 3):
        if size > 1:
            gram = gram[:-1] * np.uint32(257) + folded[size - 1 :]
        if not len(gram):
            break
        inside = rows[: len(gram)] == rows[size - 1 :]
        slot = ((gram * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(7)) % np.uint32(dimensions)
        counts += np.bincount((rows[: len(gram)] * dimensions + slot)[inside], minlength=n * dimensions)
    x = np.sqrt(counts.reshape(n, dimensions).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), letters


def codewords(languages: int) -> np.ndarray:
    """Rows of 1 and -1: exhaustive up to five languages, the best of random ones beyond."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        columns = [(1, *bits) for bits in product((1, -1), repeat=languages - 1) if -1 in bits]
        return np.array(columns, np.int8).T
    rng, best = np.random.default_rng(7), None
    for _ in range(64):
        code = rng.choice(np.array([1, -1], np.int8), (languages, int(np.ceil(15 * np.log2(languages)))))
        gap = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if best is None or gap > best[0]:
            best = gap, code
    return best[1]


def fit(texts: list[str], labels: list[str], dimensions: int = DIMENSIONS, rounds: int = 120, ridge: float = 1e-4) -> Model:
    """Logistic classifiers of all bits at once, by Nesterov's gradient method."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    x, _ = features(data, offsets, dimensions)
    place = {name: i for i, name in enumerate(languages)}
    y = code[[place[label] for label in labels]].astype(np.float32)
    w, b = np.zeros((dimensions, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    v, c, step = w, b, 2.0
    for k in range(rounds):
        g = -y / (1 + np.exp(np.clip(y * (x @ v + c), -30, 30))) / len(y)
        next_w, next_b = v - step * len(languages) * (x.T @ g + ridge * v), c - step * g.sum(0)
        pull = k / (k + 3)
        v, c, w, b = next_w + pull * (next_w - w), next_b + pull * (next_b - b), next_w, next_b
    return Model(languages, code, w, b)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second language of each row and the gap of their mean losses a bit."""
    f = np.clip(x @ model.weights + model.bias, -30, 30)
    hit, miss = np.log1p(np.exp(-f)), np.log1p(np.exp(f))
    positive = (model.code == 1).astype(np.float32)
    loss = (hit @ positive.T + miss @ (1 - positive).T) / model.code.shape[1]
    order = np.argsort(loss, axis=1, kind="stable")
    rows = np.arange(len(x))
    second = order[:, min(1, order.shape[1] - 1)]
    gap = loss[rows, second] - loss[rows, order[:, 0]] if len(model.languages) > 1 else np.full(len(x), np.inf)
    return order[:, 0], second, gap


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 17) -> Model | None:
    """Fit on about per_language rows of each label, drawn by a hash of the id."""
    labelled = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label")).where("doc_id is not null and label is not null")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1 << 20, -(-(per_language << 20) // n))))), F.col("text2"))
    rows = keyed(df, id_col, text_col, label_col).where("text is not null and text2 is not null").where(draw < share).select("doc_id", "text", "text2").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text2"], r["text"]))
    return fit([r["text"] for r in rows], [r["text2"] for r in rows]) if rows else None


def _predict(model: Model | None, margin: float, letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, "text", rows=ROWS):
            n = len(offsets) - 1
            if model is None:
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), none, none, pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, bool))], ["doc_id", "predicted", "runner_up", "margin", "ambiguous", "keep"])
                continue
            x, found = features(data, offsets, len(model.weights))
            best, second, gap = decode(model, x)
            none = found == 0
            names = np.array(model.languages, object)
            ambiguous = none | (gap < margin) | (found < letters)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(names[best], pa.string(), mask=none), pa.array(names[second], pa.string(), mask=none | (len(names) < 2)), pa.array(gap.astype(np.float64), mask=none | ~np.isfinite(gap)), pa.array(ambiguous), pa.array(~ambiguous)],
                ["doc_id", "predicted", "runner_up", "margin", "ambiguous", "keep"],
            )

    return run


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None, margin: float = MARGIN, letters: int = LETTERS, **sample: int) -> DataFrame:
    """(doc_id, predicted, runner_up, margin, ambiguous, keep) for every row; a model is fitted on df if none is given."""
    model = model or train(df, id_col, text_col, label_col, **sample)
    return spread(keyed(df, id_col, text_col)).mapInArrow(_predict(model, margin, letters), _SCHEMA)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", model: Model | None = None, margin: float = MARGIN, letters: int = LETTERS, **sample: int) -> DataFrame:
    """Rows of df whose language is clear, each judged by itself; rows without an id go. All columns stay as they are."""
    model = model or train(df, id_col, text_col, label_col, **sample)
    return kept(df, id_col, text_col, _predict(model, margin, letters))
