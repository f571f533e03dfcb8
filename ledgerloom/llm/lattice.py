"""Operator 7: marginal document likelihood over all segmentations into subwords of an existing vocabulary.

The vocabulary file gives pieces and their order by score. Scores of a merge vocabulary are places, not probabilities,
so a piece's prior is Zipf's law of its place; one round of expectation-maximisation (`rounds`) over the whole corpus
then turns the priors into unigram probabilities: every distinct word of the table, with its count, adds the expected
number of uses of each piece over all its segmentations. Bytes that no piece holds alone have a piece of their own, so
every text has a segmentation.

Pieces never cross white space, so a document's marginal probability is the product of its words'. A word's lattice is
solved by the forward recursion in log space, over all distinct words of one length at once; backward sums for the
expectations likewise. Work follows distinct words; what reaches the driver is one number for each piece. Words of over LONG bytes go
one by one, their lattices built LONG places at a time, so memory follows a word's bytes and not its lattice.

Results for edge cases: null, empty and white-space texts have no word: log_prob 0.0 and null bits_per_byte. Rows
without an id are left out; rows that share an id or text are scored, and counted, one by one. Words of any length are
scored whole. An empty table leaves the priors as they are and gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import keyed, spread

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, PRIOR_USES, ZIPF_SHIFT = 1, 1e3, 2.7
EXACT, CELLS, LONG = 20, 4_000_000, 4096
_SCHEMA = "doc_id long, n_words int, n_bytes int, log_prob double, bits_per_byte double"
_NONE = np.float64(-np.inf)


@dataclass(frozen=True)
class Pieces:
    """Pieces as bytes (a leading space begins a word), their log probabilities, and tables to find them by hash."""

    surfaces: list[bytes]
    log_p: np.ndarray
    sizes: np.ndarray  # distinct lengths in bytes, rising
    hashes: np.ndarray  # sorted
    ids: np.ndarray  # by rank of the hash
    maybe: np.ndarray  # whether any piece's hash has these 20 leading bits

    def weighted(self, log_p: np.ndarray) -> Pieces:
        return Pieces(self.surfaces, log_p, self.sizes, self.hashes, self.ids, self.maybe)


def _prefix(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers, along rows, and inverse powers: a range's hash is one difference and one product."""
    up, down = T._powers(T._BASE, m.shape[1] + 1)
    sums = np.zeros((m.shape[0], m.shape[1] + 1), np.uint64)
    np.cumsum((m.astype(np.uint64) + np.uint64(1)) * up[: m.shape[1]], axis=1, dtype=np.uint64, out=sums[:, 1:])
    return sums, down


def _hash(word: bytes) -> np.uint64:
    sums, _ = _prefix(np.frombuffer(word, np.uint8)[None])
    return T.mix(sums[:, -1] + np.uint64(len(word)))[0]


def pieces(surfaces: list[bytes], log_p: np.ndarray) -> Pieces:
    hashes = np.array([_hash(s) for s in surfaces], np.uint64)
    order = np.argsort(hashes)
    maybe = np.zeros(1 << 20, bool)
    maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return Pieces(surfaces, log_p, np.unique([len(s) for s in surfaces]), hashes[order], order, maybe)


def load(path: str) -> Pieces:
    """Pieces of a sentencepiece model in the order of its scores, single bytes last, with Zipf's law as prior."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            surface = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in surface[1:]:
                found.setdefault(surface, -model.get_score(i))
    ranked = sorted(found, key=lambda s: (found[s], s))
    ranked += [bytes([b]) for b in range(256) if bytes([b]) not in found]
    p = 1 / (np.arange(len(ranked)) + ZIPF_SHIFT)
    return pieces(ranked, np.log(p / p.sum()))


def _lattice(m: np.ndarray, v: Pieces) -> dict[int, np.ndarray]:
    """For each length of pieces, the piece that starts at each place of each row of bytes, or -1."""
    sums, down = _prefix(m)
    width, out = m.shape[1], {}
    for size in v.sizes.tolist():
        if size > width:
            break
        h = T.mix((sums[:, size:] - sums[:, : width - size + 1]) * down[: width - size + 1] + np.uint64(size))
        piece = np.full(h.shape, -1, np.int32)
        at = np.nonzero(v.maybe[(h >> np.uint64(44)).astype(np.int64)])
        if len(at[0]):
            rank = np.minimum(np.searchsorted(v.hashes, h[at]), len(v.hashes) - 1)
            piece[at] = np.where(v.hashes[rank] == h[at], v.ids[rank], -1)
            if (piece >= 0).any():
                out[size] = piece
    return out


def _weights(piece: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    return np.append(log_p, _NONE)[piece]  # -1 takes the last


def _forward(lattice: dict[int, np.ndarray], log_p: np.ndarray, rows: int, width: int) -> np.ndarray:
    alpha = np.full((width + 1, rows), _NONE)
    alpha[0] = 0
    steps = {size: np.ascontiguousarray(_weights(piece, log_p).T) for size, piece in lattice.items()}
    with np.errstate(invalid="ignore"):
        for end in range(1, width + 1):
            for size, w in steps.items():
                if size <= end:
                    np.logaddexp(alpha[end], alpha[end - size] + w[end - size], out=alpha[end])
    return alpha


def _backward(lattice: dict[int, np.ndarray], log_p: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    beta = np.full((width + 1, len(lengths)), _NONE)
    beta[lengths, np.arange(len(lengths))] = 0
    steps = {size: np.ascontiguousarray(_weights(piece, log_p).T) for size, piece in lattice.items()}
    with np.errstate(invalid="ignore"):
        for start in range(width - 1, -1, -1):
            for size, w in steps.items():
                if start + size <= width:
                    np.logaddexp(beta[start], beta[start + size] + w[start], out=beta[start])
    return beta


def _groups(starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length (beyond EXACT bytes, by steps of a quarter): their indices, padded rows of bytes, and lengths."""
    width = sizes.copy()
    while (long := width > EXACT).any():
        step = np.maximum(1, 2 ** (np.floor(np.log2(width[long])) - 2).astype(np.int64))
        rounded = -(-width[long] // step) * step
        if (rounded == width[long]).all():
            break
        width[long] = rounded
    order = np.argsort(width, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(width[order])) + 1, [len(order)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        w = int(width[order[a]]) if b > a else 0
        for c in range(a, b, max(1, CELLS // max(w * w // 2, w * 8, 1))):
            some = order[c : min(b, c + max(1, CELLS // max(w * w // 2, w * 8, 1)))]
            place = np.arange(w)
            m = data[np.minimum(starts[some][:, None] + place, max(len(data) - 1, 0))]
            m[place >= sizes[some][:, None]] = 255
            yield some, m, sizes[some]


def log_marginals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, v: Pieces) -> np.ndarray:
    """Log of the sum of the probabilities of all segmentations of each word (of bytes, with a space before)."""
    out = np.zeros(len(starts))
    long = ends - starts > LONG
    for i in np.flatnonzero(long).tolist():
        out[i] = _long_word(np.append(np.uint8(32), data[starts[i] : ends[i]]), v)
    short = np.flatnonzero(~long)
    spaced, starts, sizes = _spaced(data, starts[short], ends[short])
    for some, m, lengths in _groups(starts, sizes, spaced):
        alpha = _forward(_lattice(m, v), v.log_p, len(some), m.shape[1])
        out[short[some]] = alpha[lengths, np.arange(len(some))]
    return out


def expected_uses(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, v: Pieces) -> np.ndarray:
    """Expected number of uses of each piece in the words, each word as often as it counts."""
    out = np.zeros(len(v.surfaces) + 1)
    long = ends - starts > LONG
    for i in np.flatnonzero(long).tolist():
        _long_word(np.append(np.uint8(32), data[starts[i] : ends[i]]), v, float(counts[i]), out)
    short = np.flatnonzero(~long)
    spaced, starts, sizes = _spaced(data, starts[short], ends[short])
    for some, m, lengths in _groups(starts, sizes, spaced):
        lattice, width = _lattice(m, v), m.shape[1]
        alpha = _forward(lattice, v.log_p, len(some), width)
        beta = _backward(lattice, v.log_p, lengths, width)
        total = alpha[lengths, np.arange(len(some))]
        for size, piece in lattice.items():
            hit = np.nonzero(piece >= 0)
            with np.errstate(invalid="ignore"):
                p = np.exp(alpha[hit[1], hit[0]] + v.log_p[piece[hit]] + beta[hit[1] + size, hit[0]] - total[hit[0]])
            out += np.bincount(piece[hit], np.nan_to_num(p) * counts[short[some]][hit[0]], len(out))
    return out[:-1]


def _long_word(word: np.ndarray, v: Pieces, count: float = 0.0, uses: np.ndarray | None = None) -> float:
    """Log marginal of one long word, its lattice built LONG places at a time; adds count times its uses of pieces to uses."""
    n, most = len(word), int(v.sizes[-1])

    def block(a: int) -> tuple[np.ndarray, np.ndarray]:
        places, lattice = min(LONG, n - a), _lattice(word[None, a : a + LONG + most], v)
        piece = np.full((places, len(lattice)), -1, np.int32)
        for k, found in enumerate(lattice.values()):
            some = found[0, :places]
            piece[: len(some), k] = some
        return np.array(list(lattice), np.int64), piece

    alpha = np.full(n + most + 1, _NONE)
    alpha[0] = 0
    for a in range(0, n, LONG):
        sizes, piece = block(a)
        for i, w in enumerate(_weights(piece, v.log_p), a):
            alpha[i + sizes] = np.logaddexp(alpha[i + sizes], alpha[i] + w)
    if uses is not None:
        beta = np.full(n + most + 1, _NONE)
        beta[n] = 0
        for a in reversed(range(0, n, LONG)):
            sizes, piece = block(a)
            weights = _weights(piece, v.log_p)
            for i in reversed(range(len(piece))):
                beta[a + i] = np.logaddexp.reduce(beta[a + i + sizes] + weights[i])
            at, k = np.nonzero(piece >= 0)
            p = np.exp(alpha[a + at] + weights[at, k] + beta[a + at + sizes[k]] - alpha[n])
            uses += np.bincount(piece[at, k], count * p, len(uses))
    return float(alpha[n])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of data end to end."""
    if sizes.max(initial=0) > LONG:
        return np.concatenate([data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist())])
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)]


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words end to end, a space before each; where each begins, and its length with the space."""
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 32, np.uint8)
    inner = np.ones(len(out), bool)
    inner[begin] = False
    out[inner] = _gather(data, starts, sizes - 1)
    return out, begin, sizes


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of one copy of each distinct word, the word of each token, token bounds of texts, and bytes of each token."""
    starts, ends, bounds = T.tokens(data, offsets)
    _, one, word = np.unique(T.token_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[one], ends[one], word.ravel(), bounds, ends - starts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in T.chunks(batches, "text"):
        starts, ends, word, _, _ = _distinct(data, offsets)
        if not len(starts):
            continue
        size = ends - starts
        at = np.concatenate([[0], np.cumsum(size)])
        raw = _gather(data, starts, size)
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(word, minlength=len(size)))], ["word", "n"])


def _expect(v: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(v.surfaces))
        for batch in batches:
            if batch.num_rows:
                data, offsets = T.utf8(batch.column("word"))
                total += expected_uses(data, offsets[:-1], offsets[1:], batch.column("n").to_numpy(), v)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])

    return run


def corpus_weights(df: DataFrame, v: Pieces, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, prior_uses: float = PRIOR_USES) -> Pieces:
    """Unigram weights after rounds of expectation-maximisation over all words of the table."""
    words = spread(keyed(df, id_col, text_col)).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    prior = np.exp(v.log_p) * prior_uses
    for _ in range(rounds):
        uses = prior.copy()
        for row in words.mapInArrow(_expect(v), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[row["piece"]] += row["uses"]
        v = v.weighted(np.log(uses / uses.sum()))
    return v


def _score(v: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in T.chunks(batches, "text"):
            starts, ends, word, bounds, size = _distinct(data, offsets)
            n = np.diff(bounds)
            row = np.repeat(np.arange(len(n)), n)
            log_prob = np.bincount(row, log_marginals(data, starts, ends, v)[word] if len(word) else None, len(n)).astype(float)
            n_bytes = np.bincount(row, size, len(n))
            bits = -log_prob / np.log(2) / np.maximum(n_bytes, 1)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n.astype(np.int32)), pa.array(n_bytes.astype(np.int32)), pa.array(log_prob), pa.array(bits, mask=n == 0)],
                ["doc_id", "n_words", "n_bytes", "log_prob", "bits_per_byte"],
            )

    return run


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, weights: Pieces | None = None, **fit: float) -> DataFrame:
    """(doc_id, n_words, n_bytes, log_prob, bits_per_byte): natural log of the marginal probability, and bits for a byte."""
    v = weights or corpus_weights(df, load(vocabulary), id_col, text_col, **fit)
    return spread(keyed(df, id_col, text_col)).mapInArrow(_score(v), _SCHEMA)
