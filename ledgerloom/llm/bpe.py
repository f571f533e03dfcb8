"""Operator 1: byte-pair encoding and decoding by a prefix-sharing trie.

Texts are split by the tokenizer's pattern; the distinct words of a chunk, in byte order, are their trie in depth-first
order. Each node of the trie has one state, the last token of the encoding of its prefix: the one token that ends there
and that byte-pair merging wouldn't join or split across its border with the state before it. States of a shared prefix
are computed once and stay on the stack; a word's encoding is read off its states from the end. Whether two tokens can
stand side by side is decided by undoing their merges around the border, and remembered.

The vocabulary file (lines of base64 token and rank, ranks being ids) is a parameter and is read on the driver only.

Results for edge cases: a null text has null tokens, null counts and null lossless; an empty text has no token and is
lossless. Rows without an id are left out; rows that share an id or text are encoded one by one. Bytes that aren't UTF-8
are encoded as they are. Ids out of range are refused by decode with an error. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import text as T
from ledgerloom.llm.common import keyed, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS, CACHE_PAIRS = 300_000, 2_000_000
_SCHEMA = "doc_id long, tokens array<int>, n_tokens int, n_bytes int, lossless boolean"


class Vocabulary:
    """Tokens by id, and for each the two tokens whose merge made it (a single byte: itself)."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN) -> None:
        self.tokens, self.pattern = tokens, pattern
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.whole = [True] * len(tokens)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                pair = self._merge(t, i)
                self.whole[i] = len(pair) == 2
                if self.whole[i]:
                    self.left[i], self.right[i] = pair
        self.pairs = {(self.left[i], self.right[i]): i for i, t in enumerate(tokens) if len(t) > 1 and self.whole[i]}

    def _merge(self, word: bytes, below: int) -> list[int]:
        """Plain byte-pair merging with the tokens of rank under `below` only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]


@lru_cache(maxsize=4)
def load(path: str, pattern: str = PATTERN) -> Vocabulary:
    by_rank = {int(r): base64.b64decode(t) for t, r in map(str.split, Path(path).read_text().splitlines())}
    if sorted(by_rank) != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return Vocabulary([by_rank[i] for i in range(len(by_rank))], pattern)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ending = {t[k:]: -1 for t in vocabulary.tokens for k in range(1, len(t))}  # what a token can end in; its id, if a token
        self.ending |= {t: i for t, i in vocabulary.ranks.items() if vocabulary.whole[i]}
        self.beside: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.find = regex.compile(vocabulary.pattern).findall

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b in place."""
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= CACHE_PAIRS:
                self.beside.clear()
            known = self.beside[key] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        left, right, pairs, limit = self.v.left, self.v.right, self.v.pairs, 1 << 62
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Encodings of distinct words in byte order: one depth-first walk of their trie."""
        out, last, lengths, before = [], [0], [0], b""
        get, fits, size = self.ending.get, self.fits, len
        for word in words:
            n = size(word)
            shared, most = 0, min(n, size(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], lengths[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(end - 1, -1, -1):
                    token = get(word[start:end])
                    if token is None:
                        raise ValueError(f"the vocabulary can't encode byte {word[end - 1]}")
                    if token >= 0 and (not start or fits(last[start], token)):
                        last.append(token)
                        lengths.append(end - start)
                        break
            ids, end = [], n
            while end:
                ids.append(last[end])
                end -= lengths[end]
            out.append(ids[::-1])
            before = word
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and their n + 1 offsets."""
        index: dict[str, int] = {}
        codes: list[int] = []
        words_in = [0]
        for text in texts:
            codes += [index.setdefault(w, len(index)) for w in self.find(text)]
            words_in.append(len(codes))
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = sorted((w.encode("utf-8", "surrogateescape"), w) for w in index if w not in self.known)
        self.known.update(zip((w for _, w in fresh), self.encode([b for b, _ in fresh])))
        encoded = [self.known[w] for w in index]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(size.sum()))
        code = np.array(codes, np.int64)
        ends = np.concatenate([[0], np.cumsum(size[code])])
        return flat[_ranges((np.cumsum(size) - size)[code], size[code])], ends[words_in]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Decoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.size = np.array([len(t) for t in vocabulary.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets."""
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < len(self.size):
            raise ValueError("an id isn't in the vocabulary")
        size = self.size[ids]
        return self.bytes[_ranges(self.start[ids], size)], np.concatenate([[0], np.cumsum(size)])[offsets]


_WORKER: dict[bytes, tuple[Encoder, Decoder]] = {}


def _tools(key: bytes, tokens: list[bytes], pattern: str, left: list[int], right: list[int], whole: list[bool]) -> tuple[Encoder, Decoder]:
    """Of a vocabulary, known by a digest of all its tokens, merges and pattern; a worker keeps four at most."""
    if key not in _WORKER:
        if len(_WORKER) >= 4:
            _WORKER.clear()
        v = Vocabulary.__new__(Vocabulary)
        v.tokens, v.pattern, v.left, v.right, v.whole = tokens, pattern, left, right, whole
        v.ranks = {t: i for i, t in enumerate(tokens)}
        v.pairs = {(left[i], right[i]): i for i, t in enumerate(tokens) if len(t) > 1 and whole[i]}
        _WORKER[key] = Encoder(v), Decoder(v)
    return _WORKER[key]


def _encode(*vocabulary: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = _tools(*vocabulary)
        for rows, data, offsets in T.chunks(batches, "text"):
            raw = data.tobytes()
            ids, at = encode([raw[a:b].decode("utf-8", "surrogateescape") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])
            back, ends = decode(ids, at)
            if len(back) == len(data):
                wrong = np.concatenate([[0], np.cumsum(back != data)])
                same = (ends == offsets)[:-1] & (ends == offsets)[1:] & (wrong[offsets[1:]] == wrong[offsets[:-1]])
            else:
                same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:])])
            null = rows.column("text").is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
            number = lambda x: pa.array(x.astype(np.int32), mask=null)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), lists, number(np.diff(at)), number(np.diff(offsets)), pa.array(same, mask=null)], ["doc_id", "tokens", "n_tokens", "n_bytes", "lossless"])

    return run


def _decode(*vocabulary: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = _tools(*vocabulary)
        for batch in batches:
            column = batch.column("tokens")
            filled = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            data, at = decode(filled.flatten().to_numpy(zero_copy_only=False), filled.offsets.to_numpy())
            raw = data.tobytes()
            texts = [None if none else raw[a:b].decode("utf-8", "replace") for none, a, b in zip(column.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _shipped(path: str, pattern: str) -> tuple:
    v = load(path, pattern)
    whole = v.tokens, v.pattern, v.left, v.right, v.whole
    return hashlib.sha256(repr(whole).encode()).digest(), *whole


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, tokens, n_tokens, n_bytes, lossless) for every row; lossless: decoding the tokens gives the text's bytes."""
    return spread(keyed(df, id_col, text_col)).mapInArrow(_encode(*_shipped(vocabulary, pattern)), _SCHEMA)


def decode(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) from a column of ids; null stays null, and bytes that don't make UTF-8 become U+FFFD."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{tokens_col}`").alias("tokens")).where("doc_id is not null")
    return rows.mapInArrow(_decode(*_shipped(vocabulary, pattern)), "doc_id long, text string")
