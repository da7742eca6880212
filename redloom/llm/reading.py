"""Reading level of texts: sentences are classified by word and character models, documents by their sentences.

A sentence's features are its words, its words' letter groups and two measures of its length, hashed; a softmax over
bands of grades with an L2 penalty is fitted on the sentences of a bounded sample of graded documents.  A document's level
is a ridge regression on the distribution of its sentences over the bands, fitted on documents the classifier has not seen.
A word's part of the score is a sum over its own features, so each distinct word is scored once a worker.

Defined results
* null text, or text without a word: null level, no sentences.
* documents with several grades train with their mean; null grades count for nothing; no graded document at all: an error.
* exact copies get the same level; row order and partitioning change nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many graded documents are fetched for fitting.
TRAIN_DOCUMENTS = 3000
BANDS = 7
TOP_GRADE = 14
FEATURES = 1 << 14
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?]+(?=[\s\"')\]]|$)|\n+")


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % FEATURES


def word_features(word: str) -> tuple[list[int], list[float]]:
    """Hashed features of a word: itself and its letter groups of three, with their weights."""
    marked = f"<{word}>"
    groups = [marked[i : i + 3] for i in range(len(marked) - 2)] or [marked]
    return [_hash("w" + word), *(_hash("c" + g) for g in groups)], [1.0, *([1.0 / len(groups) ** 0.5] * len(groups))]


def _length_features(n_words: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(n_words // 3, 19), np.clip((letters / n_words * 3).astype(int), 8, 31)


class Words:
    """Numbers for tokens; 0 ends a sentence."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.text = [""]

    def encode(self, text: str) -> list[int]:
        out = []
        number = self.number
        for t in _TOKEN.findall(text.lower()):
            n = number.get(t)
            if n is None:
                n = self._new(t)
            out.append(n)
        return out

    def _new(self, t: str) -> int:
        if t[0] in ".!?\n":
            n = 0
        elif t[0].isdigit():
            n = self._add("#")
        else:
            n = self._add(t)
        self.number[t] = n
        return n

    def _add(self, t: str) -> int:
        if t != "#" or "#" not in self.number:
            self.number[t] = len(self.text)
            self.text.append(t)
        return self.number[t]


def sentences(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all documents without sentence ends, where each sentence begins, and its document."""
    flat = np.array([c for doc in codes for c in (*doc, 0)], np.int64)
    doc = np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes])
    word = flat > 0
    sentence = np.cumsum(~word) - (~word)
    kept, owner = flat[word], doc[word]
    number = sentence[word]
    begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(kept) else np.zeros(0, np.int64)
    return kept, begin, owner[begin]


class Model:
    def __init__(self) -> None:
        self.weight = np.zeros((FEATURES, BANDS), np.float32)
        self.words_bias = np.zeros((20, BANDS), np.float32)
        self.letters_bias = np.zeros((32, BANDS), np.float32)
        self.calibration = np.zeros(2 * BANDS + 3)
        self.constant = 0.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), BANDS), np.float32)
        for i, w in enumerate(words):
            cols, vals = word_features(w)
            out[i] = np.asarray(vals, np.float32) @ self.weight[cols]
        return out

    def bands(self, scores: np.ndarray, lengths: np.ndarray, kept: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each band for each sentence, and its number of words."""
        n = np.diff(np.r_[begin, len(kept)])
        a, b = _length_features(n, np.add.reduceat(lengths[kept], begin))
        z = np.add.reduceat(scores[kept], begin, axis=0) / np.sqrt(n)[:, None] + self.words_bias[a] + self.letters_bias[b]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), n

    def documents(self, p: np.ndarray, n: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """The distribution of each document's sentences, by words, and its spread; rows of nan without sentences."""
        total = np.bincount(owner, n, count)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.stack([np.bincount(owner, p[:, k] * n, count) / total for k in range(BANDS)], 1)
            top = p.argmax(axis=1)
            votes = np.stack([np.bincount(owner, (top == k) * n, count) / total for k in range(BANDS)], 1)
            mid = np.arange(BANDS) + 0.5
            level = p @ mid
            avg = np.bincount(owner, level * n, count) / total
            sd = np.sqrt(np.maximum(np.bincount(owner, level**2 * n, count) / total - avg**2, 0))
            size = np.log1p(total / np.bincount(owner, minlength=count))
        return np.column_stack([mean, votes, avg, sd, size])

    def level(self, features: np.ndarray) -> np.ndarray:
        return np.clip(features @ self.calibration + self.constant, 1, TOP_GRADE)


def fit(texts: list[str], grades: list[float], *, epochs: int = 8, rate: float = 0.5, penalty: float = 1e-5, seed: int = 7) -> Model:
    """A model of graded texts: three quarters fit the sentence classifier, the rest the calibration."""
    model, words = Model(), Words()
    codes = [words.encode(t) for t in texts]
    grade = np.asarray(grades, float)
    order = np.random.RandomState(seed).permutation(len(texts))
    held = np.zeros(len(texts), bool)
    held[order[: max(1, len(texts) // 4)]] = len(texts) >= 8
    kept, begin, owner = sentences(codes)
    if not len(kept):
        return model
    n = np.diff(np.r_[begin, len(kept)])
    lengths = np.array([len(w) for w in words.text])
    a, b = _length_features(n, np.add.reduceat(lengths[kept], begin))
    feats = [word_features(w) for w in words.text]
    width = np.array([len(c) for c, _ in feats])
    first = np.r_[0, np.cumsum(width)[:-1]]
    cols, vals = np.array([x for c, _ in feats for x in c]), np.array([x for _, v in feats for x in v], np.float32)
    # soft targets: a grade lies between two bands
    place = np.clip((grade - 0.5) / TOP_GRADE * BANDS - 0.5, 0, BANDS - 1)
    target = np.maximum(0, 1 - np.abs(place[:, None] - np.arange(BANDS))).astype(np.float32)
    target /= target.sum(axis=1, keepdims=True)
    train = np.flatnonzero(~held[owner])
    rng = np.random.RandomState(seed)
    square = [np.full_like(x, 1e-6) for x in (model.weight, model.words_bias, model.letters_bias)]
    for _ in range(epochs):
        rng.shuffle(train)
        for i in range(0, len(train), 512):
            s = train[i : i + 512]
            tokens = np.repeat(begin[s] - np.r_[0, np.cumsum(n[s])[:-1]], n[s]) + np.arange(n[s].sum())
            row, w = np.repeat(np.arange(len(s)), n[s]), kept[tokens]
            cnt = width[w]
            at = np.repeat(first[w] - np.r_[0, np.cumsum(cnt)[:-1]], cnt) + np.arange(cnt.sum())
            r, c = np.repeat(row, cnt), cols[at]
            v = vals[at] / np.sqrt(n[s]).astype(np.float32)[r]
            z = np.stack([np.bincount(r, v * model.weight[c, k], len(s)) for k in range(BANDS)], 1) + model.words_bias[a[s]] + model.letters_bias[b[s]]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            g = (p / p.sum(axis=1, keepdims=True) - target[owner[s]]) / len(s)
            grads = (np.stack([np.bincount(c, v * g[r, k], FEATURES) for k in range(BANDS)], 1), np.stack([np.bincount(a[s], g[:, k], 20) for k in range(BANDS)], 1), np.stack([np.bincount(b[s], g[:, k], 32) for k in range(BANDS)], 1))
            for x, d, q in zip((model.weight, model.words_bias, model.letters_bias), grads, square):
                d = d + penalty * x
                q += d * d
                x -= (rate * 0.2 * d / np.sqrt(q)).astype(np.float32)
    p, m = model.bands(model.word_scores(words.text), lengths, kept, begin)
    f = model.documents(p, m, owner, len(texts))
    use = (held if held.any() else ~held) & ~np.isnan(f).any(axis=1)
    x, y = f[use], grade[use]
    mean = x.mean(axis=0)
    xc = x - mean
    ridge = 0.02 * len(x)
    model.calibration = np.linalg.solve(xc.T @ xc + ridge * np.diag(np.r_[np.full(2 * BANDS, 1.0), 0.05, 0.3, 0.3]), xc.T @ (y - y.mean()))
    model.constant = float(y.mean() - mean @ model.calibration)
    return model


def _levels(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        scores = np.zeros((0, BANDS), np.float32)
        lengths = np.zeros(0, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            if len(words.text) > 300_000:  # a worker's table of words stays bounded
                words, scores, lengths = Words(), scores[:0], lengths[:0]
            codes = [words.encode(t or "") for t in texts]
            new = words.text[len(scores) :]
            if new:
                scores = np.concatenate([scores, model.word_scores(new)])
                lengths = np.concatenate([lengths, [len(w) for w in new]])
            kept, begin, owner = sentences(codes)
            if len(kept):
                p, n = model.bands(scores, lengths, kept, begin)
                f = model.documents(p, n, owner, len(texts))
            else:
                owner, f = begin, np.full((len(texts), 2 * BANDS + 3), np.nan)
            none = np.isnan(f).any(axis=1)
            column = lambda x: pa.array(np.where(none, 0, x).round(6), pa.float64(), mask=none)
            number = pa.array(np.bincount(owner, minlength=len(texts)), pa.int32())
            share = pa.array([None if z else x.round(6).tolist() for x, z in zip(f[:, :BANDS], none)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([keys, number, column(model.level(f)), column(f[:, 2 * BANDS + 1]), share], ["key", "n_sentences", "reading_level", "level_spread", "band_shares"])

    return run


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", limit: int = TRAIN_DOCUMENTS) -> Model:
    """Fit on at most ``limit`` graded documents, those of the smallest key hashes."""
    graded = labels.where(F.col(grade).isNotNull()).groupBy(key).agg(F.avg(grade).alias("__grade")).orderBy(F.xxhash64(key), key).limit(limit)
    rows = documents.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text")).join(F.broadcast(graded), key).select("__text", "__grade", F.xxhash64(key).alias("__h")).toPandas().sort_values(["__h", "__text"])
    if not len(rows):
        raise ValueError("no graded document to fit on")
    return fit(rows["__text"].tolist(), rows["__grade"].tolist())


def reading_levels(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, reading_level, level_spread, band_shares) of every row."""
    return documents.select(F.col(key).cast("long").alias("key"), text).mapInArrow(_levels(model), "key long, n_sentences int, reading_level double, level_spread double, band_shares array<double>")
