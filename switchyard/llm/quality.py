"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

Tokens are runs of letters, of digits or of marks.  Each has a sparse ternary
index vector derived from its hash; its word vector is that plus the
(normalised) sum of the index vectors seen within two places of it in the
training sample.  Tokens outside the sample's vocabulary share the vector of
their shape (case, length).  A document is pooled in two ways: the mean of its
tokens' word vectors, and, for each distance of one to four places, the mean of
what binds two tokens that far apart, the product of their index vectors place
by place.  Products carry the order of words, and as vectors are ternary, a
text that goes in circles pools to positive ones.  A two-layer numpy network
scores the pooled vectors and nothing else.

A temperature set on a fifth of the sample calibrates the probability.  Its
targets are smoothed by the number of tuning rows, (n + 1) / (n + 2) for a class
of n, so a separable sample gives a finite temperature.

The fit uses a bounded, class-balanced sample (``per_class``, ``total`` rows,
``max_chars`` characters a class), reweighted to the true class shares; of its
words the ``max_vocab`` most frequent seen ``min_count`` times have vectors of
their own.  Scoring covers every whole text.  Means are linear, so the first
layer is folded into the word rows, which are cached per word.

Defined results: null and empty texts pool to the zero vector; without labelled
rows of both classes every score is the share of label 1 (0 if none); an id with
several labels takes the least; repeated rows score alike; words of equal count
enter the vocabulary by code point, rows of equal hash the sample by doc_id; an empty table gives
an empty result; extra columns, whatever their names, are never read and
``keep_good`` passes them through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C
from switchyard.llm.subword import WordRows

THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
LAGS = (1, 2, 3, 4)
#: Tokens of a text that are pooled at a time.
PIECE = 8192


def shape(token: str) -> str:
    if token.isalpha():
        case = "lower" if token.islower() else "upper" if token.isupper() else "title" if token.istitle() else "mixed"
        return f"<{case} {min(len(token) // 3, 6)}>"
    return f"<digits {min(len(token), 9)}>" if token.isdigit() else f"<marks {token[0]} {min(len(token), 4)}>"


def index_places(tokens: list[str], dim: int, nonzero: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Where each token's index vector is not zero, and its signs there: a pure function of the token."""
    at, sign = np.zeros((len(tokens), nonzero), np.int64), np.zeros((len(tokens), nonzero), np.float32)
    for k, t in enumerate(tokens):
        h = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        for j in range(nonzero):
            h = zlib.crc32(h.to_bytes(4, "little"), j)
            at[k, j], sign[k, j] = h % dim, 1.0 if h >> 31 else -1.0
    return at, sign


def index_vectors(tokens: list[str], dim: int) -> np.ndarray:
    """Sparse ternary vectors (a place drawn twice adds up)."""
    at, sign = index_places(tokens, dim)
    out = np.zeros((len(tokens), dim), np.float32)
    np.add.at(out, (np.arange(len(tokens))[:, None], at), sign)
    return out


@dataclass
class QualityModel:
    dim: int = 64
    hidden: int = 16
    max_vocab: int = 20_000
    min_count: int = 5
    epochs: int = 60
    seed: int = 5
    temperature: float = 1.0
    prior: float | None = None
    vocab: dict = field(default_factory=dict, repr=False)
    vectors: np.ndarray | None = field(default=None, repr=False)
    w1: np.ndarray | None = field(default=None, repr=False)
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0

    # ---- word vectors
    def index_words(self, texts: list[str]) -> None:
        counts, spelled, texts_of = Counter(), {}, []
        for t in texts:
            texts_of.append(np.array([spelled.setdefault(w, len(spelled)) for w in TOKEN.findall(t)], np.int32))
        total = np.bincount(np.concatenate([np.zeros(0, np.int64), *texts_of]), minlength=len(spelled))
        counts = dict(zip(spelled, total.tolist(), strict=True))
        known = sorted((w for w, n in counts.items() if n >= self.min_count), key=lambda w: (-counts[w], w))[: self.max_vocab]
        names = [*known, *sorted({shape(w) for w in counts})]
        self.vocab = {w: i for i, w in enumerate(names)}
        row_of = np.array([self.vocab.get(w, -1) if w in self.vocab else self.vocab[shape(w)] for w in spelled], np.int64)
        at, sign = index_places(names, self.dim)
        context, held, size = np.zeros(len(names) * self.dim), [], 0

        def add() -> None:
            here, there = map(np.concatenate, zip(*held, strict=True))
            for j in range(at.shape[1]):
                context[:] += np.bincount(here * self.dim + at[there, j], sign[there, j], len(context))

        for spelt in texts_of:
            ids = row_of[spelt]
            for k in (1, 2):
                held += [(ids[:-k], ids[k:]), (ids[k:], ids[:-k])]
            size += 4 * len(ids)
            if size > 400_000:
                add()
                held, size = [], 0
        if held:
            add()
        context = context.reshape(-1, self.dim)
        index = index_vectors(names, self.dim)
        norm = np.linalg.norm(context, axis=1, keepdims=True)
        own = np.linalg.norm(index, axis=1, keepdims=True)
        self.vectors = (index + context / np.maximum(norm, 1e-9) * np.maximum(own, 1)).astype(np.float32)

    def word_vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.dim), np.float32)
        unknown = []
        for k, w in enumerate(words):
            i = self.vocab.get(w)
            if i is None:
                i = self.vocab.get(shape(w))
            if i is None:
                unknown.append(k)
            else:
                out[k] = self.vectors[i]
        if unknown:
            out[unknown] = index_vectors([shape(words[k]) for k in unknown], self.dim)
        return out

    # ---- documents
    def pool(self, text: str | None, cache: WordRows) -> np.ndarray:
        """The mean of the rows of a text's tokens, then of the products of index vectors by distance.

        A cached row is a token's (folded) word vector, then its index vector.
        """
        words = TOKEN.findall(text) if text else []
        if not words:
            return np.zeros(self.wide + len(LAGS) * self.dim)
        cache.load(set(words))
        ids = np.fromiter(map(cache.ids.__getitem__, words), np.int32, len(words))
        out = np.zeros(self.wide + len(LAGS) * self.dim)
        for lo in range(0, len(ids), PIECE):  # pieces overlap by the longest distance
            rows = cache.table[ids[lo : lo + PIECE + LAGS[-1]]]
            out[: self.wide] += rows[:PIECE, : self.wide].sum(0, dtype=np.float64)
            index = rows[:, self.wide :]
            for j, k in enumerate(LAGS):
                n = min(len(index) - k, PIECE)
                if n > 0:
                    out[self.wide + j * self.dim : self.wide + (j + 1) * self.dim] += np.einsum("ij,ij->j", index[:n], index[k : k + n])
        return out / len(words)

    @property
    def wide(self) -> int:
        """Width of a cached word vector: folded once there is a network."""
        return self.dim if self.w1 is None else self.hidden

    def index_rows(self, words: list[str]) -> np.ndarray:
        """A row a token: its word vector, folded if there is a network, and its index vector."""
        vectors = self.word_vectors(words)
        return np.hstack([vectors if self.w1 is None else (vectors @ self.w1[: self.dim]).astype(np.float32), index_vectors(words, self.dim)])

    def document_vectors(self, texts) -> np.ndarray:
        cache = WordRows(self.index_rows, 50_000)
        return np.array([self.pool(t, cache) for t in texts])

    # ---- network
    def fit(self, texts: list[str], y: np.ndarray, weights: np.ndarray) -> QualityModel:
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(texts))
        cut = max(1, len(texts) // 5)
        tune, train = order[:cut], order[cut:]
        self.index_words([texts[i] for i in train])
        x = self.document_vectors(texts)
        mean, dev = x[train].mean(0), x[train].std(0) + 1e-3
        x = (x - mean) / dev
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / np.sqrt(self.hidden), self.hidden), np.zeros(1)]
        m, v, step = [0 * a for a in p], [0 * a for a in p], 0
        for _ in range(self.epochs):
            rng.shuffle(train)
            for lo in range(0, len(train), 64):
                b = train[lo : lo + 64]
                h = np.maximum(x[b] @ p[0] + p[1], 0)
                err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[b]) * weights[b] / len(b)
                dh = err[:, None] * p[2] * (h > 0)
                grads = [x[b].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ err + 1e-4 * p[2], np.array([err.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.calibrate(np.maximum(x[tune] @ p[0] + p[1], 0) @ p[2] + p[3], y[tune], weights[tune])
        self.w1, self.b1 = p[0] / dev[:, None], p[1] - (mean / dev) @ p[0]
        self.w2, self.b2 = p[2], float(p[3][0])
        return self

    def calibrate(self, z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> None:
        """The temperature with the least weighted log loss against smoothed targets."""
        n1 = int(y.sum())
        goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        self.temperature = float(min(grid, key=lambda t: np.average(goal * np.logaddexp(0, -z / t) + (1 - goal) * np.logaddexp(0, z / t), weights=weights)))

    def scores(self, texts, cache: WordRows | None) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        x = np.array([self.pool(t, cache) for t in texts]).reshape(len(texts), -1)
        h = x[:, : self.hidden] + x[:, self.hidden :] @ self.w1[self.dim :] + self.b1
        z = np.maximum(h, 0) @ self.w2 + self.b2
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, per_class: int = 4000, total: int = 8000, max_chars: int = 20_000_000, **model) -> QualityModel:
    """Fit on labelled documents outside the held-out fold."""
    labelled = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~C.fold(F.col("doc_id"), parts, held))
    labelled = labelled.groupBy("doc_id").agg(F.min("y").alias("y")).join(docs.select("doc_id"), "doc_id", "left_semi")
    texts, classes, y, weights = C.training_set(docs, labelled, per_class, total, max_chars)
    if len(classes) < 2:
        return QualityModel(prior=float(classes[0]) if classes else 0.0)
    fitted = QualityModel(**model).fit(texts, y, weights)
    del texts
    C.give_back()
    return fitted


def scorer(spark: SparkSession, model: QualityModel):
    """An iterator pandas UDF: text -> probability of label 1."""
    shared = spark.sparkContext.broadcast(model)  # at most max_vocab x dim floats

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        cache = WordRows(m.index_rows, 100_000) if m.prior is None else None
        for texts in batches:
            yield pd.Series(m.scores(texts, cache), dtype="float64")
        del cache
        C.give_back()  # the worker lives on

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **fit_args) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; columns unchanged."""
    score = scorer(docs.sparkSession, fit(docs, labels, **fit_args))
    return docs.where(score(F.col("text")) >= threshold)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    score = scorer(spark, fit(docs, C.table(spark, sf_dir, "labels")))
    return docs.select("doc_id", C.fold(F.col("doc_id"), 4, 2).alias("held_out"), score("text").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
