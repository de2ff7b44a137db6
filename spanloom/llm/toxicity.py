"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; each logistic model sees the words of the text and the
probabilities of all earlier categories. While training, these come from models fitted on the other
folds (out-of-fold), so a later model learns from probabilities as unsure as those it will meet.
Out-of-fold probabilities of the last pass also set each category's threshold.

Models are fitted on at most about TRAIN_ROWS labelled documents, chosen by a hash of their id, and are a
fixed number of weights; every document is scored on its whole text in one pass without a shuffle.

Features of a text: which of 2^BITS hashed features occur, for each word [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+
(A-Z lower-cased) the word itself and its first bytes in the lengths PREFIXES. A model has weights for
the features whose log-odds between the classes say something; the weights are these log-odds times
factors that logistic regression finds. Defined results: a null text counts as empty; an empty text gets the bias alone;
documents without labels are scored like others; labels that are null or name no document are not
trained on, of several labels of one id the largest counts; with no usable labels (or one class only)
a category has probability 0 and nothing is rejected; repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, mix, slices, small_batches, without, words_of, written

TRAIN_ROWS = 10_000
#: Occurrences that are added up at once.
CHUNK = 250_000
BITS = 20
PREFIXES = (4, 5, 6, 7)
FOLDS = 3
STEPS = 60
L2 = 0.02
#: A feature counts if it is in so many documents and its log-odds are at least so large.
LEAST_DOCS, LEAST_ODDS = 4, 1.0
#: Positive predictions may be wrong this often on out-of-fold rows.
WRONG = 0.02

#: Categories of the labels table, in the order of the chain.
CATEGORIES: tuple[tuple[str, str], ...] = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_low_quality", "toxic = 1 and quality = 0"))


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The numbers of each text's features, sorted and distinct."""
    for _, words in words_of(column, ALNUM, PREFIXES):
        text = np.repeat(np.arange(len(words.ends) - 1, dtype=np.int64), np.diff(words.ends))
        every = [(text << BITS) | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64)]
        for k, h in zip(PREFIXES, words.prefixes, strict=True):
            long = words.lengths >= k
            every.append((text[long] << BITS) | (mix(h[long] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        every = np.unique(np.concatenate(every))
        cuts = np.searchsorted(every >> BITS, np.arange(len(words.ends)))
        at = (every & ((1 << BITS) - 1)).astype(np.int32)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield at[a:z]


@dataclass
class Rows:
    """Sparse rows of zeros and ones: the features that occur, and their rows."""

    at: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, rows: Sequence[np.ndarray]) -> Rows:
        at = np.concatenate(rows) if len(rows) else np.empty(0, dtype=np.int32)
        return cls(at, cls.places([len(r) for r in rows]), len(rows))

    @staticmethod
    def places(sizes: Sequence[int]) -> np.ndarray:
        return np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) <= 1 << 16 else np.int32), np.asarray(sizes, dtype=np.int64))

    def only(self, number: np.ndarray) -> Rows:
        """The features with a number of at least 0, under it; CHUNK occurrences are looked up at once."""
        size = sum(int((number[self.at[i : i + CHUNK]] >= 0).sum()) for i in range(0, len(self.at), CHUNK))
        out, to = Rows(np.empty(size, dtype=np.int32), np.empty(size, dtype=self.row.dtype), self.n), 0
        for i in range(0, len(self.at), CHUNK):
            at = number[self.at[i : i + CHUNK]]
            inside = at >= 0
            was, to = to, to + int(inside.sum())
            out.at[was:to], out.row[was:to] = at[inside], self.row[i : i + CHUNK][inside]
        return out

    def _sums(self, by: np.ndarray, of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        for i in range(0, len(by), CHUNK):
            out += np.bincount(by[i : i + CHUNK], weights=values[of[i : i + CHUNK]], minlength=n)
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.row, self.at, w, self.n)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return self._sums(self.at, self.row, g, n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, more: np.ndarray, y: np.ndarray, use: np.ndarray, n: int = 1 << BITS) -> np.ndarray:
    """Weights of the n features, of the columns of ``more`` and the bias, by Adagrad over all rows in use; classes weigh alike."""
    k = more.shape[1]
    w = np.zeros(n + k + 1)
    if not use.any() or y[use].min() == y[use].max():
        w[-1] = -40.0
        return w
    # counts of documents, which are whole numbers
    yes, no = (rows.back((v * use).astype(float), n).astype(np.int32) for v in (y, 1 - y))
    which = np.flatnonzero(yes + no >= LEAST_DOCS)
    odds = np.log((yes[which] + 1) / (y[use].sum() + 2)) - np.log((no[which] + 1) / ((1 - y[use]).sum() + 2))
    del yes, no
    which, odds = which[np.abs(odds) >= LEAST_ODDS], odds[np.abs(odds) >= LEAST_ODDS]
    number = np.full(n, -1, dtype=np.int32)
    number[which] = np.arange(len(which), dtype=np.int32)
    few = rows.only(number)
    del number
    weight = np.where(y == 1, 0.5 / y[use].mean(), 0.5 / (1 - y[use].mean())) * use / use.sum()
    m = len(which)
    v = np.zeros(m + k + 1)
    seen = np.full(m + k + 1, 1e-12)
    for _ in range(STEPS):
        p = sigmoid(few.dot(odds * v[:m]) + more @ v[m:-1] + v[-1])
        g = (p - y) * weight
        grad = np.r_[odds * few.back(g, m), more.T @ g, g.sum()]
        grad[:-1] += L2 * v[:-1] / max(m, 1)
        seen += grad * grad
        v -= 0.2 * grad / np.sqrt(seen)
    w[which] = odds * v[:m]
    w[n:] = v[m:]
    return w


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 among those at which at most WRONG of what is above is not positive."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    n = np.arange(1, len(y) + 1)
    last = np.r_[p[order][1:] != p[order][:-1], True]
    good = last & ((n - hit) <= WRONG * n)
    f1 = np.where(good, 2 * hit / (n + y.sum()), -1)
    k = int(np.argmax(f1))
    if f1[k] < 0:
        return 2.0
    below = p[order][k + 1] if k + 1 < len(y) else p[order][k]
    return float((p[order][k] + below) / 2)


def numbers(which: np.ndarray) -> np.ndarray:
    """Of each of the 2^BITS features its place in ``which``, or -1."""
    out = np.full(1 << BITS, -1, dtype=np.int32)
    out[which] = np.arange(len(which), dtype=np.int32)
    return out


@dataclass
class Chain:
    """Models; each of ``short`` has weights for the features ``which``, then for the probabilities of earlier categories, and the bias."""

    names: list[str]
    short: list[np.ndarray]
    thresholds: list[float]
    which: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        """The models with weights for all 2^BITS features."""
        out = []
        for w in self.short:
            every = np.zeros(1 << BITS)
            every[self.which] = w[: len(self.which)]
            out.append(np.r_[every, w[len(self.which) :]])
        return out

    def scores(self, rows: Rows) -> np.ndarray:
        n = len(self.which)
        rows = rows.only(numbers(self.which))
        p = np.zeros((rows.n, 0))
        for w in self.short:
            p = np.c_[p, sigmoid(rows.dot(w[:n]) + p @ w[n:-1] + w[-1])]
        return p


def frequent(rows: Sequence[np.ndarray]) -> tuple[Rows, np.ndarray]:
    """The rows with the features of at least LEAST_DOCS documents, which are numbered, and these features: others have no weight in any model."""
    docs = np.zeros(1 << BITS, dtype=np.int32)
    for at in rows:
        docs[at] += 1  # they are distinct in a row
    which = np.flatnonzero(docs >= LEAST_DOCS).astype(np.int32)
    number, sizes, to = numbers(which), np.zeros(len(rows), dtype=np.int64), 0
    every = np.empty(int(docs[which].sum()), dtype=np.int32)
    for i, at in enumerate(rows):
        at = number[at]
        at = at[at >= 0]
        every[to : to + len(at)] = at
        sizes[i], to = len(at), to + len(at)
    return Rows(every, Rows.places(sizes), len(rows)), which


def train(rows: Sequence[np.ndarray], labels: np.ndarray, names: Sequence[str], fold: np.ndarray) -> Chain:
    """labels: a row for each document, a column for each category; fold: the fold of each document."""
    return trained(*frequent(rows), labels, names, fold)


def trained(x: Rows, which: np.ndarray, labels: np.ndarray, names: Sequence[str], fold: np.ndarray) -> Chain:
    n = len(which)
    before = np.zeros((x.n, 0))
    weights, thresholds = [], []
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        out = np.zeros(x.n)
        for f in range(FOLDS):
            w = fit(x, before, y, fold != f, n)
            out[fold == f] = sigmoid(x.dot(w[:n]) + before @ w[n:-1] + w[-1])[fold == f]
        weights.append(fit(x, before, y, np.ones(x.n, dtype=bool), n))
        thresholds.append(threshold(out, y))
        before = np.c_[before, out]
    return Chain(list(names), weights, thresholds, which)


def fit_chain(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories: Sequence[tuple[str, str | Column]] = CATEGORIES, train_rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most about ``train_rows`` labelled documents, chosen by a hash of their ids."""
    small_batches(docs.sparkSession)
    named = [F.coalesce((F.expr(c) if isinstance(c, str) else c).cast("int"), F.lit(0)).alias(f"y{i}") for i, (_, c) in enumerate(categories)]
    rows = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), *named).groupBy("label_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    known = docs.select(F.col(id_col).alias("label_id")).distinct()
    rows = written(rows.join(known, "label_id", "left_semi"), "tox-labels")
    every = -(-rows.count() // train_rows) or 1
    rows = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(every)) == 0)
    text = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(rows), "label_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data = [x.tobytes() for x in features(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(data, pa.binary())], names=["label_id", *b.schema.names[2:], "data"])

    kind = T.StructType([text.schema["label_id"], *[T.StructField(f"y{i}", T.IntegerType()) for i in range(len(categories))], T.StructField("data", T.BinaryType())])
    # an id may repeat: one of its texts is enough
    got = text.mapInArrow(run, kind).groupBy("label_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))], F.max("data").alias("data")).withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit(3)), F.lit(FOLDS))).orderBy("label_id").toArrow()
    # views of Arrow's buffers: only features with weights are copied
    sets = [np.frombuffer(d.as_buffer(), np.int32) for d in got.column("data")]
    y = np.stack([got.column(f"y{i}").to_numpy() for i in range(len(categories))], axis=1) if len(sets) else np.zeros((0, len(categories)))
    fold = got.column("fold").to_numpy().copy()
    x, which = frequent(sets)
    del sets, got
    pa.default_memory_pool().release_unused()
    return trained(x, which, y, [n for n, _ in categories], fold)


def scored(docs: DataFrame, chain: Chain, *, text_col: str = "text", name: str = "tox_") -> DataFrame:
    """docs without the text, with an array of the categories' probabilities in the order of the chain."""
    at = docs.columns.index(text_col)
    kind = T.StructType([*[f for f in docs.schema.fields if f.name != text_col], T.StructField(name, T.ArrayType(T.DoubleType()))])
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most 2^BITS weights for each category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = model.value.scores(Rows.of(list(features(b.column(at)))))
            rest = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(list(p), pa.list_(pa.float64()))], names=kind.names)

    return docs.mapInArrow(run, kind)


def judged(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, reject: Sequence[str] = ("toxic",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, p_<category> for each, labels (categories above their threshold), toxic (rejected)."""
    chain = fit_chain(docs, labels, id_col=id_col, text_col=text_col, categories=categories, train_rows=train_rows)
    s = scored(docs.select(F.col(id_col), F.col(text_col)), chain, text_col=text_col)
    above = [F.when(F.col("tox_")[i] >= t, F.lit(n)) for i, (n, t) in enumerate(zip(chain.names, chain.thresholds, strict=True))]
    bad = [F.col("tox_")[i] >= t for i, (n, t) in enumerate(zip(chain.names, chain.thresholds, strict=True)) if n in reject]
    toxic = bad[0]
    for x in bad[1:]:
        toxic = toxic | x
    return s.select(id_col, *[F.col("tox_")[i].alias(f"p_{n}") for i, n in enumerate(chain.names)], F.concat_ws(",", *above).alias("categories"), toxic.alias("toxic"))


def not_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, reject: Sequence[str] = ("toxic",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    chain = fit_chain(docs, labels, id_col=id_col, text_col=text_col, categories=categories, train_rows=train_rows)
    s = scored(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")), chain)
    bad = F.lit(False)
    for i, (n, t) in enumerate(zip(chain.names, chain.thresholds, strict=True)):
        if n in reject:
            bad = bad | (F.col("tox_")[i] >= t)
    return without(docs, s.where(bad).select("id", "row"), id_col, text_col)
