"""Toxicity by non-negative positive-unlabelled learning with a linear numpy classifier.

Positives are confirmed toxic documents; the unlabelled set is all training documents of any kind. With the
class prior p the risk of a classifier f is ``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` with logistic
loss l; where the second part falls below zero, a step back is taken instead (non-negative correction), so
the classifier can't gain by fitting the few positives perfectly.

Features are the presence of words and of their first 3 to 8 bytes. At most ``max_positive`` confirmed
documents, chosen by a hash of their id, tell which features there can be; all training documents tell how
common these are, and the unlabelled part of the risk is summed over all of them: documents with the same
features are one pattern with a count. Each step of the fit needs one sum over the patterns, which is taken
on the driver where there are at most ``LOCAL`` of them, by a Spark job otherwise; the sums are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as tx
from .lm import Lookup
from .shared import cut

PREFIXES = (3, 4, 5, 6, 7, 8)
#: Patterns that the driver sums over itself.
LOCAL = 50_000
#: Steps of the fit, and their size.
STEPS, RATE = 300, 0.1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of a chunk, and the document of each."""
    data = tx.LOWER[data]
    s, e, first = tx.words(data, offsets, tx.NOT_ALNUM)
    run = tx.running(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hs, ds = [tx.spans(run, s, e)], [doc]
    for n in PREFIXES:
        long = np.flatnonzero(e - s >= n)
        hs.append(tx.spans(run, s[long], s[long] + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        ds.append(doc[long])
    return np.concatenate(hs), np.concatenate(ds)


def _frequent(texts: DataFrame, support: int, most: int) -> DataFrame:
    """(h, pos): in how many of ``texts(text)`` a feature is; the ``most`` commonest of those in at least ``support``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in tx.chunks(b.column(0), 1 << 23):
                h, d = features(data, offsets)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                own, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("pos")).where(F.col("pos") >= support).orderBy(F.desc("pos"), "h").limit(most)


def _common(texts: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many of ``texts(text)`` each of the features ``keys`` is; a task sums over all its documents first."""
    shared = texts.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value)
        total = np.zeros(len(look.keys), np.int64)
        for b in batches:
            for _, _, data, offsets in tx.chunks(b.column(0)):
                total += np.bincount(_hits(look, data, offsets)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    rows = texts.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _hits(look: Lookup, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct chosen features of each document: (feature, document), by document."""
    h, d = features(data, offsets)
    at = look.find(h)
    hit = at >= 0
    both = np.unique(d[hit] * np.int64(max(1, len(look.keys))) + at[hit])
    return both % max(1, len(look.keys)), both // max(1, len(look.keys))


def _patterns(texts: DataFrame, keys: np.ndarray) -> DataFrame:
    """(has, n): which of the chosen features documents of ``texts(text)`` have together, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(keys)
        for b in batches:
            for lo, hi, data, offsets in tx.chunks(b.column(0)):
                at, doc = _hits(look, data, offsets)
                spot = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(spot), pa.array(at.astype(np.int32)))], names=["has"])

    return texts.mapInArrow(run, "has array<int>").groupBy("has").agg(F.count("*").alias("n"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Patterns:
    """Rows of features with counts: flat feature numbers, the row of each, and how often a row occurs."""

    def __init__(self, has: list, n: np.ndarray):
        sizes = np.array([len(x) for x in has], np.int64)
        self.flat = np.concatenate([np.asarray(x, np.int64) for x in has]) if len(has) else np.zeros(0, np.int64)
        self.row, self.n = np.repeat(np.arange(len(has)), sizes), np.asarray(n, float)

    def z(self, w: np.ndarray) -> np.ndarray:
        """Each row's value; the last weight is the bias."""
        return np.bincount(self.row, weights=w[self.flat], minlength=len(self.n)) + w[-1]

    def pull(self, c: np.ndarray, k: int) -> np.ndarray:
        """Sums of the rows' ``c`` by feature, and over all."""
        return np.append(np.bincount(self.flat, weights=c[self.row], minlength=k), c.sum())

    def negative(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss of calling every row negative, and its slope."""
        z = self.z(w)
        return float((self.n * np.logaddexp(0, z)).sum()), self.pull(self.n * sigmoid(z), len(w) - 1)


class Spread:
    """The same sums over patterns that stay in a table."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _each(self, w: np.ndarray, schema: str, of) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield of(Patterns(b.column(0).to_pylist(), b.column(1).to_numpy()), w)

        return self.table.select("has", "n").mapInArrow(run, schema)

    def negative(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        def sums(p: Patterns, w: np.ndarray) -> pa.RecordBatch:
            loss, slope = p.negative(w)
            both = np.append(slope, loss)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["i", "x"])

        rows = self._each(w, "i long, x double", sums).groupBy("i").agg(F.sum("x")).orderBy("i").collect()
        total = np.array([r[1] for r in rows]) if rows else np.zeros(len(w) + 1)
        return float(total[-1]), total[:-1]

    def values(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of the rows, to six digits, and how often each occurs."""

        def rounded(p: Patterns, w: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.round(p.z(w), 6)), pa.array(p.n)], names=["z", "n"])

        rows = self._each(w, "z double, n double", rounded).groupBy(F.round("z", 3).alias("z")).agg(F.sum("n").alias("n")).toPandas()
        return rows["z"].to_numpy(), rows["n"].to_numpy()


def fit(positive: Patterns, unlabelled: Patterns | Spread, total: float, k: int, prior: float, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights (kept non-negative: features were chosen as signs of toxicity) and bias, by Adam on the
    non-negative risk of all positive and all ``total`` unlabelled documents."""
    w = np.zeros(k + 1)
    w[-1] = -2.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    n = positive.n / positive.n.sum()
    for t in range(1, steps + 1):
        zp = positive.z(w)
        loss, slope = unlabelled.negative(w)
        # Logistic loss: its slope at z is sigmoid(z) - 1 for a positive and sigmoid(z) for a negative.
        rest = loss / total - prior * (n * np.logaddexp(0, zp)).sum()
        back = slope / total - prior * positive.pull(n * sigmoid(zp), k)
        g = prior * positive.pull(n * (sigmoid(zp) - 1), k) + back if rest >= 0 else -back
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:k] = np.maximum(w[:k], 0)
    return w


def shift(z_pos: np.ndarray, n_pos: np.ndarray, z_unl: np.ndarray, n_unl: np.ndarray, prior: float) -> float:
    """The threshold with the least non-negative risk of the 0-1 loss; the middle of the widest range of ties."""
    cuts = np.unique(np.concatenate([z_pos, z_unl]))
    middle = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])

    def above(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        order = np.argsort(z)
        below = np.concatenate([[0.0], np.cumsum(n[order])])
        return 1 - below[np.searchsorted(z[order], middle)] / below[-1]

    hit, taken = above(z_pos, n_pos), above(z_unl, n_unl)
    risk = prior * (1 - hit) + np.maximum(0, taken - prior * hit)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    gap = np.concatenate([[0], cuts[1:] - cuts[:-1], [0]])
    return float(middle[best[gap[best].argmax()]])


class Model:
    """Chosen features, their weights and the bias; without features every score is ``sigmoid(bias)``."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias


def learn(docs: DataFrame, labels: DataFrame, train: Column, prior: float | None = None, max_positive: int = 4000, support: int = 3, ratio: float = 20.0, vocabulary: int = 1 << 17, most: int = 1024) -> Model:
    """Fit on rows of ``docs(doc_id, text)`` for which ``train`` holds and ``labels(doc_id, toxic)`` confirms or not.

    At most ``max_positive`` confirmed documents are used; all rows for which ``train`` holds are unlabelled
    ones, also those without a text. A feature is in at least ``support`` confirmed documents, among the
    ``vocabulary`` commonest of them, and ``ratio`` times as frequent there as elsewhere; the model has room
    for the ``most`` best. ``prior`` defaults to the share of toxic among the labelled training rows. Several
    labels of a document count as toxic if one is. Null labels tell nothing, rows without a doc_id are not
    learned from. Without any confirmed example nothing is toxic: bias -30.
    """
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    own = labels.where(train & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    if prior is None:
        prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    if not prior:
        return nothing
    # At most max_positive ids: the broadcast is bounded by the parameter.
    some = own.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).select("doc_id")
    text = F.col("text").cast("string").alias("text")
    confirmed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(F.broadcast(some), "doc_id").select("text"), "confirmed")
    found = _frequent(confirmed, support, vocabulary).toPandas()
    n_pos = confirmed.count()
    if not n_pos or not len(found):
        return nothing
    texts = docs.where(train & F.col("doc_id").isNotNull()).select(text)
    total = texts.count()
    keys = found["h"].to_numpy(np.int64).view(np.uint64)
    # Features whose share among the positives is many times that among the negatives, as the prior tells it.
    p, u = found["pos"].to_numpy(float) / n_pos, _common(texts, keys) / total
    times = p / (np.maximum(u - prior * p, 0.0) / (1 - min(prior, 0.99)) + 1.0 / total)
    fine = np.flatnonzero(times >= ratio)
    keys = keys[fine[np.lexsort((keys[fine], -p[fine] * np.log(times[fine])))][:most]]
    if not len(keys):
        return nothing
    rows = _patterns(confirmed, keys).toPandas()
    positive = Patterns(rows["has"].tolist(), rows["n"].to_numpy())
    table = cut(_patterns(texts, keys), "patterns")
    if table.limit(LOCAL + 1).count() <= LOCAL:
        rows = table.toPandas()
        unlabelled: Patterns | Spread = Patterns(rows["has"].tolist(), rows["n"].to_numpy())
    else:
        unlabelled = Spread(table)
    w = fit(positive, unlabelled, total, len(keys), prior)
    w[-1] = 0.0
    z, n = (unlabelled.z(w), unlabelled.n) if isinstance(unlabelled, Patterns) else unlabelled.values(w)
    return Model(keys, w[:-1], -shift(positive.z(w), positive.n, z, n, prior))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of each whole text; null counts as empty.

    Nothing is shuffled. A column of the same name is replaced. Every row, also one without a doc_id or
    a repeated one, gets its text's score.
    """
    docs = docs.drop(name)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        look = Lookup(m.keys)
        for b in batches:
            out = np.full(b.num_rows, m.bias)
            for lo, hi, data, offsets in tx.chunks(b.column(at).cast(pa.string())):
                f, d = _hits(look, data, offsets)
                out[lo:hi] += np.bincount(d, weights=m.weights[f], minlength=hi - lo) if len(f) else 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
