"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Small boosted trees are grown on the statistics of labelled documents; the path to every node is a rule
(a conjunction of thresholds). A lasso-penalised logistic regression picks few rules and weights them.
The picked rules are compiled into Spark column expressions over the statistics' columns.

The fit uses at most ``max_rows`` labelled documents, chosen by a hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as tx
from .shared import free

#: Statistics of a text, in the order in which :func:`measure` makes them.
STATS = ["n_bytes", "n_words", "mean_word", "upper", "digit", "mark", "symbol", "pipe", "bang", "space", "wide", "repeat_next", "distinct", "repeat_line", "mean_line", "ends_mark", "longest_word"]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = tx.NOT_ALNUM & ~tx.SPACE
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]^_`{|}~\\/"]] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per document of a chunk; shares are of bytes, words or lines. All 0 if empty."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)

    def per(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    s, e, first = tx.words(data, offsets)
    count = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    h = tx.spans(tx.running(data), s, e)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    hs, dd = h[order], doc[order]
    new = np.ones(len(h))
    new[1:] = (hs[1:] != hs[:-1]) | (dd[1:] != dd[:-1])
    longest = np.zeros(n)
    np.maximum.at(longest, doc, (e - s).astype(float))
    # Lines: between line ends, those without words left out.
    ends = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, ends + 1]))
    ls, le = cuts[:-1], cuts[1:]
    run = tx.running(data)
    ls, le = ls[le > ls], le[le > ls]
    le = le - (data[le - 1] == 10) if len(le) else le
    keep = le > ls
    ls, le = ls[keep], le[keep]
    lh, ld = tx.spans(run, ls, le), np.searchsorted(offsets, ls, "right") - 1
    lo = np.lexsort((lh, ld))
    again = np.zeros(len(lh))
    again[1:] = (lh[lo][1:] == lh[lo][:-1]) & (ld[lo][1:] == ld[lo][:-1])
    lines = np.bincount(ld, minlength=n).astype(float)
    letters = per(_LETTER[data])
    out = [
        size,
        count,
        share(by_doc((e - s).astype(float)), count),
        share(per(_UPPER[data]), letters),
        share(per(_DIGIT[data]), size),
        share(per(_MARK[data]), size),
        share(per(_SYMBOL[data]), size),
        share(per(data == 124), count),
        share(per(data == 33), count),
        share(per(tx.SPACE[data]), size),
        share(per(data > 127), size),
        share(by_doc(same), count),
        share(by_doc(new), count),
        share(np.bincount(ld[lo], weights=again, minlength=n), lines),
        share(size, lines),
        share(by_doc(_MARK[data[e - 1]].astype(float)) if len(e) else np.zeros(n), count),
        longest,
    ]
    return np.stack(out, 1)


def stats(docs: DataFrame, name: str = "stats") -> DataFrame:
    """All columns of ``docs`` and a struct column ``name`` of the statistics of each whole text. A column
    of the same name is replaced."""
    docs = docs.drop(name)
    at = docs.columns.index("text")
    kind = pa.struct([(c, pa.float64()) for c in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(data, offsets) for _, _, data, offsets in tx.chunks(b.column(at).cast(pa.string()))]
            x = np.concatenate(rows) if rows else np.zeros((0, len(STATS)))
            own = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATS))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StructType([StructField(c, DoubleType()) for c in STATS]))]))


Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, shrink: float = 0.2, leaf: int = 10, seed: int = 3) -> list[Rule]:
    """Rules of boosted regression trees: each node's path as ((statistic, above, threshold), ...)."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], 1)
    f = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, w = y - p, np.maximum(p * (1 - p), 1e-6)
        some = rng.choice(len(y), max(2 * leaf, len(y) // 2), replace=len(y) < 4 * leaf)
        cols = rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False)
        stack = [((), np.isin(np.arange(len(y)), some), np.ones(len(y), bool), 0)]
        while stack:
            path, rows, all_rows, level = stack.pop()
            best = (1e-9, None, None)
            at = np.flatnonzero(rows)
            if level < depth and len(at) >= 2 * leaf:
                total_g, total_w = g[at].sum(), w[at].sum()
                for j in cols:
                    if not len(edges[j]):
                        continue
                    k = len(edges[j]) + 1
                    sg, sw, sn = (np.cumsum(np.bincount(code[at, j], weights=v, minlength=k))[:-1] for v in (g[at], w[at], None))
                    gain = sg**2 / (sw + 1) + (total_g - sg) ** 2 / (total_w - sw + 1) - total_g**2 / (total_w + 1)
                    gain[(sn < leaf) | (len(at) - sn < leaf)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], j, b)
            if best[1] is None:
                f[all_rows] += shrink * g[at].sum() / (w[at].sum() + 1) if len(at) else 0
                continue
            j, b = best[1], best[2]
            for above in (False, True):
                side = (code[:, j] > b) == above
                rule = (*path, (int(j), above, float(edges[j][b])))
                found[rule] = None
                stack.append((rule, rows & side, all_rows & side, level + 1))
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, threshold in rule:
        out &= (x[:, j] > threshold) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a lasso-penalised logistic regression, by accelerated proximal gradient."""
    n, k = a.shape
    # The steepest curvature: the largest eigenvalue of the columns' products, the intercept's included.
    gram = np.zeros((k + 1, k + 1))
    for lo in range(0, n, 1024):
        block = np.c_[a[lo : lo + 1024], np.ones(len(a[lo : lo + 1024]))].astype(float)
        gram += block.T @ block
    rate = 1.0 / (0.25 * max(1e-9, float(np.linalg.eigvalsh(gram)[-1]) / n))
    w = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(a @ z[:k].astype(a.dtype) + z[k], -30, 30))) - y
        new = z - rate * np.append(a.T @ r.astype(a.dtype), r.sum()) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:k], float(w[k])


class Rules:
    """Picked rules with their weights, and the intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def column(self, stats: str = "stats") -> Column:
        """The score as a column expression: the logistic function of the weights of the rules that hold."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            cond = F.lit(True)
            for j, above, threshold in rule:
                c = F.col(f"{stats}.{STATS[j]}")
                cond = cond & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        lines = [f"{w:+.3f}  " + " and ".join(f"{STATS[j]} {'>' if up else '<='} {t:.4g}" for j, up, t in r) for r, w in self.rules]
        return "\n".join([*lines, f"{self.intercept:+.3f}  always"])


def learn(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = 12_000) -> Rules:
    """Fit on labelled rows of ``docs(doc_id, text)`` for which ``train`` holds.

    ``labels(doc_id, quality)``: several labels of a document count as good if one is; null labels tell
    nothing. Without labels of both kinds there are no rules, and every score is the share of good ones
    (1 without any label).
    """
    own = labels.where(train & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows ids: the broadcast is bounded by the parameter.
    rows = stats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("y", "text")).select("y", "stats.*").toPandas()
    y = rows["y"].to_numpy().astype(float) if len(rows) else np.zeros(0)
    share = y.mean() if len(y) else 1.0
    if share in (0.0, 1.0):
        return Rules([], 30.0 if share == 1.0 else -30.0)
    order = np.lexsort(rows[STATS].to_numpy().T)
    x, y = rows[STATS].to_numpy()[order], y[order]
    rules = grow(x, y)
    a = np.stack([holds(r, x) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(x), 0), np.float32)
    w, intercept = lasso(a, y)
    return Rules([(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-3], intercept)


def score(docs: DataFrame, rules: Rules, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of each whole text; null counts as empty.

    Nothing is shuffled. A column of the same name is replaced. Every row, also one without a doc_id or
    a repeated one, gets its text's score.
    """
    docs = docs.drop(name)
    own = free(docs, "stats")
    return stats(docs, own).withColumn(name, rules.column(own)).drop(own)
