"""Log-bilinear language model with noise-contrastive estimation, over all tokens of a corpus.

Every word has a class: frequent words each have their own, all others share one class per word ending.
A neural log-bilinear model predicts the class from the two classes before; within an ending's class a
word's share is its smoothed count. Both parts sum to one, so token probabilities are normalised.

Counts cover the whole training part of the corpus, and so does the network: it learns from the number of
times that each class stands behind each two classes. The tasks take passes over their share of these
counts and their networks are averaged, some rounds long. The number of words with a class of their own
grows with the vocabulary. The most frequent ``frequent`` words and their counts go to every task, all
other words meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import cut

#: Hash of the end of a document, counted as a word.
END = np.uint64(0x5851F42D4C957F2D)
ENDINGS = 64
#: Words with a class of their own, at least.
OWN = 192
CLASSES = OWN + ENDINGS
#: How often the tasks' networks are averaged, and how many counts a task learns from at a time.
ROUNDS = 3
BLOCK = 1 << 21


def own_words(v: int) -> int:
    """How many of ``v`` distinct words have a class of their own."""
    return max(OWN, 2 * round(v ** (1 / 3)))


def endings(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The ending's class (0 to ENDINGS - 1) of words s..e: by their last two bytes."""
    last = data[e - 1].astype(np.uint32)
    before = np.where(e - s > 1, data[np.maximum(e - 2, 0)], 0).astype(np.uint32)
    return (((last * 257 + before) * np.uint32(2654435761)) >> 26).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, ending classes, and each document's first token; every document ends with END."""
    data = tx.LOWER[data]
    s, e, first = tx.words(data, offsets)
    docs = len(offsets) - 1
    h = np.full(len(s) + docs, END, np.uint64)
    c = np.zeros(len(h), np.int64)
    at = np.arange(len(s)) + np.repeat(np.arange(docs), np.diff(first))
    h[at] = tx.spans(tx.running(data), s, e)
    c[at] = endings(data, s, e) if len(s) else 0
    return h, c, first + np.arange(docs + 1)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, n): each distinct token's hash, ending class and number in all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
            own, at, back = np.unique(h, return_index=True, return_inverse=True)
            return own, c[at], np.bincount(back, weights=n, minlength=len(own)).astype(np.int64)

        def rows() -> pa.RecordBatch:
            h, c, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "c", "n"])

        for b in batches:
            for _, _, data, offsets in tx.chunks(b.column(0)):
                h, c, _ = tokens(data, offsets)
                parts.append((h, c, np.ones(len(h))))
                held += len(h)
                if held > 3_000_000:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > 1_500_000:
                        yield rows()
                        parts, held = [], 0
        if parts:
            yield rows()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, c int, n long").groupBy("h").agg(F.min("c").alias("c"), F.sum("n").alias("n"))


class Lookup:
    """From 64-bit hashes to positions in a table, by open addressing in numpy."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.mask = np.uint64(size - 1)
        self.slots = np.full(size, -1, np.int32)
        left, step = np.arange(len(keys), dtype=np.int32), np.uint64(0)
        while len(left):
            at = ((keys[left] >> np.uint64(7)) + step) & self.mask
            free = self.slots[at] < 0
            at, own = at[free], left[free]
            self.slots[at] = own
            left = np.concatenate([left[~free], own[self.slots[at] != own]])
            step += np.uint64(1)
        self.steps = int(step)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Positions, -1 where a hash is not among the keys."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        left = np.arange(len(h))
        for step in range(self.steps):
            got = self.slots[((h[left] >> np.uint64(7)) + np.uint64(step)) & self.mask]
            hit = (got >= 0) & (self.keys[np.maximum(got, 0)] == h[left])
            out[left[hit]] = got[hit]
            left = left[~hit & (got >= 0)]
            if not len(left):
                break
        return out


def classes_of(h: np.ndarray, ending: np.ndarray, own: Lookup, size: int) -> np.ndarray:
    """Classes of tokens: ``size`` classes of single words come before those of the endings."""
    at = own.find(h)
    return np.where(at >= 0, at, size + ending)


def contexts(c: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token; before a document's start stands its predecessor's end."""
    one = np.concatenate([[end], c[:-1]])
    two = np.concatenate([[end, end], c[:-2]])[: len(c)]
    start = first[:-1]
    one[start] = end
    two[start] = end
    second = start + 1
    second = second[second < first[1:]]
    two[second] = end
    return one, two


def class_counts(docs: DataFrame, own: np.ndarray, size: int) -> DataFrame:
    """(cell, n): how often a class stands behind two classes in all texts of ``docs``.

    A cell is ``(one before * classes + two before) * classes + class``.
    """
    classes = size + ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Lookup(own)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cell, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return cell, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(cell))

        def rows() -> pa.RecordBatch:
            cell, n = merged()
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])

        for b in batches:
            for _, _, data, offsets in tx.chunks(b.column(0)):
                h, c, first = tokens(data, offsets)
                c = classes_of(h, c, mine, size)
                one, two = contexts(c, first, 0)
                parts.append(((one * classes + two) * classes + c, np.ones(len(c))))
                held += len(c)
                if held > 3_000_000:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held > 1_500_000:
                        yield rows()
                        parts, held = [], 0
        if parts:
            yield rows()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def start(share: np.ndarray, dims: int = 24, seed: int = 5) -> list[np.ndarray]:
    """The network before it learns, r, q, m1, m2 and bias, and the sums of squared slopes of each."""
    rng = np.random.default_rng(seed)
    f = np.float32
    r, q = (rng.normal(0, 0.1, (len(share), dims)).astype(f) for _ in range(2))
    params = [r, q, *(np.eye(dims, dtype=f) * f(x) for x in (0.5, 0.3)), np.log(share).astype(f)]
    return params + [np.full(p.shape, 1e-2, f) for p in params]


def descend(state: list[np.ndarray], share: np.ndarray, one: np.ndarray, two: np.ndarray, c: np.ndarray, n: np.ndarray, unit: float, passes: int, rng: np.random.Generator, noise: int = 64, batch: int = 512, rate: float = 0.08) -> None:
    """Noise-contrastive estimation with Adagrad on counts ``n`` of (one before, two before, class), in place.

    A batch's positions share their noise words, drawn from the unigram distribution. Every count is
    learned from in each pass, with its weight; those above ``unit`` are split evenly, so that no step
    hangs on one of them.
    """
    f = np.float32
    params, past = state[:5], state[5:]
    r, q, *m, bias = params
    classes, dims = r.shape
    times = np.ceil(n / unit).astype(np.int64)
    which = np.repeat(np.arange(len(n)), times)
    weight = (n / times / unit).astype(f)
    # Few counts get small batches, so that there are some dozens of steps.
    batch = min(batch, max(128, len(which) // 50))
    log_noise = np.log(noise * share).astype(f)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    spread = np.arange(dims)
    add = lambda at, rows: np.bincount((at[:, None] * dims + spread).ravel(), rows.ravel(), classes * dims).reshape(classes, dims)
    for _ in range(passes):
        order = rng.permutation(which)
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            w, a, b, v = c[at], one[at], two[at], weight[at]
            fake = rng.choice(classes, noise, p=share)
            ra, rb = r[a], r[b]
            hidden = ra @ m[0] + rb @ m[1]
            up = v * (1 - sig((hidden * q[w]).sum(1) + bias[w] - log_noise[w]))
            down = v[:, None] * sig(hidden @ q[fake].T + bias[fake] - log_noise[fake])
            d_hidden = up[:, None] * q[w] - down @ q[fake]
            grads = [
                add(a, d_hidden @ m[0].T) + add(b, d_hidden @ m[1].T),
                add(w, up[:, None] * hidden) - add(fake, down.T @ hidden),
                ra.T @ d_hidden,
                rb.T @ d_hidden,
                np.bincount(w, up, classes) - np.bincount(fake, down.sum(0), classes),
            ]
            for p, g, s in zip(params, grads, past, strict=True):
                g = (g / v.sum()).astype(f)
                s += g * g
                p += f(rate) * g / np.sqrt(s)


def network(state: list[np.ndarray]) -> dict[str, np.ndarray]:
    return dict(zip(("r", "q", "m1", "m2", "bias"), state, strict=False))


def fit(seqs: list[np.ndarray], end: int, epochs: int = 3, seed: int = 5) -> dict[str, np.ndarray]:
    """Train a network of CLASSES classes on sequences of classes here. Without sequences it stays at its start: uniform."""
    c = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    share = (np.bincount(c, minlength=CLASSES) + 0.5) / (len(c) + 0.5 * CLASSES)
    state = start(share, seed=seed)
    if len(c):
        one, two = contexts(c, np.concatenate([[0], np.cumsum([len(s) for s in seqs])]), end)
        passes = max(epochs, min(30, 600 * 4096 // len(c)))
        descend(state, share, one, two, c, np.ones(len(c)), 1.0, passes, np.random.default_rng(seed))
    return network(state)


def fit_counts(cells: DataFrame, share: np.ndarray) -> dict[str, np.ndarray]:
    """Train a network on all of ``cells(cell, n)``, as of :func:`class_counts`; ``share`` is each class's part of the tokens.

    In every round each task goes on with the network of the last one over all its counts, a block at a
    time, and the tasks' networks are averaged by the tokens that they saw.
    """
    classes = len(share)
    state = start(share)
    n_cells, n_all = cells.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_cells:
        return network(state)
    # Small corpora get more passes, so that there are some hundred steps.
    unit, passes = n_all / n_cells, -(-max(ROUNDS, min(30, 600 * 4096 // n_cells)) // ROUNDS)
    shapes = [p.shape for p in state]
    flat = lambda x: np.concatenate([p.ravel() for p in x])
    places = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    whole = lambda x: [p.reshape(s).copy() for p, s in zip(np.split(x, places), shapes, strict=True)]
    tasks = cells.rdd.getNumPartitions()
    kind = "task int, weight double, state binary"

    def total(rows: list[tuple[int, float, bytes]]) -> tuple[float, np.ndarray]:
        """The sum of the rows' weights and weighted networks, in the order of tasks."""
        rows.sort(key=lambda x: x[0])
        return sum(x[1] for x in rows), sum(np.frombuffer(x[2], np.float32).astype(np.float64) * x[1] for x in rows)

    def row(task: int, weight: float, mean: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([float(weight)]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["task", "weight", "state"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x["task"], x["weight"], x["state"]) for b in batches for x in b.to_pylist()]
        if rows:
            weight, mean = total(rows)
            yield row(rows[0][0], weight, mean / weight)

    for k in range(ROUNDS):
        shared = cells.sparkSession.sparkContext.broadcast((flat(state), share))

        def learn(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            own, parts = whole(shared.value[0]), shared.value[1]
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([k, task])
            seen, held, room = 0.0, [], 0

            def step() -> None:
                cell, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                order = np.argsort(cell)
                cell, n = cell[order], n[order]
                descend(own, parts, cell // classes // classes, cell // classes % classes, cell % classes, n, unit, passes, rng)

            for b in batches:
                held.append([b.column(i).to_numpy() for i in (0, 1)])
                room += b.num_rows
                seen += float(held[-1][1].sum())
                if room >= BLOCK:
                    step()
                    held, room = [], 0
            if room:
                step()
            if seen:
                yield row(task, seen, flat(own))

        # In two steps: with many tasks the driver gets the means of about the square root of their number.
        got = cells.mapInArrow(learn, kind).repartition(max(1, isqrt(tasks)), "task").mapInArrow(merge, kind).collect()
        weight, mean = total([(x["task"], x["weight"], bytes(x["state"])) for x in got])
        state = whole((mean / weight).astype(np.float32))
        shared.destroy()
    return network(state)


def log_parts(net: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three tables by pairs of classes, log10: of a class and the one before, of a class and the one two
    before, and the normaliser of the two before. A probability is first + second - third."""
    q = net["q"].astype(np.float64).T
    one, two = net["r"] @ net["m1"] @ q + net["bias"], net["r"] @ net["m2"] @ q
    high = one.max(1, keepdims=True), two.max(1, keepdims=True)
    norm = np.log(np.exp(one - high[0]) @ np.exp(two - high[1]).T) + high[0] + high[1].T
    return tuple((x / np.log(10)).astype(np.float32) for x in (one, two, norm))


def log_table(net: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each class after each pair of classes: [one before, two before, class]."""
    one, two, norm = log_parts(net)
    return one[:, None] + two[None] - norm[:, :, None]


def score(docs: DataFrame, train: Column, frequent: int = 1 << 18) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: token numbers, base score and the model's score (log10).

    ``train`` says which rows the counts and the model learn from. Null texts count as empty: one token,
    the end. With no training rows N and V are 0 and the network is uniform. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    counts = cut(word_counts(docs.where("train")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = int(total[0]), int(total[1])
    # The most frequent words: whole classes of counts from the top, as many as fit in the bound.
    level = F.floor(F.log2("n") * 8)
    room, lowest = frequent, 1 << 30
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        lowest = row["level"]
    top = counts.where(level >= lowest).select("h", "n").toPandas().sort_values(["n", "h"], ascending=[False, True])
    known = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    known_n = top["n"].to_numpy().astype(np.int64)
    size = own_words(v_all)
    own = np.concatenate([[END], known[known != END][: size - 1]])
    own_ids = [int(x) for x in own.view(np.int64)]
    per = counts.where(~F.col("h").isin(own_ids)).groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    scale, tail_n = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in per:
        scale[row["c"]], tail_n[row["c"]] = row["n"] + row["v"], row["n"]
    scale = np.log10(scale + 1)
    own_n = np.zeros(size)
    at = Lookup(known).find(own)
    own_n[: len(own)] = np.where(at >= 0, known_n[np.maximum(at, 0)] if len(known) else 0, 0)
    share = np.concatenate([own_n, tail_n]) + 0.5
    net = fit_counts(cut(class_counts(docs.where("train"), own, size), "cells"), share / share.sum())
    model = spark.sparkContext.broadcast({"own": own, "known": known, "known_n": known_n, "net": net, "scale": scale})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        mine, many, (by_one, by_two, norm) = Lookup(m["own"]), Lookup(m["known"]), log_parts(m["net"])
        log_n = np.log10(m["known_n"] + 1.0)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, data, offsets in tx.chunks(b.column(1)):
                h, ending, first = tokens(data, offsets)
                c = classes_of(h, ending, mine, size)
                one, two = contexts(c, first, 0)
                at = many.find(h)
                hit = at >= 0
                logs = np.where(hit, log_n[np.maximum(at, 0)] if len(log_n) else 0.0, 0.0)
                tail = c >= size
                own_part = by_one[one, c] + by_two[two, c] - norm[one, two] + np.where(tail, logs - m["scale"][ending], 0)
                add = lambda x: np.add.reduceat(x.astype(np.float64), first[:-1])
                rare = np.flatnonzero(~hit)
                spot = np.searchsorted(rare, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + hi - lo)),
                        b.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        pa.array(add(hit).astype(np.int64)),
                        pa.array(add(logs)),
                        pa.array(add(own_part)),
                        pa.ListArray.from_arrays(pa.array(spot), pa.array(h[rare].view(np.int64))),
                    ],
                    names=["row", "doc_id", "n_tokens", "known", "logs", "own", "rare"],
                )
                row += hi - lo

    main = cut(docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, own double, rare array<long>"), "scores")
    # Words beyond the frequent ones; those without a count add nothing to either sum.
    rare = main.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("tf"))
    found = rare.join(counts, "h").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("tf").alias("more_known"))
    base = float(np.log10(n_all + v_all + 1.0))
    return main.drop("rare").join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("own") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
