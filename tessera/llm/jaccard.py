"""N-gram Jaccard join: hashed token groups, trees of group counts, and exact verification.

A document is a set of word shingles. Two documents are linked if ``100 * |A n B| >= percent * |A u B|``.

1. Documents with equal sets are one class; its smallest id stands for it.
2. Shingles are hashed into groups. Sets that are this similar differ in at most D shingles, so of more
   than D filled groups at least one has equal content in both: its content hash is their meeting place.
   The number of groups depends on the size class only, so partners agree on it. The smallest id of a
   meeting place is its root; all documents that meet a root make one tree, so what many meeting places
   repeat is one member there.
3. A point is a document's vector of group counts; the summed minima of two points' coordinates bound
   their overlap. Every member is compared with its root: a number of pairs in proportion to the rows,
   also in the largest groups of near copies. Links give components.
4. Trees that still hold several components are searched: members are bulk-loaded into tiles of bounded
   bytes, and each pair of tiles is one group of rows. In it, nodes of a few points have the largest count
   of each coordinate as upper corner; pairs of nodes whose summed minima reach the needed overlap are
   opened, and pairs of points of different components that reach it survive.
5. Surviving pairs are verified on their whole texts.

One tree over all points would not do: with few coordinates all documents of one length overlap, with many
the upper corners of unrelated points do. The roots are the partition of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .shared import cut, release, semi_by_id

#: Members of a root, or partners in verification, that one group of rows holds at most (about).
STAR = 4096
#: Bytes of counts in a tile, and points of a node.
TILE, NODE = 2 << 20, 16
#: Parts of a class of equal sets in which its copies are looked up.
SALTS = 64
#: Ratio of a size class's bounds.
RATIO = 1.25


def _classes(percent: int) -> np.ndarray:
    """Lower bounds of the size classes, up to any size."""
    out, lo = [1], 1.0
    while lo < 2**40:
        lo = max(lo * RATIO, out[-1] + 1)
        out.append(int(lo))
    return np.array(out, np.int64)


def _differing(total: np.ndarray | int, percent: int):
    """Most shingles by which two linked sets of this summed size can differ."""
    return total * (100 - percent) // (100 + percent)


def _signatures(g: np.ndarray, percent: int, bounds: np.ndarray) -> np.ndarray:
    """Bucket keys (48 bits; equal keys of different groups only add candidates) of one set of distinct shingle hashes.

    Two linked sets have a key in common: in the size class of the larger one both have all their groups'
    keys. A set with too few filled groups to be sure of an untouched one adds its smallest hashes (prefix
    filter); a pair can miss in the groups only if both sets do.
    """
    n = len(g)
    if n == 0:
        return np.zeros(0, np.uint64)
    top = n * 100 // percent
    k = int(np.searchsorted(bounds, n, "right")) - 1
    out, short = [], False
    while True:
        most = int(bounds[k + 1]) - 1
        d = int(_differing(2 * most, percent))
        groups = d + 1 + (d + 11) // 12
        at = (g >> np.uint64(20)) % np.uint64(groups)
        total = np.zeros(groups, np.uint64)
        count = np.bincount(at.astype(np.int64), minlength=groups)
        np.add.at(total, at.astype(np.int64), tx.mix(g + np.uint64(0x632BE59BD9B4E019)))
        filled = np.flatnonzero(count)
        key = total[filled] + (filled + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(k * 0x8EBC6AF09C88C6E3 % 2**64) + count[filled].astype(np.uint64) * np.uint64(0x589965CC75374CC3)
        out.append(tx.mix(key))
        if len(filled) <= _differing(n + min(top, most), percent):
            short = True
        k += 1
        if bounds[k] > top:
            break
    if short:
        keep = n - (n * percent + 99) // 100 + 1
        out.append(tx.mix(np.sort(g)[:keep] ^ np.uint64(0xE7037ED1A0B428DB)))
    return np.concatenate(out) >> np.uint64(16)


SETS = "doc_id long, n int, k1 long, k2 long, counts binary, keys array<long>"


def _dims(n: int) -> int:
    """Coordinates of a point of ``n`` shingles: a power of two, so that more of them fold onto fewer."""
    return max(16, 1 << int(n).bit_length())


def sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document: set size, a 128-bit hash of the set, group counts (a byte each, 255 for more) and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _classes(percent)
        for b in batches:
            for lo, hi, data, offsets in tx.chunks(b.column(1)):
                h, first = tx.hash_words(data, offsets)
                g, at = tx.shingles(h, first, k)
                n, k1, k2, counts, keys = [], [], [], [], []
                for i in range(hi - lo):
                    own = np.unique(g[at[i] : at[i + 1]])
                    n.append(len(own))
                    k1.append(own.sum(dtype=np.uint64))
                    k2.append(np.bitwise_xor.reduce(tx.mix(own ^ np.uint64(0x1D8E4E27C47D124F))) if len(own) else np.uint64(0))
                    dims = _dims(len(own))
                    counts.append(np.minimum(np.bincount((own & np.uint64(dims - 1)).astype(np.int64), minlength=dims), 255).astype(np.uint8).tobytes())
                    keys.append(_signatures(own, percent, bounds).view(np.int64))
                spots = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        pa.array(np.array(n, np.int32)),
                        pa.array(np.array(k1, np.uint64).view(np.int64)),
                        pa.array(np.array(k2, np.uint64).view(np.int64)),
                        pa.array(counts, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(spots), pa.array(np.concatenate(keys))),
                    ],
                    names=["doc_id", "n", "k1", "k2", "counts", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SETS)


def _fold(points: np.ndarray, dims: int) -> np.ndarray:
    """Counts of ``points`` (rows) in ``dims`` coordinates."""
    if points.shape[1] == dims:
        return points
    folded = points.reshape(len(points), -1, dims).sum(1, dtype=np.uint16)
    return np.minimum(folded, 255).astype(np.uint8)


class Points:
    """Points in the same coordinates: counts, set sizes, and what the counts don't tell of the sizes."""

    def __init__(self, counts: list[np.ndarray], n: np.ndarray, dims: int):
        self.counts = np.concatenate([_fold(c[None, :], dims) for c in counts])
        self.n = n.astype(np.int64)
        self.over = self.n - self.counts.sum(1, dtype=np.int64)

    def nodes(self) -> Points:
        """Upper corners of NODE points each, with the smallest size: what bounds the node bounds its points."""
        out = object.__new__(Points)
        at = np.arange(0, len(self.n), NODE)
        out.counts, out.n, out.over = np.maximum.reduceat(self.counts, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.over, at)
        return out


def may_link(x: Points, i: slice, y: Points, j: np.ndarray | slice, percent: int) -> np.ndarray:
    """Whether points (or nodes) ``i`` of ``x`` and ``j`` of ``y`` can be linked, by their summed minima."""
    bound = np.minimum(x.counts[i][:, None, :], y.counts[j][None, :, :]).sum(2, dtype=np.int64) + np.minimum(x.over[i][:, None], y.over[j][None, :])
    return bound * (100 + percent) >= (x.n[i][:, None] + y.n[j][None, :]) * percent


def search(x: Points, cx: np.ndarray, y: Points, cy: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of two tiles (``same``: of one) that can be linked and are of different components.

    Nodes are compared first; only pairs of nodes that reach the overlap are opened.
    """
    bx, by = x.nodes(), y.nodes()
    step = max(1, (1 << 22) // max(1, by.counts.size))
    left, right = [], []
    for lo in range(0, len(bx.n), step):
        upper, lower = np.nonzero(may_link(bx, slice(lo, lo + step), by, slice(None), percent))
        for node in np.unique(upper):
            at = (lo + node) * NODE
            own = slice(at, min(at + NODE, len(x.n)))
            others = (lower[upper == node][:, None] * NODE + np.arange(NODE)).ravel()
            others = others[others < len(y.n)]
            wide = max(1, (1 << 22) // (NODE * y.counts.shape[1]))
            for begin in range(0, len(others), wide):
                part = others[begin : begin + wide]
                fine = may_link(x, own, y, part, percent) & (cx[own][:, None] != cy[part][None, :])
                i, j = np.nonzero(fine)
                left.append(at + i)
                right.append(part[j])
    i, j = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _stars(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (a, part, follows, doc_id, ...columns of ``table``) dealt out and sorted by group: a root's row
    first, then the rows of its partners b. Groups of more than STAR partners are several parts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "a", "left").select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("int").alias("part"), "b")
    rows = dealt.select("a", "part", F.lit(True).alias("follows"), F.col("b").alias("doc_id")).union(dealt.select("a", "part", F.lit(False), F.col("a")).distinct())
    return rows.join(table, "doc_id").select("a", "part", "follows", *table.columns).repartition("a", "part").sortWithinPartitions("a", "part", "follows")


class Roots:
    """The root's rows of the group at hand: one, or several if its id has several texts."""

    def __init__(self):
        self.key: list = []
        self.of: list[tuple] = []

    def add(self, key: list, row: tuple) -> None:
        if key != self.key:
            self.key, self.of = key, []
        if not any(all(np.array_equal(x, y) for x, y in zip(row, old, strict=True)) for old in self.of):
            self.of.append(row)


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs(a, b)`` whose points ``points(doc_id, n, counts)`` can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(size: int, root: np.ndarray, n: int, own: np.ndarray) -> bool:
            if n * 100 < size * percent or size * 100 < n * percent:
                return False
            both = Points([root, own], np.array([size, n]), min(len(root), len(own)))
            return bool(may_link(both, slice(0, 1), both, slice(1, 2), percent)[0, 0])

        roots = Roots()
        for b in batches:
            n, counts = b.column(4).to_pylist(), _vectors(b.column(5))
            keep = np.zeros(b.num_rows, bool)
            for i, (follows, *key) in enumerate(zip(*[b.column(c).to_pylist() for c in (2, 0, 1)], strict=True)):
                if follows:
                    keep[i] = any(near(*root, n[i], counts[i]) for root in roots.of)
                else:
                    roots.add(key, (n[i], counts[i].copy()))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(3).take(at)], names=["a", "b"])

    return _stars(pairs, points.select("doc_id", "n", "counts")).mapInArrow(run, "a long, b long").distinct()


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """The byte vectors of a binary column, without copies."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return [data[i:j] for i, j in zip(offsets, offsets[1:], strict=False)]


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the distinct (a, b) of ``pairs`` that are linked, by their whole texts.

    A text is sent once for each pair that has it as b, and once for a group of partners as a.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = semi_by_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(root: np.ndarray, own: np.ndarray) -> bool:
            inter = len(np.intersect1d(root, own, assume_unique=True))
            return inter > 0 and 100 * inter >= percent * (len(root) + len(own) - inter)

        roots = Roots()
        for b in batches:
            a, part, follows = (b.column(c).to_pylist() for c in range(3))
            keep = np.zeros(b.num_rows, bool)
            for lo, hi, data, offsets in tx.chunks(b.column(4)):
                h, first = tx.hash_words(data, offsets)
                g, spot = tx.shingles(h, first, k)
                for i in range(lo, hi):
                    own = np.unique(g[spot[i - lo] : spot[i - lo + 1]])
                    if follows[i]:
                        keep[i] = any(linked(root, own) for (root,) in roots.of)
                    else:
                        roots.add([a[i], part[i]], (own,))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(3).take(at)], names=["a", "b"])

    return _stars(pairs, texts).mapInArrow(run, "a long, b long").distinct()


def grown(trees: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of members of one of ``trees(root, doc_id, comp)`` that can be linked by their
    points and are of different components."""
    mixed = trees.groupBy("root").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("root")
    own = cut(trees.join(mixed, "root").join(points.select("doc_id", "n", "counts"), "doc_id"), "members")
    tiles = own.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("counts")) / TILE)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    placed = own.join(tiles, "root").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cols = ["root", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), (F.col("tile") > F.col("other")).alias("right"), "comp", "n", "doc_id", "counts"]
    dealt = placed.select(*cols).repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "right", "comp", "n")

    def pairs(rows: list[tuple], same: bool) -> pa.RecordBatch:
        dims = min(len(r[4]) for r in rows)
        sides = [[r for r in rows if not r[0]], [r for r in rows if r[0]]]
        made = [(Points([r[4] for r in s], np.array([r[2] for r in s]), dims), np.array([r[1] for r in s]), np.array([r[3] for r in s])) for s in (sides[:1] * 2 if same else sides) if s]
        if len(made) < 2:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        (x, cx, ix), (y, cy, iy) = made
        i, j = search(x, cx, y, cy, same, percent)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ix[i], iy[j])), pa.array(np.maximum(ix[i], iy[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key: tuple | None = None
        for b in batches:
            keys = zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)
            rows = zip(*[b.column(i).to_pylist() for i in range(3, 7)], [v.copy() for v in _vectors(b.column(7))], strict=True)
            for own_key, row in zip(keys, rows, strict=True):
                if own_key != key:
                    if held:
                        yield pairs(held, key[1] == key[2])
                    held, key = [], own_key
                held.append(row)
        if held:
            yield pairs(held, key[1] == key[2])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def equal_sets(s: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, rep): the smallest id with the same set, for rows of ``s`` that have shingles.

    Classes are looked up in parts, so that no class of copies meets in one task.
    """
    own = s.where("n > 0").select("doc_id", "k1", "k2", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    cls = ["k1", "k2", "n"]
    parts = own.groupBy(*cls, "salt").agg(F.min("doc_id").alias("low"))
    reps = parts.join(parts.groupBy(*cls).agg(F.min("low").alias("rep")), cls).select(*cls, "salt", "rep")
    return own.join(reps, [*cls, "salt"]).select("doc_id", *cls, "rep").distinct()


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    A row for each distinct id: rows without a doc_id are left out, equal rows count once (an id with several
    texts belongs to the components of all of them). Null, empty and blank texts have no shingles, link with
    nothing and are their own component. Texts of fewer than ``k`` words are one shingle. Equal texts always
    share a component. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.where("doc_id is not null")
    s = cut(sets(docs, k, percent), "sets")
    # 1. Classes of equal sets.
    members = cut(equal_sets(s), "members")
    # 2. Meeting places of more than one set, and the trees of their roots.
    points = semi_by_id(s.where("n > 0"), members.where("doc_id != rep").select("doc_id", "k1", "k2", "n"), ["doc_id", "k1", "k2", "n"], "left_anti")
    rows = points.select("doc_id", F.explode("keys").alias("key"))
    full = cut(rows.groupBy("key").agg(F.count("*").alias("sets"), F.min("doc_id").alias("root"), F.max("doc_id").alias("doc_id")).where("sets > 1"), "full")
    # Where two sets meet, both are known; the members of larger places are looked up.
    larger = rows.join(full.where("sets > 2").select("key", "root"), "key").select("root", "doc_id")
    trees = cut(full.where("sets = 2").select("root", "doc_id").union(larger).where("doc_id != root").distinct(), "trees")
    release(docs.sparkSession)
    point = cut(semi_by_id(points.select("doc_id", "n", "counts"), trees.select(F.explode(F.array("root", "doc_id")).alias("doc_id")).distinct(), "doc_id"), "points")
    # 3. Everyone against the roots.
    led = cut(bounded(trees.select(F.col("root").alias("a"), F.col("doc_id").alias("b")), point, percent), "pairs")
    links = cut(verify(led, docs, k, percent), "links")
    release(docs.sparkSession)
    # 4. Trees of several components.
    comps = components(links)
    open_ = trees.join(comps, trees.doc_id == comps.id, "left").select("root", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    rest = cut(grown(cut(open_, "open"), point, percent).join(led, ["a", "b"], "left_anti"), "pairs")
    # 5. All links, including the classes' own.
    several = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id")
    texts = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = cut(components(links.union(verify(rest, docs, k, percent)).union(texts)), "components")
    got = members.join(final, members.rep == final.id, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    return s.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(got, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).distinct()
