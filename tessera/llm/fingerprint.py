"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line ends, after sentence ends, and after every twelfth word. Each
paragraph's digest (with its number of occurrences so far) goes into three cells, one in each third of a
table; a cell holds a count, a sum of digests and a sum of their checks. Two versions' tables subtract;
cells of a single digest are peeled off until nothing is left, which gives the differing digests. If
something is left, both are sketched again in a table four times as large.

All documents of a chunk are sketched and peeled together with numpy, round by round.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

U = np.uint64
#: Cells of a fingerprint.
CELLS = 24
#: Most words of a paragraph.
LONGEST = 12
_SEED = [U(0xD1B54A32D192ED03), U(0xAEF17502108EF2D9), U(0x94D049BB133111EB)]
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".!?;:|"]] = True


def paragraphs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all texts' paragraphs and the index of each text's first one."""
    keys, sizes = [], []
    for lo, hi, data, offsets in tx.chunks(pa.array(texts, pa.large_string())):
        s, e, first = tx.words(data, offsets)
        n = hi - lo
        if not len(s):
            sizes.append(np.zeros(n, np.int64))
            continue
        doc = np.repeat(np.arange(n), np.diff(first))
        h = tx.spans(tx.running(data), s, e)
        lines = np.cumsum(data == 10)
        new = np.ones(len(s), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (lines[s[1:]] != lines[s[:-1]]) | _SENTENCE[data[e[:-1] - 1]]
        begin = np.flatnonzero(new)
        inside = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
        begin = np.flatnonzero(inside % LONGEST == 0)
        at = (inside % LONGEST).astype(np.uint64)
        digest = tx.mix(np.add.reduceat(tx.mix(h + at * U(0x9E3779B97F4A7C15)), begin))
        own = doc[begin]
        order = np.lexsort((digest, own))
        d, o = digest[order], own[order]
        same = np.zeros(len(d), bool)
        same[1:] = (d[1:] == d[:-1]) & (o[1:] == o[:-1])
        start = np.flatnonzero(~same)
        nth = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))
        keys.append(tx.mix(d + nth.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F)))
        sizes.append(np.bincount(o, minlength=n))
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64), first


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def _spots(keys: np.ndarray, row: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [row * cells + j * third + (tx.mix(keys ^ _SEED[j]) % U(third)).astype(np.int64) for j in range(3)]


def _put(into: Cells, keys: np.ndarray, row: np.ndarray, sign: np.ndarray, cells: int) -> None:
    """Add (sign 1) or take away (sign -1) keys of tables ``row``."""
    count, total, check = into
    wide = sign.astype(np.int64).view(np.uint64)
    a, b = keys * wide, tx.mix(keys) * wide
    for at in _spots(keys, row, cells):
        np.add.at(count, at, sign)
        np.add.at(total, at, a)
        np.add.at(check, at, b)


def _empty(rows: int, cells: int) -> Cells:
    return np.zeros(rows * cells, np.int64), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)


def sketch(keys: np.ndarray, first: np.ndarray, cells: int = CELLS) -> Cells:
    """One table per text, one after another."""
    out = _empty(len(first) - 1, cells)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _put(out, keys, row, np.ones(len(keys), np.int64), cells)
    return out


def peel(left: Cells, rows: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode subtracted tables in place: (table, key, side) of what came out, and which tables are done."""
    count, total, check = left
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        at = np.flatnonzero(np.abs(count) == 1)
        sign = count[at]
        wide = sign.view(np.uint64)
        key = total[at] * wide
        pure = tx.mix(key) * wide == check[at]
        at, sign, key = at[pure], sign[pure], key[pure]
        if not len(at):
            break
        row = at // cells
        order = np.lexsort((key, row))
        keep = np.ones(len(order), bool)
        keep[1:] = (row[order][1:] != row[order][:-1]) | (key[order][1:] != key[order][:-1])
        take = order[keep]
        got.append((row[take], key[take], sign[take]))
        _put(left, key[take], row[take], -sign[take], cells)
    done = ((count == 0) & (total == 0) & (check == 0)).reshape(rows, cells).all(1)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), done
    r, k, s = (np.concatenate([g[i] for g in got]) for i in range(3))
    return r, k, s, done


def _pick(keys: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[rows]
    at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return keys[at], np.concatenate([[0], np.cumsum(n)])


def difference(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of the digests in which text i of ``a`` and of ``b`` differ; side 1: only in a."""
    rows, cells = np.arange(len(a[1]) - 1), CELLS
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        block = max(1, (1 << 21) // cells)
        failed = []
        for lo in range(0, len(rows), block):
            own = rows[lo : lo + block]
            left = sketch(*_pick(*a, own), cells)
            for x, y in zip(left, sketch(*_pick(*b, own), cells), strict=True):
                x -= y
            r, k, s, done = peel(left, len(own), cells)
            fine = done[r]
            out.append((own[r[fine]], k[fine], s[fine]))
            failed.append(own[~done])
        rows, cells = np.concatenate(failed), cells * 4
    return tuple(np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3))  # type: ignore[return-value]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shared paragraphs over all paragraphs of each pair (1 for two texts without any), and how many are
    only in a and only in b."""
    r, _, s = difference(a, b)
    n = len(a[1]) - 1
    lost, new = np.bincount(r[s > 0], minlength=n), np.bincount(r[s < 0], minlength=n)
    total = np.diff(a[1]) + np.diff(b[1])
    d = lost + new
    return np.where(total > 0, (total - d) / np.maximum(total + d, 1), 1.0), lost, new


def spell(cells: Cells, n: int, sizes: np.ndarray) -> list[str]:
    """Fingerprints as text: number of paragraphs and the table."""
    raw = [x.reshape(n, CELLS).astype(t) for x, t in zip(cells, ("<i4", "<u8", "<u4"), strict=True)]
    return [f"{sizes[i]}:" + base64.b64encode(b"".join(x[i].tobytes() for x in raw)).decode() for i in range(n)]


#: Bytes of text in a range of ids, and the most ranges.
RANGE, RANGES = 64 << 20, 10_000


def _above(cuts: list[int], value: Column) -> Column:
    """How many of the falling ``cuts`` are above ``value``: first by every w-th of them, then by the w behind it."""
    if not cuts:
        return F.lit(0)
    w = isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + w] for i in range(0, len(cuts), w)]
    count = lambda of: F.array_size(F.filter(of, lambda c: c > value))
    block = count(F.lit([b[0] for b in blocks]))
    inside = F.get(F.lit(blocks), block - 1)
    return F.when(block == 0, 0).otherwise((block - 1) * w + count(inside))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, only_before long, only_after long"


def versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text.

    The edited text has its last third replaced by the beginning of the next document, in falling order
    of doc_id; after the last comes the first. Rows without a doc_id come last. Null texts count as empty.
    Equal ids, also missing ones, are ordered by text. Every row gives a row. Texts cross the network once:
    rows are dealt into ranges of doc_id of about RANGE bytes, and each range also gets the first row of the
    next one. All rows of one id are one range, read as a stream. An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = min(RANGES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE))
    cuts = sorted(set(d.approxQuantile("doc_id", [i / many for i in range(1, many)], 0.1 / many)), reverse=True)
    # Range 0 has the largest ids; a range's number counts the cuts above its ids.
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(_above([int(c) for c in cuts], F.col("doc_id"))).cast("int"))
    heads = d.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # At most one row per range, and ranges are at most RANGES: bounded, not by the data.
    order = heads.orderBy("bucket").collect()
    goes = [(order[i]["head"], order[i - 1]["bucket"]) for i in range(len(order))]
    if not goes:
        return spark.createDataFrame([], OUT)
    to = spark.createDataFrame(goes, "head long, to int")
    # The first row of a range: of its largest id (none, if it has no other), the smallest text.
    guests = d.join(F.broadcast(to), d.doc_id.eqNullSafe(to["head"])).groupBy("doc_id", "to").agg(F.min("text").alias("text"))
    rows = d.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").union(guests.select(F.col("to").alias("bucket"), F.lit(True).alias("guest"), "doc_id", "text"))
    dealt = rows.repartition(many, "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int, str]] = []
        size = 0

        def made(rows: list[tuple[int, bool, int, str]]) -> pa.RecordBatch | None:
            texts = [r[3] for r in rows]
            k, first = paragraphs(texts)
            at = np.array([i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]], np.int64)
            if not len(at):
                return None
            edited, sums = [], []
            for i in at:
                t = texts[i]
                third = len(t) // 3
                edited.append(t[: len(t) - third] + texts[i + 1][:third])
                sums.append(hashlib.sha256(edited[-1].encode("utf-8", "surrogatepass")).hexdigest())
            old, ek = _pick(k, first, at), paragraphs(edited)
            near_edited, lost, new = likeness(old, ek)
            near_next, _, _ = likeness(old, _pick(k, first, at + 1))
            n = len(at)
            cols = [[rows[i][2] for i in at], [len(texts[i]) for i in at], sums, spell(sketch(*old), n, np.diff(old[1])), spell(sketch(*ek), n, np.diff(ek[1])), near_edited, near_next, lost, new]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "only_before", "only_after"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                held.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    if (out := made(held)) is not None:
                        yield out
                    held, size = held[-1:], len(row[3])
        if (out := made(held)) is not None:
            yield out

    return dealt.mapInArrow(run, OUT)
