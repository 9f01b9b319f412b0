"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised words within a sentence) and units (unit words
behind a number) are replaced by typed placeholders, their values kept as slots. Windows of templates, and
of the plain words in lower case, of documents and of benchmark items are joined by hash. For each pair of a document and an item the windows
must cover enough of the item, and where slot values differ, one document value must stand for one item
value throughout an occurrence: a re-parameterised question changes its numbers and names, but consistently.
Two item values may become equal, and other occurrences of the item in the document may have other values.

Documents are filtered before the join by a bitmap of the benchmark's window hashes, whose size is fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import cut

U = np.uint64
#: Words of a window, and how many of them must not be placeholders.
WINDOW, LITERALS = 8, 4
#: Words that a replaced value may have more or less than the item's within one occurrence.
GAP = 3
#: Bits of the filter (2 MiB): a constant, whatever the benchmark's size.
BITS = 1 << 24

# Unit words that are placeholders behind a number.
UNITS = """mm cm m km in ft mi yd mg g kg t lb lbs oz ml l kl s sec secs second seconds min mins minute minutes h hr hrs hour
hours day days week weeks month months year years hz khz mhz ghz v kv w kw mw kwh j kj cal kcal pa kpa bar k c f
percent dollar dollars usd euro euros eur pound pounds cent cents meter meters metre metres kilometer kilometers
centimeter centimeters gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches ton tons""".split()
_SLOT = {"number": U(0x1111111111111111), "name": U(0x2222222222222222), "unit": U(0x3333333333333333)}
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?:\n"]] = True


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, value hash and placeholder flag of each word of a chunk, and first words of documents."""
    s, e, first = tx.words(data, offsets, tx.NOT_ALNUM)
    low = tx.LOWER[data]
    # Capitals of Latin-1 (U+00C0 to U+00DE), two bytes each, become small too.
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] < 0x9F) & (data[second] != 0x97)]
    low[second] += 32
    value = tx.spans(tx.running(low), s, e)
    if not len(s):
        return value, value, np.zeros(0, bool), first
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    number = digits[e] - digits[s] == e - s
    ends = np.concatenate([[0], np.cumsum(_END[data])])
    opens = np.ones(len(s), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (ends[s[1:]] > ends[e[:-1]])
    c0, c1 = data[s], np.where(e - s > 1, data[np.minimum(s + 1, len(data) - 1)], 0)
    # ASCII capitals and the two-byte capitals of Latin-1 (U+00C0 to U+00DE).
    capital = ((c0 >= 65) & (c0 < 91)) | ((c0 == 0xC3) & (c1 >= 0x80) & (c1 < 0x9F))
    name = capital & ~opens & ~number
    unit = np.zeros(len(s), bool)
    unit[1:] = np.isin(value[1:], _units()) & number[:-1] & (doc[1:] == doc[:-1])
    name &= ~unit
    kind = np.select([number, unit, name], [_SLOT["number"], _SLOT["unit"], _SLOT["name"]], value)
    return kind, value, number | unit | name, first


def _units() -> np.ndarray:
    if not hasattr(_units, "known"):
        data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
        _units.known = tx.hash_words(data, np.array([0, len(data)]))[0]
    return _units.known


ROWS = "id long, h long, pos long, plain boolean, able boolean, slots array<long>"
_PLAIN = U(0x6C62272E07BB0142)


def windows(table: DataFrame, id_col: str, keep: bytes | None = None, sizes: list[int] | None = None) -> DataFrame:
    """(id, h, pos, plain, able, slots) of the windows of ``table``'s texts; only those in the bitmap ``keep``, if given.

    Windows have WINDOW words and texts of fewer words are one window; with ``sizes``, windows have just
    these numbers of words. Every window counts with its plain words; those with some placeholders, but
    LITERALS other words, count as templates too. ``able`` are these and windows without placeholders: those
    that a re-parameterised text still has.
    """
    shared = table.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8) if shared is not None else None
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in tx.chunks(b.column(1)):
                kind, value, slot, first = templates(data, offsets)
                holes = np.concatenate([[0], np.cumsum(slot)])
                for size in sizes or [WINDOW]:
                    g, at = tx.shingles(kind, first, size)
                    plain = tx.shingles(value, first, size)[0] ^ _PLAIN
                    n = np.diff(at)
                    doc = np.repeat(np.arange(hi - lo), n)
                    pos = np.arange(at[-1]) - at[:-1][doc]
                    begin = first[:-1][doc] + pos
                    end = np.minimum(begin + size, first[1:][doc])
                    count = holes[end] - holes[begin]
                    fine = (count > 0) & (end - begin - count >= np.minimum(LITERALS, end - begin))
                    able = fine | (count == 0)
                    full = end - begin == size if sizes else np.ones(len(plain), bool)
                    for h, keep_, is_plain in ((plain, full, True), (g, fine & full, False)):
                        if bits is not None:
                            bit = (h & U(BITS - 1)).astype(np.int64)
                            keep_ = keep_ & (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                        own = np.flatnonzero(keep_)
                        slots = [] if is_plain else [value[begin[i] : end[i]][slot[begin[i] : end[i]]].view(np.int64) for i in own]
                        spots = np.zeros(len(own) + 1, np.int32) if is_plain else np.concatenate([[0], np.cumsum([len(x) for x in slots])]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[lo:hi][doc[own]].astype(np.int64)), pa.array(h[own].view(np.int64)), pa.array(pos[own].astype(np.int64)), pa.array(np.full(len(own), is_plain)), pa.array(able[own]), pa.ListArray.from_arrays(pa.array(spots), pa.array(np.concatenate(slots) if slots else np.zeros(0, np.int64)))],
                            names=["id", "h", "pos", "plain", "able", "slots"],
                        )

    return table.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").mapInArrow(run, ROWS)


def short_lengths(items: DataFrame) -> list[int]:
    """The distinct numbers of words below WINDOW of ``items(text)``; none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in tx.chunks(b.column(0)):
                n = np.unique(np.diff(tx.words(data, offsets, tx.NOT_ALNUM)[2]))
                yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < WINDOW)].astype(np.int64))], names=["n"])

    return sorted(r["n"] for r in items.select(F.col("text").cast("string")).mapInArrow(run, "n long").distinct().collect())


def bitmap(marks: DataFrame) -> bytes:
    """The filter: a bit for each value of h modulo BITS; at most BITS numbers reach the driver."""
    at = marks.select(F.expr(f"cast(h & {BITS - 1} as int)").alias("b")).distinct().toPandas()["b"].to_numpy().astype(np.int64)
    bits = np.zeros(BITS // 8, np.uint8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, run_windows: int = 6) -> DataFrame:
    """(doc_id, item_id, item_windows, windows, same_windows, kind) for documents that hold benchmark items.

    An item is held if at least ``coverage`` of its windows, or ``run_windows`` of them, are in the
    document: with the same words (kind same), or with consistently replaced ones (kind template). For a
    template only the windows that such a text still has count, and any occurrence will do: windows of one shift between document and item, those of
    neighbouring shifts (values of more or fewer words), or all of the document's. Items of fewer than
    WINDOW words are one window, looked up at every place of a document.
    Items of equal text count as the one with the smallest id. Null and empty texts hold nothing. Rows of
    one doc_id are one document: it holds what any of its texts holds, and windows of all of them count
    together. Rows of a null id are left out. Either table may be empty; other columns are ignored.
    """
    items = benchmark.where("text is not null and item_id is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    marks = cut(windows(items, "item_id").select(F.col("id").alias("item_id"), "h", F.col("pos").alias("item_pos"), "able", F.col("slots").alias("item_slots")), "marks")
    total = marks.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows"), F.countDistinct(F.when(F.col("able"), F.col("item_pos"))).alias("able_windows"))
    found = windows(docs, "doc_id", bitmap(marks), [*short_lengths(items), WINDOW]).select(F.col("id").alias("doc_id"), "h", "pos", "plain", "slots")
    hits = cut(found.join(marks, "h").select("doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "plain", "able", "slots", "item_slots"), "hits")
    per = hits.groupBy("doc_id", "item_id", "item_pos").agg(F.max(F.col("plain").cast("int")).alias("same"), F.max(F.col("able").cast("int")).alias("able")).groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.sum("same").alias("same_windows"), F.sum("able").alias("able"))
    enough = lambda c, of="item_windows": (F.col(c) >= F.lit(coverage) * F.col(of)) | (F.col(c) >= run_windows)
    fair = lambda c, able: enough(c) | ((F.col(able) > 0) & enough(able, "able_windows"))
    got = per.join(total, "item_id")
    # Occurrences that may be templates: (0, 0) all of a document's windows, (1, band of shifts), (2, shift).
    pair = ["doc_id", "item_id"]
    open_ = hits.join(got.where(fair("windows", "able") & ~enough("same_windows")).select(*pair, "item_windows", "able_windows"), pair)
    by_shift = Window.partitionBy(*pair).orderBy("shift")
    bands = open_.select(*pair, "shift").distinct().withColumn("new", F.coalesce(F.col("shift") - F.lag("shift").over(by_shift) > GAP, F.lit(True))).select(*pair, "shift", F.sum(F.col("new").cast("long")).over(by_shift).alias("band"))
    place = lambda level, c: F.struct(F.lit(level).alias("level"), c.cast("long").alias("key"))
    own = [*pair, "at"]
    spots = open_.join(bands, [*pair, "shift"]).withColumn("at", F.explode(F.array(place(0, F.lit(0)), place(1, F.col("band")), place(2, F.col("shift")))))
    # Within an occurrence, one document value for an item value.
    pairs = spots.where(F.size("slots") > 0).select(*own, F.explode(F.arrays_zip("item_slots", "slots")).alias("p")).select(*own, F.col("p.item_slots").alias("x"), F.col("p.slots").alias("y")).distinct()
    torn = pairs.groupBy(*own, "x").agg(F.count("*").alias("n")).where("n > 1").select(*own).distinct()
    whole = spots.groupBy(*own, "item_windows", "able_windows").agg(F.countDistinct("item_pos").alias("n"), F.countDistinct(F.when(F.col("able"), F.col("item_pos"))).alias("n_able")).where(fair("n", "n_able")).join(torn, own, "left_anti").select(*pair, F.lit(True).alias("held")).distinct()
    kind = F.when(enough("same_windows"), "same").when(F.col("held"), "template")
    return got.join(whole, pair, "left").withColumn("kind", kind).where("kind is not null").select("doc_id", "item_id", "item_windows", "windows", "same_windows", "kind")
