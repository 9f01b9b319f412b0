"""Packing by minimum bin slack: token pieces into windows, planned on the histogram of lengths.

1. Each text becomes ids and an end id. Whole windows of it are pieces of their own; the rest is one
   shorter piece.
2. Only the number of pieces of each length (at most ``window`` numbers) reaches the driver. There the
   longest remaining length opens a window, and a subset-sum search over a bitset finds the multiset of
   remaining lengths that fills it closest to capacity, backtracked to counts; the pattern is repeated
   as often as the counts allow.
3. What would leave slack in its window is cut into pieces of power-of-two lengths instead. In falling
   order those fill windows exactly, and the last window's parts are sequences of a power of two, which
   need no padding.
4. A piece's rank among those of its length gives its sequence and offset. Ranks come from counts per
   written part and length, so no length's pieces meet in one task.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import cut

WINDOW = 1024
#: Known words that one Python worker keeps, and the longest of them in bytes.
CACHE, LONGEST = 1_500_000, 64
# Fixed value: the word pattern of byte-level BPE.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: What makes a word depend on its neighbours: white space of any kind, or the special token's string.
_ODD = re.compile(r"[^\S \n]|<\|endoftext\|>")
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
#: Bytes that other white space begins with.
_RISK = np.zeros(256, bool)
_RISK[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _ranked(path: str, vocab: dict[str, int]):
    """The same vocabulary for a faster library, if its ids are in the order of its merges; else None.

    Byte-level tokens are spelled with one printable character per byte; bytes that are not printable
    take the characters from U+0100 on, in order.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    pre = model.get("pre_tokenizer") or {}
    merges = model["model"].get("merges") or []
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer")
    if not plain or ids != sorted(set(ids)) or -1 in ids:
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spell = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"] for t in model.get("added_tokens") or []}
    ranks = {bytes(spell[c] for c in t): i for t, i in vocab.items() if t not in special}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian 32-bit bytes, with a cache of words.

    A space or line end between two other characters always starts a new word of this tokenizer, so a word
    with its space or line end is encoded once, and a text's ids are gathered from its words' ids. Words are
    known by a 64-bit hash of their bytes. Texts with other white space, with words of more than LONGEST
    bytes, or with the special token's string, are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # Ids whose text begins with a space or line end: in a run of words each word has one, at its start.
        vocab = self.tok.get_vocab()
        self.fast = _ranked(path, vocab)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[:1] in "\u0120\u010a"]] = True
        self._clear()

    def _clear(self) -> None:
        """No known words: their sorted hashes, where their ids begin in the pool, and how many (-1: not to be cut out)."""
        self.keys, self.at, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words, each of which begins with its space or line end: many encoded as one text. Returns
        blocks of ids and of their numbers by word."""
        ids, many = [], []
        for lo in range(0, len(words), 2000):
            own = words[lo : lo + 2000]
            text = "".join(own)
            got = np.array(self.fast.encode_ordinary(text) if self.fast else self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[got])
            if len(at) == len(own):
                ids.append(got)
                many.append(np.diff(at, append=len(got)))
            else:
                each = self._ids(own)
                ids += each
                many.append(np.array([len(x) for x in each]))
        return ids, many

    def _learn(self, keys: np.ndarray, words: list[str], odd: list[bool]) -> None:
        """Add unknown words, each with its space or line end unless it opens a text; ``odd`` ones are not
        to be cut out of their texts."""
        inner = [w[0] in " \n" for w in words]
        groups = [[i for i, x in enumerate(odd) if not x and inner[i]], [i for i, x in enumerate(odd) if not x and not inner[i]], [i for i, x in enumerate(odd) if x]]
        ids, many = self._words([words[i] for i in groups[0]])
        heads = self._ids([words[i] for i in groups[1]])
        n = np.concatenate([*many, np.array([len(x) for x in heads], np.int64), np.zeros(len(groups[2]), np.int64)])
        at = len(self.pool) + np.cumsum(n) - n
        n[len(n) - len(groups[2]) :] = -1
        self.pool = np.concatenate([self.pool, *ids, *heads])
        every = np.concatenate([self.keys, keys[np.concatenate([np.array(g, np.int64) for g in groups])]])
        order = np.argsort(every, kind="stable")
        self.keys, self.at, self.many = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.many, n.astype(np.int32)])[order]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text in turn; null texts are empty."""
        for lo, hi, data, offsets in tx.chunks(texts):
            yield from self._chunk(data, offsets, hi - lo)

    def _chunk(self, data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[bytes]:
        gap = (data == 0x20) | (data == 0x0A)
        s, e, first = tx.words(data, offsets, _GAP)
        doc = np.repeat(np.arange(n), np.diff(first))
        opening = np.zeros(len(s), bool)
        opening[first[:-1][np.diff(first) > 0]] = True
        begin = np.where(opening, s, s - 1)
        # Texts whose spaces and line ends don't each stand between two words.
        size, gaps = np.diff(offsets), np.concatenate([[0], np.cumsum(gap)])
        whole = (gaps[offsets[1:]] - gaps[offsets[:-1]] != np.maximum(np.diff(first) - 1, 0)) | ((np.diff(first) == 0) & (size > 0))
        some = np.flatnonzero(np.diff(first) > 0)
        whole[some] |= s[first[:-1][some]] != offsets[:-1][some]
        whole[doc[e - begin > LONGEST]] = True
        use = ~whole[doc]
        begin, e, doc = begin[use], e[use], doc[use]
        key, spot, back = np.unique(tx.spans(tx.running(data), begin, e), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != key) if len(self.keys) else np.arange(len(key))
        raw = data.tobytes()
        if len(new):
            ranges = zip(begin[spot[new]].tolist(), e[spot[new]].tolist(), strict=True)
            words = [raw[i:j].decode("utf-8", "surrogatepass") for i, j in ranges]
            some_odd = _RISK[data].any() or b"<|endoftext|>" in raw
            self._learn(key[new], words, [_ODD.search(w) is not None for w in words] if some_odd else [False] * len(words))
            at = np.searchsorted(self.keys, key)
        start, many = self.at[at][back], self.many[at][back]
        whole[doc[many < 0]] = True
        many = np.maximum(many, 0)
        total = np.cumsum(many, dtype=np.int64)
        ids = self.pool[np.repeat(start - total + many, many) + np.arange(total[-1] if len(total) else 0)].tobytes()
        ends = np.concatenate([[0], total])[np.searchsorted(doc, np.arange(n + 1))] * 4
        odd = np.flatnonzero(whole).tolist()
        rest = dict(zip(odd, self._ids([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass") for i in odd]), strict=True))
        for i, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            yield rest[i].tobytes() if i in rest else ids[lo:hi]


def halves(length: int) -> list[int]:
    """The powers of two that add up to ``length``, falling."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


PIECES = "doc_id long, start long, length int, crc long, parts array<long>, doc_tokens long, part int, rank long"


def pieces(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Pieces of all texts, with the checksum of the whole and of its power-of-two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        part = TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        crc = zlib.crc32
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "start", "length", "crc", "parts", "doc_tokens", "part", "rank"]
        for b in batches:
            rows: list[tuple] = []
            for doc, got in zip(b.column(0).to_pylist(), enc.encode(b.column(1)), strict=True):
                got += b"\0\0\0\0"
                total = len(got) // 4
                for start in range(0, total, window):
                    own = got[4 * start : 4 * (start + window)]
                    length, at, parts = len(own) // 4, 0, []
                    for p in halves(length) if length < window else ():
                        parts.append(crc(own[at : at + 4 * p]))
                        at += 4 * p
                    rows.append((doc, start, length, crc(own), parts, total, part, seen[length]))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within ``counts`` whose sum is closest to ``room`` from below.

    Subset sums are bits of one integer; after each length (longest first) the bitset is kept, and the
    best sum is traced back through them.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        before = reach
        left, unit = min(counts[length], room // length), 1
        while left:
            take = min(unit, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            unit *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            total -= length
            out[length] = out.get(length, 0) + 1
    return out


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Patterns (length -> number in one window) with how often each is used, all without slack, and the
    lengths that are left over."""
    left = {k: v for k, v in histogram.items() if v > 0}
    out, over = [], {}
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = {k: v for k, v in left.items() if v}
        pattern = fill(rest, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        if sum(k * v for k, v in pattern.items()) < window:
            over[longest] = left.pop(longest)
            continue
        times = min(left[k] // v for k, v in pattern.items())
        out.append((pattern, times))
        for k, v in pattern.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out, over


def placement(histogram: dict[int, int], window: int):
    """Where the piece of a length and rank goes: a function to [(part's start, part's length, sequence, offset)]."""
    patterns, over = plan(histogram, window)
    used: dict[int, list[tuple[int, int, int, int]]] = {}
    begun: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        at = 0
        for length in sorted(pattern, reverse=True):
            used.setdefault(length, []).append((begun.get(length, 0), pattern[length], sequence, at))
            begun[length] = begun.get(length, 0) + pattern[length] * times
            at += length * pattern[length]
        sequence += times
    # Power-of-two parts in falling order stand gapless in one line, cut into windows; the tail's binary
    # parts are sequences of their own.
    parts = {1 << b: sum(n for length, n in over.items() if length >> b & 1) for b in range(window.bit_length())}
    lines, total = {}, 0
    for size in sorted(parts, reverse=True):
        lines[size] = total
        total += size * parts[size]
    whole = total // window
    tails, at = [], whole * window
    for size in halves(total - at):
        tails.append(at)
        at += size
    prior = {size: {} for size in parts}
    for size in parts:
        n = 0
        for length in sorted(over):
            if length & size:
                prior[size][length] = n
                n += over[length]
    keys = {length: [x[0] for x in rows] for length, rows in used.items()}
    base = sequence

    def place(length: int, rank: int) -> list[tuple[int, int, int, int]]:
        if rank < begun.get(length, 0):
            first, many, seq, at = used[length][bisect.bisect_right(keys[length], rank) - 1]
            k = rank - first
            return [(0, length, seq + k // many, at + k % many * length)]
        rank -= begun.get(length, 0)
        out, start = [], 0
        for size in halves(length):
            spot = lines[size] + (prior[size][length] + rank) * size
            if spot < whole * window:
                out.append((start, size, base + spot // window, spot % window))
            else:
                k = bisect.bisect_right(tails, spot) - 1
                out.append((start, size, base + whole + k, spot - tails[k]))
            start += size
        return out

    return place


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pack all rows of ``docs(doc_id, text)`` into sequences of at most ``window`` (a power of two) ids.

    Null and empty texts are their end id alone. Repeated rows are packed each. Columns but those two are
    ignored. An empty table gives no rows. Sequences are full windows, but for at most one of each
    smaller power of two.
    """
    spark = docs.sparkSession
    p = cut(pieces(docs, path, window), "pieces")
    per = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    offsets = per.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {int(r["length"]): int(r["n"]) for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(histogram)  # at most ``window`` numbers
    ranked = p.join(offsets.select("part", "length", F.coalesce("base", F.lit(0)).alias("base")), ["part", "length"]).select("doc_id", "start", "length", "crc", "parts", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = placement(shared.value, window)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            rows = []
            for doc, start, length, crc, parts, total, rank in zip(*[c.to_pylist() for c in b.columns], strict=True):
                spots = place(length, rank)
                if len(spots) == 1:
                    rows.append((doc, start, length, crc, total, *spots[0][2:]))
                else:
                    rows += [(doc, start + at, size, own, total, seq, off) for (at, size, seq, off), own in zip(spots, parts, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
