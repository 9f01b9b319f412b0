"""Vectorised tokenising and hashing of Arrow string columns with numpy.

A word's hash is a polynomial over its bytes modulo 2**64, read off a running sum, so that hashing a
batch costs a few passes over its bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 21

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(int(_P), -1, 2**64))
_tables: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _tables or len(_tables["p"]) <= n:
        m = max(n + 1, CHUNK + 1)
        for name, base in (("p", _P), ("i", _P_INV)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["p"], _tables["i"]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo..hi`` of a string array at a time, about ``limit`` bytes each: (lo, hi, bytes, offsets).

    Null texts count as empty. A text longer than ``limit`` comes alone and whole.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document the index of its first word (one more at the end)."""
    n = len(data)
    full = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=full[1:-1])
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start = full[1:] & ~full[:-1]
    end = full[:-1] & ~full[1:]
    start[inner] |= full[inner + 1]
    end[inner] |= full[inner]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(s, offsets)


def running(data: np.ndarray) -> np.ndarray:
    """The running sum from which :func:`spans` reads hashes."""
    p, _ = _powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=out[1:])
    return out


def spans(run: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges s..e."""
    _, inv = _powers(len(run))
    return mix((run[e] - run[s]) * inv[s] + (e - s).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a document, with the index of each document's first one.

    A document of fewer words has its whole sequence as its only shingle, one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], np.uint64)
    doc = np.repeat(np.arange(len(n)), count)
    pos = first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    size = np.minimum(n, k)[doc]
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    out[:] = size.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    for j in range(k):
        part = mix(padded[pos + j] + U(0x9E3779B97F4A7C15 * (j + 1) % 2**64))
        if j:
            part = np.where(size > j, part, U(0))
        out += part
    return mix(out), at


def hash_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk and the index of each document's first word."""
    if lower:
        data = LOWER[data]
    s, e, first = words(data, offsets, space)
    return spans(running(data), s, e), first
