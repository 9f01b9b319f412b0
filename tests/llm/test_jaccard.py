"""The similarity join against comparing all pairs."""

from __future__ import annotations

import random
import re

import pytest

from tessera.llm import jaccard
from tessera.llm.components import components
from tessera.llm.jaccard import jaccard_components


def brute(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed: int) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = r.choices(vocab, k=40)
    docs: list[str | None] = [None, "", "  \n", "one", "One", "one two", "a b c d", "A b\tc d"]
    for _ in range(14):
        base = r.choices(vocab, k=r.choice([6, 9, 13, 20, 60, 200, 500])) + (shared if r.random() < 0.5 else [])
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 8])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            docs.append(" ".join(copy[r.randint(0, 1) :]))
    r.shuffle(docs)
    return [(i * 7 % 1009, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_all_pairs(spark, seed, k, percent):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, key string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, k, percent).collect()}
    assert got == brute(docs, k, percent)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (3, 2)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_repeated_rows_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, 4, 85).collect())) == [(1, 3, 1), (2, 3, 1)]


def test_candidates_grow_with_the_rows(spark, monkeypatch):
    """Near copies just under the threshold, in families and in one family: twice the rows give about twice
    the pairs to verify, and no links."""
    real, seen = jaccard.verify, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(jaccard, "verify", counted)

    def family(r, first, n):
        base = [f"{first}w{r.randrange(10**6)}" for _ in range(100)]
        out = [" ".join(base)]
        for _ in range(n - 1):
            copy = list(base)
            for at in (r.randrange(10, 45), r.randrange(55, 90)):
                copy[at] = f"x{r.randrange(10**9)}"
            out.append(" ".join(copy))
        return out

    for families in (10, 1):
        found = []
        for n in (100, 200):
            r = random.Random(4)
            texts = [t for f in range(families * n // 100 if families > 1 else 1) for t in family(r, f, 10 if families > 1 else n)]
            seen.clear()
            got = jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85)
            assert got.where("component_id != doc_id").isEmpty()
            found.append(sum(seen))
        assert found[1] <= 3 * found[0] + 10, found
        assert found[1] <= 2 * 200, found


def test_very_long_texts(spark):
    """Texts of far more shingles than a count of a group can hold."""
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near, far = list(base), list(base)
    for i in range(0, 60_000, 60):
        near[i] = "n"
    for i in range(0, 60_000, 30):
        far[i] = "f"
    docs = [(5, " ".join(base)), (3, " ".join(near)), (4, " ".join(far)), (9, "same " * 100_000), (8, "same " * 50_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_components(df, 4, 85).collect()}
    assert got == brute(docs, 4, 85)
    assert got[5][1] == 3
