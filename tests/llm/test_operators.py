"""The other operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, fingerprint, license, lm, quality, sharding, toxicity, warc
from tessera.llm.shared import shared_dir

TEXTS = "doc_id long, text string"


def lowered(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# License scan.
def test_license(spark):
    texts = [
        None, "", "mit", "Under the MIT License. under the mit license", "CC BY-NC 4.0 cc by nc sa", "Licensed under the Apache License, Version 2.0!", "GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "all rights reserved " * 50, "apache license version 2 " * 3 + "x", "licensed under blue license", "ünder the mit license",
    ]
    rows = {r.doc_id: r for r in license.scan(spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], TEXTS + ", score double")).collect()}
    rules = license.rules()
    assert len(rules) > 200
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t or ""))
        at, base = [], set()
        for phrase, label in license.BASE.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    at.append(k)
                    base.add(label)
        spaced = "".join(f" {w} " for w in words)
        hits = sorted((m.start(), -m.end(), r["priority"], r["label"], r["strength"]) for r in rules if r["keyword"] in spaced for m in re.finditer(r["pattern"], spaced))
        end, kept, score = 0, set(), 0.9 if at else 0.0
        for h in hits:
            if -h[1] > end:
                end, score = -h[1], max(score, h[4])
                kept.add(h[3])
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r["labels"], r.score) == (",".join(sorted(base)), ",".join(sorted(base | kept)), score)


def test_every_rule_finds_its_own_wording(spark):
    """Each rule decides something: its own wording, spread over lines, gives its label."""
    rules = license.rules()
    assert len({r["pattern"] for r in rules}) == len(rules)
    texts = []
    for r in rules:
        phrase = re.sub(r"\(\?: \[\^ \]\+ \)\{0,\d+\}", "", r["pattern"])
        texts.append(re.sub(r" +", "\n", re.sub(r"\(\?: \(\?:([^()|]*)[^()]*\) \)\??", r"\1 ", phrase).replace("\\", "")))
    rows = {r.doc_id: r for r in license.scan(spark.createDataFrame(list(enumerate(texts)), TEXTS)).collect()}
    assert [(texts[r["priority"]], r["label"]) for r in rules if r["label"] not in rows[r["priority"]]["labels"].split(",")] == []


def test_license_repeated_rows_long_texts_and_empty_table(spark):
    long = "filler words " * 200_000 + "Crown Copyright" + " more of them" * 10
    docs = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "cc by nc"), (2, long)], TEXTS)
    rows = sorted(tuple(r) for r in license.scan(docs.drop("doc_id").withColumn("doc_id", F.lit(1))).collect())
    assert [r[1:] for r in rows[:3]] == [(3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.9)] * 3
    assert rows[3][1:] == (400_032, 0, None, None, "", "crown", 0.8)
    assert license.scan(docs.limit(0)).count() == 0


def test_every_rule_is_behind_an_anchor():
    for r in license.rules():
        phrase = re.sub(r"\(\?: \[\^ \]\+ \)\{0,\d+\}", "", r["pattern"])
        word = re.sub(r"\(\?: \(\?:([^()|]*)[^()]*\) \)\??", r"\1 ", phrase).replace("\\", "")
        gated = any(a in word for a in license.ANCHORS) or re.search(license.CC_ANCHOR, word)
        assert gated, (r["label"], word)


# Language model.
def test_language_model(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(50)]
    texts = [None, "", "w1 W1", "zzz w2"] + [" ".join(vocab[(j + i) % 50] if r.random() < 0.8 else r.choice(vocab) for j in range(r.randint(1, 60))) for i in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), TEXTS)
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    rows = {x.doc_id: x for x in lm.score(df, train, frequent=20).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lowered(t or "")), "\0"] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(x.score for x in rows.values()) > sum(x.base_score for x in rows.values())


def test_scores_against_plain_python(spark, monkeypatch):
    """Every score is the sum of its tokens' log probabilities, recomputed word by word from the network's
    parameters; the probabilities of all classes after any two, and of all words of an ending, sum to one."""
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(700)]
    texts = [None, "", "unseen W1 zzz"] + [" ".join(r.choices(vocab, [1 / (i + 1) for i in range(700)], k=r.randint(1, 90))) for _ in range(150)] + ["long " * 30_000]
    nets = []
    learn = lm.fit_counts
    monkeypatch.setattr(lm, "fit_counts", lambda *a: nets.append(learn(*a)) or nets[0])
    frequent = 230
    rows = {x.doc_id: x for x in lm.score(spark.createDataFrame(list(enumerate(texts)), TEXTS), F.col("doc_id") % 7 != 2, frequent=frequent).collect()}
    tokens = {i: [*lowered(t or "").split(), None] for i, t in enumerate(texts)}
    count = Counter(w for i, ws in tokens.items() if i % 7 != 2 for w in ws)

    def hashed(w):
        return int(lm.END if w is None else lm.tx.hash_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0])

    # Words with a class of their own: the most frequent, of those in whole classes of counts within the bound.
    level, room = Counter(math.floor(math.log2(n) * 8) for n in count.values()), frequent
    for lowest in sorted(level, reverse=True):
        if (room := room - level[lowest]) < 0:
            break
        least = lowest
    size = lm.own_words(len(count))
    known = sorted((-n, np.int64(np.uint64(hashed(w))), w) for w, n in count.items() if w is not None and math.floor(math.log2(n) * 8) >= least)
    own = {None: 0, **{w: i for i, (_, _, w) in enumerate(known[: size - 1], 1)}}
    assert len(count) > len(own) > 20

    def ending(w):
        last, before = w.encode()[-1], w.encode()[-2] if len(w) > 1 else 0
        return ((last * 257 + before) * 2654435761 % 2**32) >> 26

    rest, kinds = Counter(), Counter()
    for w, n in count.items():
        if w not in own:
            rest[ending(w)] += n
            kinds[ending(w)] += 1
    net = {k: v.astype(float) for k, v in nets[0].items()}

    def after(one, two):
        z = net["r"][one] @ net["m1"] @ net["q"].T + net["r"][two] @ net["m2"] @ net["q"].T + net["bias"]
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    for i, ws in tokens.items():
        one, two, total, seen = 0, 0, 0.0, {}
        for w in ws:
            c = own[w] if w in own else size + ending(w)
            if (one, two) not in seen:
                seen[one, two] = after(one, two)
            total += math.log10(seen[one, two][c]) + (0 if w in own else math.log10((count[w] + 1) / (rest[ending(w)] + kinds[ending(w)] + 1)))
            one, two = c, one
        assert rows[i].score == pytest.approx(total, rel=1e-4, abs=1e-3), i


def test_language_model_edges(spark):
    assert lm.score(spark.createDataFrame([], TEXTS), F.lit(True)).count() == 0
    row = lm.score(spark.createDataFrame([(1, "a b"), (1, "a b")], TEXTS), F.lit(False)).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens) for x in row] == [(3, 0, 0)] * 2


def test_class_table_is_normalised():
    net = lm.fit([np.array([1, 2, 3, 1, 2, 0] * 50)], 0, epochs=3)
    table = lm.log_table(net)
    assert np.allclose((10.0 ** table[:3].astype(float)).sum(2), 1, atol=1e-4)
    assert table[1, 0, 2] > table[1, 0, 3]


def test_network_learns_from_all_training_documents(spark):
    texts = [" ".join(["ping pong"] * 3) if i % 2 else "alpha beta gamma" for i in range(4200)]
    docs = spark.createDataFrame(list(enumerate(texts)), TEXTS).repartition(3)
    ids = {w: i for i, w in enumerate(["\0", "ping", "pong", "alpha", "beta", "gamma"])}
    own = np.array([lm.END, *lm.tx.hash_words(np.frombuffer(b"ping pong alpha beta gamma", np.uint8), np.array([0, 26]))[0]])
    size = lm.own_words(len(own))
    got = {r.cell: r.n for r in lm.class_counts(docs, own, size).collect()}
    want, k = Counter(), size + lm.ENDINGS
    for t in texts:
        c = [0, 0, *[ids[w] for w in t.split()], 0]
        want.update((c[i - 1] * k + c[i - 2]) * k + c[i] for i in range(2, len(c)))
    assert got == want
    # A word order that only documents beyond any first 4,000 by hash have shapes the scores.
    last = docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").toPandas()["doc_id"][4000:].tolist()
    texts = ["one two three four"] * 4200
    for i in last:
        texts[i] = "six seven " * 40
    more = [(9000, "six seven six seven six seven"), (9001, "six six seven seven six six")]
    df = spark.createDataFrame(list(enumerate(texts)) + more, TEXTS).repartition(3)
    rows = {r.doc_id: r for r in lm.score(df, F.col("doc_id") < 9000).where("doc_id >= 9000").collect()}
    assert rows[9000].score > rows[9001].score + 1


def test_own_words_grow_with_the_vocabulary():
    assert lm.own_words(0) == lm.own_words(1000) == lm.OWN
    assert lm.OWN < lm.own_words(10**7) < lm.own_words(10**9)


# Classifiers.
def _labelled(spark, bad: str):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(r.randint(5, 80))]
        good = i % 4 > 0
        if not good and bad == "toxic":
            words[r.randrange(len(words))] = r.choice(["vile", "scum", "foulest", "foully"])
        if not good and bad == "quality":
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en"))
        if i % 10 < 7:
            labels.append((i, int(good), int(not good)))
    docs += [(1000, None, None), (1001, "", "en")]
    labels += [(2000, None, None), (1, None, 0)]
    return spark.createDataFrame(docs, TEXTS + ", score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = _labelled(spark, "toxic")
    held = F.col("doc_id") % 5 == 0
    model = toxicity.learn(docs, labels, ~held)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scores) == 402
    right = [(scores[i] >= 0.5) == (i % 4 == 0) for i in range(0, 400, 5)]
    assert sum(right) / len(right) > 0.95
    assert scores[1000] == scores[1001] < 0.5
    nothing = toxicity.learn(docs, labels.where("false"), ~held)
    assert all(r.score < 0.5 for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_features_against_plain_python(spark):
    """Chosen features and scores recomputed in plain Python, and the same model from sums in Spark."""
    docs, labels = _labelled(spark, "toxic")
    held = F.col("doc_id") % 5 == 0
    docs = docs.select("doc_id", "text")
    docs = docs.union(docs.limit(3)).union(docs.selectExpr("doc_id", "repeat(coalesce(text, ''), 3000) text").limit(1)).union(docs.limit(1).selectExpr("cast(null as long)", "text"))
    model = toxicity.learn(docs, labels.union(labels.limit(5)), ~held)

    def own(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text or "").encode())
        return {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) >= n}

    def key(f):
        data = np.frombuffer(f[1], np.uint8)
        got = toxicity.tx.spans(toxicity.tx.running(data), np.array([0]), np.array([len(data)]))
        return int(got[0] ^ np.uint64(f[0] * 0x9E3779B97F4A7C15 % 2**64))

    toxic = {r.doc_id for r in labels.where(~held & (F.col("toxic") == 1)).collect()}
    rows = [r for r in docs.where(~held).collect() if r.doc_id is not None]
    sets = [own(r.text) for r in rows]
    pos = Counter(f for r, s in zip(rows, sets, strict=True) if r.doc_id in toxic for f in s)
    n_pos, every = sum(r.doc_id in toxic for r in rows), Counter(f for s in sets for f in s)
    share = labels.where(~held & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("t")).agg(F.avg("t")).first()[0]
    want = set()
    for f, c in pos.items():
        p, u = c / n_pos, every[f] / len(rows)
        if c >= 3 and p / (max(u - share * p, 0) / (1 - share) + 1 / len(rows)) >= 20:
            want.add(key(f))
    assert set(model.keys.tolist()) == want
    weight = dict(zip(model.keys.tolist(), model.weights, strict=True))
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(weight.get(key(f), 0.0) for f in own(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))
    # The sums of the risk by Spark jobs are those of the driver.
    rows = spark.createDataFrame([([0, 2], 3), ([], 5), ([1], 2)], "has array<int>, n long").repartition(2)
    w = np.array([0.5, -1.0, 2.0, 0.1])
    here, there = toxicity.Patterns([[0, 2], [], [1]], np.array([3, 5, 2])).negative(w), toxicity.Spread(rows).negative(w)
    assert there[0] == pytest.approx(here[0])
    assert there[1] == pytest.approx(here[1])
    assert sorted(zip(*toxicity.Spread(rows).values(w), strict=True)) == [(-0.9, 2), (0.1, 5), (2.6, 3)]
    loss = sum(n * math.log1p(math.exp(z)) for n, z in ((3, 2.6), (5, 0.1), (2, -0.9)))
    assert here[0] == pytest.approx(loss)


def test_quality(spark):
    docs, labels = _labelled(spark, "quality")
    held = F.col("doc_id") % 5 == 0
    rules = quality.learn(docs, labels, ~held)
    assert 0 < len(rules.rules)
    assert "upper" in str(rules) or "bang" in str(rules) or "mark" in str(rules)
    scores = {r.doc_id: r.score for r in quality.score(docs, rules).collect()}
    right = [(scores[i] >= 0.3) == (i % 4 > 0) for i in range(0, 400, 5)]
    assert sum(right) / len(right) > 0.95
    assert len(scores) == 402
    alone = quality.learn(docs, labels.where("quality = 1"), ~held)
    assert all(r.score > 0.5 for r in quality.score(docs, alone).collect())
    assert quality.score(docs.where("false"), rules).count() == 0


def test_quality_against_plain_python(spark):
    """Statistics recomputed in plain Python, and the compiled column against the rules themselves."""
    docs, labels = _labelled(spark, "quality")
    odd = [(3000, "One two two.\n\none  TWO | three!\nOne two two.\n", ""), (3001, " \n\t", ""), (3002, "\u00e9\u00c9 4,5 #x\r\n" * 20_000, ""), (None, "A a", ""), (3000, "twice", "")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rules = quality.learn(docs, labels.union(labels.limit(9)), F.col("doc_id") % 5 != 0)
    assert len(rules.rules) > 1
    share = lambda n, of: n / of if of else 0.0

    def measured(t):
        t = (t or "").encode()
        words, lines = re.findall(rb"[^\x20\x09-\x0D]+", t), [x for x in t.split(b"\n") if x]
        mark = lambda c: c < 128 and not chr(c).isalnum() and c not in b" \t\n\v\f\r"
        return [
            len(t), len(words), share(sum(map(len, words)), len(words)), share(sum(65 <= c < 91 for c in t), sum(chr(c).isalpha() for c in t if c < 128)),
            share(sum(48 <= c < 58 for c in t), len(t)), share(sum(map(mark, t)), len(t)), share(sum(chr(c) in "#$%&*+<=>@[]^_`{|}~\\/" for c in t), len(t)), share(t.count(b"|"), len(words)),
            share(t.count(b"!"), len(words)), share(sum(c in b" \t\n\v\f\r" for c in t), len(t)), share(sum(c > 127 for c in t), len(t)), share(sum(a == b for a, b in zip(words, words[1:], strict=False)), len(words)),
            share(len(set(words)), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(len(t), len(lines)), share(sum(mark(w[-1]) for w in words), len(words)), max(map(len, words), default=0),
        ]

    rows = quality.score(quality.stats(docs, "own"), rules, "got").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = measured(r.text)
        assert list(r.own) == pytest.approx(want), r.doc_id
        x = np.array([list(r.own)])
        z = rules.intercept + sum(w for rule, w in rules.rules if quality.holds(rule, x)[0] and all((x[0, j] > t) == up for j, up, t in rule))
        assert r.got == pytest.approx(1 / (1 + math.exp(-z)))


# WARC.
def test_warc(spark):
    pages = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "x\r\ny", ""), (9, "http://c", "WARC/1.0\r\n\r\n" * 9), (4, "http://d", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int").repartition(2)
    folder = shared_dir(spark, "warc")
    index = warc.normalise(warc.write(df, folder), folder)
    rows = {r.page_id: r for r in warc.read(index, folder).collect()}
    for page, _, html in pages:
        raw = (html or "").encode()
        first = min(p for p, _, h in pages if (h or "") == (html or ""))
        r = rows[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", first))
    system, _ = warc.file_system(folder)
    one = index.first()
    with system.open_input_file(one.path) as f:
        f.seek(one.offset)
        assert zlib.decompress(f.read(one.size), 31).startswith(b"WARC/1.0\r\n")
    assert {r.record_type for r in warc.round_trip(df, smallest=1_000_000_000).collect()} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_warc_repeated_and_missing_ids(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(warc, "BROADCAST_IDS", 0)
    monkeypatch.setattr(warc, "ARCHIVE", 1)
    pages = [(1, "u", "a"), (1, "u", "a"), (None, "u", "zz"), (2, "u", "a"), (None, "v", "a"), (None, "w", "only"), (None, "w", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(df).collect()), key=str)
    want = [(1, "response", None, 1), (1, "response", None, 1), (None, "response", None, 2), (2, "revisit", 1, 1), (None, "revisit", 1, 1), (None, "response", None, 4), (None, "response", None, 4)]
    assert got == sorted(want, key=str)


# Sharding.
def test_sharding(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50), None) for i in range(600)] + [(None, None, None)], "doc_id long, text string, level string").select("doc_id", "text").repartition(6)
    s = sharding.Shards(spark, shared_dir(spark, "shards"))
    assert s.version() == 0
    assert s.append(docs.where("doc_id < 300"), small=4_000) == 1
    v = s.append(docs.where("doc_id >= 300 or doc_id is null"), small=4_000)
    small = s.entries().count()
    new = s.compact(60_000)
    assert new == v + 1
    assert s.entries().count() < small
    assert s.read(docs.schema).count() == s.read(docs.schema, v).count() == 601
    assert s.read(docs.schema).select("doc_id", "text").exceptAll(docs).count() == 0
    with pytest.raises(Exception, match=r"(?i)exist"):
        s.commit(s.entries(), v)
    assert s.vacuum(v) > 0
    assert s.vacuum(v) >= 0
    assert s.read(docs.schema).count() == 601
    assert sharding.Shards(spark, shared_dir(spark, "shards")).compact() == 0


def test_sharding_clashing_columns_and_drafts(spark):
    docs = spark.createDataFrame([(i, "x", "mine", 7) for i in range(20)], "doc_id long, text string, level string, SHARD_ROWS int")
    s = sharding.Shards(spark, shared_dir(spark, "shards"))
    s.append(docs)
    # What a writer leaves that stops before its commit is no version.
    fs, path = s._hadoop("draft-lost")
    fs.create(path, False).close()
    assert s.version() == 1
    got = s.read(docs.schema)
    assert got.columns == ["doc_id", "text", "level", "SHARD_ROWS", "shard_path", "shard_rows_", "level_", "row_in_shard"]
    assert {tuple(r) for r in got.select("level", "SHARD_ROWS", "level_").collect()} == {("mine", 7, 0)}
    assert s.append(docs) == 2
    assert s.read(docs.schema).count() == 40


# Fingerprints.
def test_fingerprints(spark):
    texts = [None, "", "a", "One two. Three four.\nFive six! " * 30, "One two. Three four.\nFive six! " * 30, "é x\n" * 400, "q " * 700, "Other. Things. Here."]
    docs = sorted(((i * 10, t) for i, t in enumerate(texts)), reverse=True)
    rows = {r.doc_id: r for r in fingerprint.versions(spark.createDataFrame([(i, t, 1) for i, t in docs], TEXTS + ", n_chars int").repartition(3)).collect()}
    share = lambda a, b: (len(a & b) / len(a | b)) if a | b else 1.0
    keys = lambda t: set(fingerprint.paragraphs([t])[0].tolist())
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(share(keys(t), keys(edited)))
        assert r.near_next == pytest.approx(share(keys(t), keys(after)))
    assert rows[30].fingerprint == rows[40].fingerprint
    assert fingerprint.versions(spark.createDataFrame([], TEXTS)).count() == 0


@pytest.mark.parametrize("docs", [[(None, "a"), (None, "b"), (3, "c"), (3, "c")], [(None, "xyz"), (None, "abc")], [(i // 3, f"t{i} " * (i + 1)) for i in range(60)] + [(None, "n" * 9)] * 3])
def test_fingerprints_of_repeated_and_missing_ids(spark, docs):
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(t) // 3
        want.append((i, len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()))
    got = fingerprint.versions(spark.createDataFrame(docs, TEXTS).repartition(3))
    assert sorted(map(tuple, got.select("doc_id", "n_chars", "edited_sha256").collect()), key=str) == sorted(want, key=str)


def test_range_numbers(spark):
    cuts = sorted({random.Random(2).randrange(500) for _ in range(90)}, reverse=True)
    got = spark.range(500).select("id", fingerprint._above(cuts, F.col("id")).alias("n")).collect()
    assert [r.n for r in got] == [sum(c > r.id for c in cuts) for r in got]


def test_peeling_recovers_digests():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 500, dtype=np.uint64)
    for differ in (0, 1, 5, 40, 400):
        b = np.concatenate([a[differ:], rng.integers(1, 2**63, differ, dtype=np.uint64)])
        row, key, side = fingerprint.difference((a, np.array([0, len(a)])), (b, np.array([0, len(b)])))
        assert set(key[side > 0].tolist()) == set(a[:differ].tolist())
        assert set(key[side < 0].tolist()) == set(b[len(b) - differ :].tolist())
        assert set(row.tolist()) <= {0}


# Decontamination.
def test_decontamination(spark):
    item = "If Jim has 30 apples and gives 7 kg of apples to Lisa then how many apples are left for Jim today"
    plain = "the quick brown fox jumps over the lazy dog while seven wise owls look on in silence"
    bench = spark.createDataFrame([(1, item), (2, plain), (3, None), (4, ""), (5, plain)], "item_id long, text string")
    docs = [
        (10, "Before. " + item.replace("Jim", "Tom").replace("30", "12").replace("Lisa", "Eve") + " after."),
        (11, item.replace("for Jim", "for Bob").replace("has 30", "has 30").replace("Jim has", "Ann has")),
        (12, "x y " + plain.upper() + " z"),
        (13, plain[:40]),
        (14, None),
        (15, ""),
        (16, "an unrelated text about 30 apples and Jim and Lisa who are here today"),
        (17, plain + " " + plain),
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], TEXTS + ", kind string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(df, bench).collect()}
    assert got[10, 1] == "template"
    assert got[12, 2] == "same"
    assert got[17, 2] == "same"
    assert {d for d, _ in got} <= {10, 11, 12, 17}
    assert (11, 1) not in got or got[11, 1] == "same"
    assert decontaminate.contaminated(df.where("false"), bench).count() == 0
    assert decontaminate.contaminated(df, bench.where("false")).count() == 0


ITEM = "If Jim has 30 apples and gives 7 kg of apples to Lisa then how many apples are left for Jim today"


def _kinds(spark, docs: list[str], bench: list[str]) -> dict:
    table = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(table(docs, "doc_id"), table(bench, "item_id")).collect()}


def test_templates_are_judged_by_occurrence(spark):
    new = lambda jim, a, b, lisa: ITEM.replace("Jim", jim).replace("30", a).replace("7", b).replace("Lisa", lisa)
    twice = "First the red team counts 4 red and 5 blue stones by hand. Then the red team counts 6 red and 8 blue stones by hand"
    docs = [
        new("Tom", "12", "5", "Eve") + ". Next question. " + new("Bob", "44", "9", "Ann"),
        new("Tom", "12", "5", "Eve") + ". Some words between them. As said, Jim has 30 apples and gives 7 kg of apples",
        new("Tom", "12", "12", "Eve"),
        twice.replace("4", "14").replace("5", "15").replace("6", "16").replace("8", "18"),
        new("Tom", "12", "5", "Eve").replace("kg of", "kg of red"),
        new("Tom", "12", "5", "Eve").replace("for Tom", "for Bob"),
    ]
    got = _kinds(spark, docs, [ITEM, twice])
    assert got == {(0, 0): "template", (1, 0): "template", (2, 0): "template", (3, 1): "template", (4, 0): "template"}


def test_short_and_number_dense_items(spark):
    short, asked = "why do wise owls look so calm", "how many days does Jim stay"
    dense = "Add 3 4 5 6 7 8 9 2 to 11 12 13 14 15 16 17 18 and tell me the sum of all these numbers in order"
    docs = [
        "a page. " + short.upper() + "? and many more words behind the question here",
        "Some words stand before it all: " + asked.replace("Jim", "Tom") + " and others behind it too",
        short,
        "why do wise owls look so very calm in the night of the day",
        dense.translate(str.maketrans("123456789", "234567891")),
    ]
    assert _kinds(spark, docs, [short, asked, dense]) == {(0, 0): "same", (1, 1): "template", (2, 0): "same", (4, 2): "template"}


def test_decontamination_of_repeated_and_missing_ids_and_long_texts(spark):
    """Rows of one doc_id are one document, as if their texts stood in one; rows without an id are left out."""
    plain = "the quick brown fox jumps over the lazy dog while seven wise owls look on in silence"
    bench = spark.createDataFrame([(1, plain), (1, plain), (None, "another question that has eight words or more in it")], "item_id long, text string")
    far = "filler words " * 150_000 + plain + " more of them" * 10
    docs = [(1, far), (1, far), (2, "nothing of it"), (2, f"a page with {plain}"), (None, plain), (3, "another question that has eight words or more in it")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], TEXTS + ", windows int, h string")
    got = decontaminate.contaminated(df, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.windows, r.same_windows, r.kind) for r in got) == [(1, 1, 10, 10, "same"), (2, 1, 10, 10, "same")]


def test_ids_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    from tessera.llm import shared

    rows, ids = spark.range(20).toDF("doc_id"), spark.range(5).toDF("doc_id")
    for bound in (2, 100):
        monkeypatch.setattr(shared, "BROADCAST_IDS", bound)
        assert shared.semi_by_id(rows, ids, "doc_id").count() == 5
        assert shared.semi_by_id(rows, ids, "doc_id", "left_anti").count() == 15
