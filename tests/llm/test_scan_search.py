"""License scan, periodic runs and ranked lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from qforge.llm import k2_treap, license_scan, queries, runs
from qforge.llm.common import Scratch, table
from qforge.llm.license_rules import BASE, rules
from tests.conftest import SF001, SF01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clean_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


# ---- license scan


def test_rules_are_many_and_gated():
    every = rules()
    assert len(every) >= 250 and len({(r.label, r.pattern.pattern) for r in every}) == len(every)
    assert all("," not in r.label for r in every)


def test_every_match_holds_the_keyword():
    for rule in rules():
        plain = rule.pattern.pattern.removeprefix("(?<= )").removesuffix("(?= )").replace(r"\S", "[a-z0-9]").replace(".{", "[a-z ]{")

        @settings(max_examples=4, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(plain, fullmatch=True))
        def holds(found):
            assert rule.keyword in found, rule.label
        holds()


def scan_plainly(text):
    """Every rule over the text, no gate; suppression pair by pair."""
    words = clean_words(text)
    line, found = " " + " ".join(words) + " " if words else " ", []
    for k, rule in enumerate(rules()):
        for m in rule.pattern.finditer(line):
            found.append((line[:m.start()].count(" ") - 1, line[:m.end()].count(" "), k, rule))
    found.sort(key=lambda d: (-d[3].priority, d[0] - d[1], d[0], d[2]))
    kept = []
    for d in found:
        if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
            kept.append(d)
    base = [(i, label) for phrase, label in BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.split()]
    base_labels = sorted({label for _, label in base})
    return (len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
            ",".join(base_labels), ",".join(sorted(set(base_labels) | {d[3].label for d in kept})),
            max((d[3].confidence for d in kept), default=0.0)), sorted((d[0], d[1], d[3].label) for d in kept)


def license_texts():
    rnd = random.Random(3)
    pieces = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "cc-by", "CC BY-NC 4.0",
              "Released under the MIT license", "SPDX-License-Identifier: GPL-2.0-or-later", "all rights reserved", "BSD 3-Clause License",
              "GNU Lesser General Public License v2.1", "Apache License", "MIT", "license", "cc", "by", "GPLv3", "naïve", "ＣＣ by",
              "https://creativecommons.org/licenses/by-sa/4.0/", "public domain", "Redistribution and use in source and binary forms, with or "
              "without modification, are permitted provided that the following conditions are met:", "mit_license", "cc\nby", "é cc by é"]
    texts = [" ".join(rnd.choice(pieces + ["alpha", "beta"]) for _ in range(rnd.randint(0, 25))) for _ in range(120)]
    return texts + pieces + [None, "", " \n", "cc by " * 3000, "x" * 100_000 + " cc by", "\x00cc\x7fby\x00"]


def test_license_scan_equals_plain_scan(spark):
    texts = license_texts()
    frame = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)] + [(None, "cc by", "own")], "doc_id long, text string, licenses string")
    got = {r.doc_id: r.licenses for r in license_scan.scan_licenses(frame).collect()}
    assert len(got) == len(texts) + 1 and got[None].n_base == 1
    for i, text in enumerate(texts):
        r = got[i]
        row, kept = scan_plainly(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), r.score) == row, text
        assert sorted((d.start, d.stop, d.label) for d in r.detections) == kept, text
    assert license_scan.scan_licenses(frame.limit(0)).count() == 0


def test_op11_on_the_given_table(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11(spark, SF01).collect()}
    docs = table(spark, SF01, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    for d in docs:
        assert got[d.doc_id] == scan_plainly(d.text)[0], d.doc_id


# ---- periodic runs


def plain_runs(s):
    least = {}
    for q in range(1, len(s) // 3 + 1):
        i = 0
        while i < len(s) - q:
            j = i
            while j < len(s) - q and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in least.items())


def word_sequences(rnd):
    a, n = rnd.choice([1, 2, 2, 3, 5, 50]), rnd.randint(0, 400)
    kind, out = rnd.random(), []
    if kind < .3:
        return [rnd.randrange(a) for _ in range(n)]
    if kind < .45:                                            # Fibonacci words: many close periods
        old, new = [0], [0, 1]
        while len(new) < n + 1:
            old, new = new, new + old
        return new[:n] * rnd.choice([1, 3])
    while len(out) < n:
        root = [rnd.randrange(a) for _ in range(rnd.randint(1, rnd.choice([3, 10, 40, 130])))]
        if rnd.random() < .4:                                 # a root that is itself mostly periodic
            root = [rnd.randrange(a) for _ in range(rnd.randint(1, 4))] * rnd.randint(3, 20) + root
        out += root * rnd.randint(1, 8) + root[:rnd.randint(0, len(root))] + [99] * rnd.randint(0, 1)
    return out


def test_runs_equal_brute_force():
    rnd = random.Random(8)
    found = 0
    for _ in range(150):
        texts = [word_sequences(rnd) for _ in range(rnd.randint(1, 8))]
        got = runs.search_texts([[b"%d" % w for w in s] for s in texts])
        for s, own in zip(texts, got):
            assert own == plain_runs(s), s
            found += len(own)
    assert found > 1000
    assert runs.search_texts([]) == [] and runs.search_texts([[]]) == [[]]


def test_wavelet_tree():
    rnd = np.random.default_rng(2)
    values = rnd.integers(0, 500, 300)
    tree = runs.WaveletTree(values, 9)
    lo = rnd.integers(0, 300, 200)
    hi = np.array([rnd.integers(a, 301) for a in lo])
    x = rnd.integers(0, 511, 200)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(lo, hi, x)]
    on = hi > lo
    k = np.array([rnd.integers(0, b - a) for a, b in zip(lo[on], hi[on])])
    assert tree.smallest(lo[on], hi[on], k).tolist() == [int(np.sort(values[a:b])[t]) for a, b, t in zip(lo[on], hi[on], k)]


def made_periodic(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_row(words):
    found = plain_runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12(spark, SF001).collect()}
    docs = table(spark, SF001, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r[0] > 0 for r in got.values()) > 5
    short = 0
    for d in docs:
        words = made_periodic(d.doc_id, re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        if len(words) <= 1500:
            short += 1
            assert got[d.doc_id] == periodic_row(words), d.doc_id
    assert short > 100


def test_periodic_runs_of_any_text(spark):
    texts = [None, "", " \n", "a", "a " * 24, "a b " * 50_000, "x " * 23, "é è " * 40, "a " * 30 + "b " * 30, "one word " * 30]
    frame = spark.createDataFrame([(1, t, 5) for t in texts], "doc_id long, text string, periodic int")
    got = [r.periodic for r in runs.periodic_runs(frame.coalesce(1)).collect()]
    assert [[tuple(x) for x in r.runs] for r in got] == [[], [], [], [], [(0, 24, 1)], [(0, 100_000, 2)], [], [(0, 80, 2)],
                                                        [(0, 30, 1), (30, 30, 1)], [(0, 30, 1)]]
    assert [bytes(r.collapsed).decode() for r in got] == ["", "", "", "a", "a", "a b", " ".join("x" * 23), "é è", "a b", "one word"]
    assert runs.periodic_runs(frame.limit(0)).count() == 0


# ---- ranked search


def plain_search(docs, items, k):
    words = [(d, clean_words(t)) for d, t in docs]
    sizes = [len(w) for _, w in words]
    n, total = sum(x > 0 for x in sizes), sum(sizes)
    out = []
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        terms = [t for t in set(clean_words(text)) if t in df]
        scored = []
        for place, (doc, w) in enumerate(words):
            m = 50 + (50 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * w.count(t)) // (1000 * w.count(t) + 20 * m))
                        for t in terms if t in w)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, rank, s[4], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return out


def test_treap_search_equals_scores():
    rnd = np.random.default_rng(4)
    for shape in ((1, 1), (7, 300), (300, 7), (90, 90)):
        grid = rnd.integers(1, 50, shape) * (rnd.random(shape) < 0.2)
        rows, cols = np.nonzero(grid)
        treap = k2_treap.Treap(rows, cols, grid[rows, cols])
        for _ in range(30):
            own = rnd.permutation(shape[0])[:rnd.integers(1, 12)]
            w = rnd.integers(1, 9, len(own))
            scores = w @ grid[own]
            k = int(rnd.integers(1, 15))
            col, score, floor = treap.search(own, w, k, 0)
            assert (scores[col] == score).all() and len(set(col.tolist())) == len(col)
            least = max(1, np.sort(scores)[::-1][k - 1] if k <= len(scores) else 1)
            assert set(col.tolist()) == set(np.flatnonzero(scores >= least).tolist()) and floor == least
    assert len(k2_treap.Treap(np.empty(0, int), np.empty(0, int), np.empty(0, int)).search(np.array([0]), np.array([1]), 3, 0)[0]) == 0


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = ["w%d" % min(int(rnd.expovariate(0.05)), 400) for _ in range(3000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(400)]
    docs = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (500, None), (501, ""), (502, "É w1 W1-w2")]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30)))) for i in range(25)] + [(None, "w1"), (3, "w2 w3"), (99, None), (98, "nowhere")]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, block int, terms int").coalesce(1)
    asked = spark.createDataFrame([(d, t, 1) for d, t in items], "item_id long, text string, rank int").coalesce(1)
    frame.cache().count()

    def run(docs_, items_):
        index = k2_treap.index_documents(docs_, Scratch(spark, "t").path("index"))
        return [tuple(r) for r in k2_treap.search(index, items_, k=5).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    want = sorted(plain_search(docs, items, 5), key=key)
    assert sorted(run(frame, asked), key=key) == want            # one pack, sent to all tasks
    monkeypatch.setattr(k2_treap, "PACK", 60)
    assert sorted(run(frame, asked), key=key) == want            # several packs, joined
    assert run(frame.limit(0), asked) == [] and run(frame, asked.limit(0)) == []
    assert run(frame.where("text is null"), asked) == []


def test_op13_on_the_given_table(spark):
    got = sorted(tuple(r) for r in queries.op13(spark, SF001).collect())
    docs, items = (table(spark, SF001, t).select(i, "text").collect() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == sorted(plain_search([tuple(r) for r in docs], [tuple(r) for r in items], 50))


def test_blocks_are_bounded(monkeypatch):
    monkeypatch.setattr(k2_treap, "DOCS", 3)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(range(8)), pa.array([b"a b a"] * 8)], names=["row", "doc_id", "text"])
    out = pd.concat([b.to_pandas() for b in k2_treap._blocks(iter([batch]))])
    assert [len(x) for x in out.doc_ids] == [3, 3, 2] and out.n_terms.tolist() == [9, 9, 6]
