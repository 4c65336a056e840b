"""Toxicity: held-out accuracy, the risk estimator, defined cases."""

import random
import zlib

import numpy as np

from qforge.llm import toxicity as T
from qforge.llm import queries
from qforge.llm.common import table

SF = "/root/testdata/sf0.1"       # 825 held-out labels, 97 of them toxic


def corpus(n=1500):
    rnd = random.Random(10)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(rnd.random() < 0.15)
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(rnd.randint(2, 5) if toxic else 0):
            text[rnd.randrange(len(text))] = "vileword" + rnd.choice("xyz")
        rows.append((i, " ".join(text), "s", "mine"))
        if i % 2:
            labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy_and_cases(spark):
    rows, labels = corpus()
    edge = [(None, "vilewordx vilewordy " * 4, "s", "m"), (9001, None, None, None), (9002, "", "s", "m"), (3, rows[3][1], "s", "m"), (9003, "word " * 400_000, "s", "m")]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, source string, score string").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = T.toxicity_scores(docs, marks).collect()
    assert len(got) == len(rows) + len(edge)
    toxic = {i for i, (_, text, _, _) in enumerate(rows) if "vileword" in text}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
    right = sum((r.doc_id in toxic) == bool(r.predicted) for r in held)
    assert right >= 0.95 * len(held)
    empties = {r.score for r in got if r.text in (None, "")}
    assert len(empties) == 1 and empties.pop() < 0.5
    # without examples or rows
    assert {r.score for r in T.toxicity_scores(docs.limit(5), marks.limit(0)).collect()} == {0.0}
    assert T.toxicity_scores(docs.limit(0), marks).count() == 0


def test_features_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(11)
    text = " ".join("".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 9))) for _ in range(500)).encode()
    whole = set(T.features(text).tolist())
    monkeypatch.setattr(T, "PIECE", 200)
    pieces = set(T.features(text).tolist())
    assert pieces <= whole and len(whole - pieces) < 100         # only 4-grams over a cut are missing
    assert len(T.features(b"")) == 0


def test_threshold_of_the_risk():
    rnd = np.random.default_rng(12)
    p, u = rnd.normal(5, 0.5, 300), np.concatenate([rnd.normal(5, 0.5, 100), rnd.normal(0, 0.5, 900)])
    assert 1.5 < T.cut(p, u, 0.1) < 4
    assert T.cut(p, u, 0.2) > 1.5


def plain_slope(xp, xu, w, prior):
    """The risk's slope by differences of the risk itself."""
    def risks(w):
        zp, zu = xp @ w, xu @ w
        return prior * np.log1p(np.exp(-zp)).mean(), np.log1p(np.exp(zu)).mean() - prior * np.log1p(np.exp(zp)).mean()
    negative = risks(w)[1]
    value = (lambda v: sum(risks(v))) if negative >= 0 else (lambda v: -risks(v)[1])
    step = 1e-5
    return negative, np.array([(value(w + step * e) - value(w - step * e)) / (2 * step) for e in np.eye(len(w))])


def test_one_step_of_the_risk_and_the_non_negative_branch():
    rng = np.random.default_rng(3)
    xp, xu = (rng.random((50, 6)) < 0.4).astype(float), (rng.random((80, 6)) < 0.4).astype(float)
    seen = set()
    for w, prior in ((np.zeros(6), 0.1), (rng.normal(0, 1, 6), 0.3), (np.array([6., 5, 0, 0, 0, 1]), 0.5)):
        for a, b in ((xp, xu), (xp, np.zeros((80, 6)))):      # without unlabelled evidence the corrected risk turns negative
            b = b - 3 * (b.sum() == 0) * np.eye(6)[5]
            negative, want = plain_slope(a, b, w, prior)
            seen.add(negative >= 0)
            assert np.allclose(T.NnPu(prior).slope(a.astype(np.float32), b.astype(np.float32), w), want, atol=1e-5)
    assert seen == {True, False}


def test_screen_counts_places_in_spark(spark):
    texts = [("vile %d" % i if i < 20 else "kind %d" % i, int(i < 20), int(i >= 10)) for i in range(60)]
    frame = spark.createDataFrame([(t.encode(), p, u) for t, p, u in texts], "text binary, p int, u int").repartition(3)
    got = T.screen(frame, 20, 50, most=5)
    p, u = (np.zeros(1 << T.DIM_BITS) for _ in range(2))
    for t, a, b in texts:
        p[T.features(t.encode())] += a
        u[T.features(t.encode())] += b
    both = (p + u + 1) / 72
    z = np.where(p + u > 0, np.abs(p / 20 - u / 50) / np.sqrt(both * (1 - both) * (1 / 20 + 1 / 50)), 0)
    best = sorted(np.flatnonzero(z > 2), key=lambda i: (-round(z[i], 9), i))[:5]
    assert len(got) == 5 and sorted(round(z[i], 9) for i in got) == sorted(round(z[i], 9) for i in best)


def test_held_out_rows_of_the_given_table(spark):
    """Precision and recall on labelled rows that training never saw."""
    marks = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    held = [(marks[r.doc_id], r.predicted) for r in queries.op3(spark, SF).collect() if r.held_out and r.doc_id in marks]
    both = sum(t == p == 1 for t, p in held)
    assert len(held) > 500 and both >= 0.9 * sum(p for _, p in held) and both >= 0.8 * sum(t for t, _ in held)
