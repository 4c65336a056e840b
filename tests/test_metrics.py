"""ROUGE, LCS, embedding score and reward: goldens and Python differentials."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qforge.functions.arrays import clipped_overlap
from qforge.functions.lcs import lcs_len
from qforge.operators import reward as RW
from qforge.operators.bertscore import bertscore
from qforge.operators.rouge import rouge_scores, with_tokens


def scores(spark, pairs, metrics):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)],
                               "id int, prediction string, reference string")
    return {r["id"]: r for r in rouge_scores(df, ["id"], metrics=metrics).collect()}


def test_rouge_goldens(spark):
    s = scores(spark, [("the cat sat", "the cat sat down"),
                       ("hello there mate whats up", "hello thereffwe")],
               ("rouge1", "rouge2", "rougeL", "rougeLsum"))
    assert s[0]["rouge1_f"] == 0.857143 and s[0]["rouge1_p"] == 1.0 and s[0]["rouge1_r"] == 0.75
    assert s[0]["rouge2_f"] == 0.8 and s[0]["rouge2_r"] == 0.666667
    assert s[0]["rougeL_f"] == 0.857143
    assert s[0]["rougeLsum_f"] == s[0]["rougeL_f"]          # one line: Lsum equals L
    assert s[1]["rouge1_f"] == 0.285714


def test_empty_sides(spark):
    s = scores(spark, [("", "a b"), ("a b", ""), ("", "")], ("rouge1", "rougeL", "rougeS"))
    for r in s.values():
        assert r["rouge1_f"] == 0.0 and r["rougeL_f"] == 0.0 and r["rougeS_f"] == 0.0


def _lcs_spark(spark, pairs):
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)],
                               "id int, prediction string, reference string")
    from qforge.operators.rouge import lcs_stage
    out = lcs_stage(with_tokens(df)).select("id", "_lcs").collect()
    return {r["id"]: r["_lcs"] for r in out}


def test_lcs_differential(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "e"]
    pairs = [(["the", "cat", "sat", "on", "the", "mat"], ["the", "mat", "sat", "on", "a", "cat"])]
    for _ in range(60):
        n, m = rng.randint(0, 80), rng.randint(0, 40)   # crosses the 62-token native limit
        pairs.append(([rng.choice(vocab) for _ in range(n)], [rng.choice(vocab) for _ in range(m)]))
    got = _lcs_spark(spark, pairs)
    assert got[0] == 3
    for i, (a, b) in enumerate(pairs):
        assert got[i] == lcs_len(b, a), (a, b)


def test_rouge_n_differential(spark):
    from collections import Counter
    rng = random.Random(11)
    vocab = ["x", "y", "z", "w"]
    pairs = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 15))),
              " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 15)))) for _ in range(80)]
    s = scores(spark, pairs, ("rouge2", "rougeS"))

    def py(p, r, grams):
        gp, gr = Counter(grams(p.split())), Counter(grams(r.split()))
        o = sum(min(c, gp[g]) for g, c in gr.items())
        P, R = o / max(sum(gp.values()), 1), o / max(sum(gr.values()), 1)
        return round(2 * P * R / (P + R), 6) if P + R > 0 else 0.0

    def bi(t):
        return [(t[i], t[i + 1]) for i in range(len(t) - 1)]

    def skip(t):
        return [(t[i], t[j]) for i in range(len(t)) for j in range(i + 1, len(t))]

    for i, (p, r) in enumerate(pairs):
        assert s[i]["rouge2_f"] == py(p, r, bi)
        assert s[i]["rougeS_f"] == py(p, r, skip)


def plain_bertscore(pred, ref, table):
    def unit(v):
        v = np.array(v) / max(np.abs(v).max(), 1e-320)
        return v / max(np.linalg.norm(v), 1e-320)
    ps, rs = ([unit(table[t]) for t in side.split() if t in table] for side in (pred, ref))
    if not ps or not rs:
        return 0.0, 0.0, 0.0
    sim = np.array([[float(a @ b) for b in rs] for a in ps])
    p, r = sim.max(1).mean(), sim.max(0).mean()
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


@pytest.mark.parametrize("strategy", ["broadcast", "join"])
def test_bertscore_by_token(spark, strategy):
    """Tokens are the keys; unknown tokens, bad vectors and zero vectors have
    one meaning in both plans."""
    rng = np.random.default_rng(3)
    table = {f"w{7 * i}": [float(x) for x in rng.normal(size=8)] for i in range(40)}          # sparse numbers in the names
    table |= {"zero": [0.0] * 8, "tiny": [1e-200] * 8, "huge": [1e300] + [1e250] * 7}
    bad = [("null", None), ("part", [1.0, None] * 4), ("nan", [float("nan")] * 8), ("empty", []), (None, [1.0] * 8), ("w0", [9.0] * 8)]
    vt = spark.createDataFrame([*table.items(), *bad], "token string, vec array<double>")
    table["w0"] = min(table["w0"], [9.0] * 8)
    names = [*table, "null", "part", "nan", "empty", "never"]
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(names, k=rnd.randint(0, 30))), " ".join(rnd.choices(names, k=rnd.randint(0, 30)))) for i in range(60)]
    rows += [(100, "w7 w14", "w7 w14"), (101, "zero", "zero"), (102, "tiny", "tiny"), (103, "huge huge", "huge"), (104, "", ""),
             (105, "never", "w7"), (106, "w7 w7 w7 w14", "w7 w21")]
    df = with_tokens(spark.createDataFrame(rows, "id int, prediction string, reference string")).withColumn("_0", F.lit("kept"))
    got = {r["id"]: r for r in bertscore(df, ["id"], vt, strategy=strategy, ndigits=None, passthrough=["reference"]).collect()}
    assert len(got) == len(rows)
    for i, pred, ref in rows:
        want = plain_bertscore(pred, ref, table)
        assert np.allclose((got[i]["bert_p"], got[i]["bert_r"], got[i]["bert_f"]), want, atol=1e-12), (pred, ref)
        assert got[i]["reference"] == ref
    assert got[100]["bert_f"] == pytest.approx(1) and got[101]["bert_f"] == 0 and got[102]["bert_f"] == pytest.approx(1)


def test_vectors_are_sent_once_a_pack(spark, monkeypatch):
    """Rows of several packs, equal keys and absent lists: as by broadcast; the
    join sends a vector a pack and not a vector a row."""
    from qforge.operators import bertscore as B
    from tests.test_plans import _plan
    vt = spark.createDataFrame([(f"t{i}", [1.0, float(i)]) for i in range(10)], "token string, vec array<double>")
    rows = [(i // 3, "m", [f"t{(i + k) % 12}" for k in range(i % 5)], [f"t{k}" for k in range(i % 4)] + [None]) for i in range(90)]
    rows += [(None, "m", ["t1"], ["t2", "t3"]), (7, None, None, ["t1"]), (8, "x", [], None)]
    df = spark.createDataFrame(rows, "id int, model string, pred_tokens array<string>, ref_tokens array<string>")

    def scores(**kw):
        out = B.bertscore(df, ["id", "model"], vt, passthrough=["pred_tokens"], ndigits=9, **kw)
        return out, sorted(map(repr, out.collect()))
    want = scores(strategy="broadcast")[1]
    assert scores(strategy="join", near=["id"])[1] == want
    monkeypatch.setattr(B, "PACK_ROWS", 16)
    out, got = scores(strategy="join")
    assert got == want
    plan = _plan(out)
    assert "CoGroups" in plan and "collect_list" not in plan


def test_lcs_of_any_length(spark):
    """Bit vectors of several limbs: carries, limb edges, long rows."""
    rng = random.Random(9)
    pairs = [(["a"] * n, ["a"] * m) for n in (1, 61, 62, 63, 124, 125, 200) for m in (1, 62, 130)]
    pairs += [([rng.choice("abcd") for _ in range(rng.randint(50, 300))], [rng.choice("abcde") for _ in range(rng.randint(0, 300))]) for _ in range(25)]
    pairs += [([f"t{rng.randrange(400)}" for _ in range(900)], [f"t{rng.randrange(400)}" for _ in range(800)])]
    got = _lcs_spark(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert got[i] == lcs_len(b, a), (len(a), len(b))


def test_overlap_is_linear_and_exact(spark):
    rng = random.Random(4)
    pairs = [([rng.choice(["a", "b", "a b", "", "c#1"]) for _ in range(rng.randint(0, 40))] for _ in range(2)) for _ in range(60)]
    pairs = [(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)] + [(1000, ["x"] * 30_000, ["x"] * 20_000 + ["y"] * 9)]
    df = spark.createDataFrame(pairs, "id int, p array<string>, r array<string>")
    got = {r.id: r.o for r in df.select("id", clipped_overlap("p", "r").alias("o")).collect()}
    assert got == {i: sum((Counter(a) & Counter(b)).values()) for i, a, b in pairs}


def test_skip_overlap_of_long_texts():
    from qforge.operators.rouge import skip_overlap
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))] for _ in range(2))
        def count(t):
            return Counter((t[i], t[j]) for i in range(len(t)) for j in range(i + 1, len(t)))
        assert skip_overlap(a, b) == sum((count(a) & count(b)).values())
    n = 20_000                                    # distinct tokens: a square of them would take gigabytes
    import tracemalloc
    tracemalloc.start()
    assert skip_overlap([str(i) for i in range(n)], [str(i) for i in range(n)]) == n * (n - 1) // 2
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("f1,pred,target,answer,expected", [
    (1.0, "who is he", "who was he", "zzz", 0.952574),
    (1.0, "who is zzz", "who was he", "zzz", 0.047426),
    (0.9, "what is he", "who was he", "zzz", 0.869892),
    (1.0, "", "who was he", "zzz", 0.0),
])
def test_reward_goldens(spark, f1, pred, target, answer, expected):
    df = spark.createDataFrame([(f1, pred, target, answer)], "f double, p string, t string, a string")
    got = df.select(RW.reward("f", "p", "t", "a")).first()[0]
    assert round(got, 6) == expected


def test_bigint_lcs_matches_dp():
    from qforge.functions.lcs import lcs_len_dp
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 150))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 150))]
        assert lcs_len(a, b) == lcs_len_dp(a, b)


def test_exploded_rouge_matches_row(spark):
    rng = random.Random(13)
    vocab = ["p", "q", "r", "s", "t"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 400))),
             " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 400)))) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    a = {r["id"]: r for r in rouge_scores(df, ["id"], metrics=("rouge1", "rouge2", "rougeL")).collect()}
    b = {r["id"]: r for r in rouge_scores(df, ["id"], metrics=("rouge1", "rouge2", "rougeL"),
                                          method="exploded").collect()}
    for i in a:
        for c in ("rouge1_f", "rouge2_p", "rouge2_r", "rougeL_f"):
            assert a[i][c] == b[i][c], (i, c)
