"""
metrics are bounded, pairs are ordered better-first, splits partition."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qforge.functions.text import highlight

TEXT = st.text(alphabet="ab cdé\n.", min_size=0, max_size=40)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(TEXT, st.integers(0, 45), st.integers(0, 12)), min_size=20, max_size=40))
def test_highlight_reversible(spark, rows):
    data = []
    for i, (ctx, s, n) in enumerate(rows):
        ans = ctx[s:s + n] if s < len(ctx) else "x" * n
        data.append((i, ctx, s, ans))
    df = spark.createDataFrame(data, "i int, ctx string, s int, a string")
    out = {r["i"]: r["h"] for r in df.select("i", highlight("ctx", "s", "a").alias("h")).collect()}
    for i, ctx, s, ans in data:
        h = out[i]
        ref = ctx[:s] + " <hl> " + ctx[s:s + len(ans)] + " <hl> " + ctx[s + len(ans):]
        assert h == ref
        assert h.replace(" <hl> ", "", 2) == ctx


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab c\n", max_size=30), st.text(alphabet="ab c\n", max_size=30)),
                min_size=30, max_size=30))
def test_metrics_bounded(spark, pairs):
    from qforge.operators.rouge import rouge_scores
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)],
                               "id int, prediction string, reference string")
    mets = ("rouge1", "rouge2", "rougeL", "rougeLsum", "rougeS")
    for r in rouge_scores(df, ["id"], metrics=mets).collect():
        for m in mets:
            for s in ("p", "r", "f"):
                assert 0.0 <= r[f"{m}_{s}"] <= 1.0
        assert r["rougeL_f"] <= max(r["rouge1_f"], 1e-12) + 1e-9   # LCS never beats unigram overlap


def test_pairs_better_first_and_splits_partition(spark):
    import __spark_entry__ as E
    from tests.conftest import SF01
    p = E.queries()["q16_pref_pairs"](spark, SF01)
    assert p.where(F.col("score_j") <= F.col("score_k")).count() == 0
    assert p.where(F.col("pos_i") >= F.col("pos_j")).count() == 0
    s = E.queries()["q11_named_splits"](spark, SF01)
    assert s.count() == s.select("doc_id").distinct().count() == 1000
