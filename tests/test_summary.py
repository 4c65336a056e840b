"""The bootstrap from a score histogram, and the records it is fed with."""

import bisect
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from qforge.operators.summary import bootstrap, bootstrap_rows, poisson_cdf, poisson_draw
from qforge.sources import fixtures as FX

DRAWS = 20000


def _draws(spark, n):
    df = spark.range(DRAWS).select(F.lit(float(n)).alias("n"), F.md5(F.col("id").cast("string")).alias("h"))
    return [r["w"] for r in df.withColumn("cdf", poisson_cdf(F.col("n"))).orderBy("h")
            .select(poisson_draw(F.col("n"), F.col("cdf"), F.col("h")).alias("w")).collect()]


@pytest.mark.parametrize("n", [1, 7, 128])
def test_small_counts_are_drawn_exactly(spark, n):
    cdf, term = [math.exp(-n)], math.exp(-n)
    for k in range(1, 400):
        term *= n / k
        cdf.append(cdf[-1] + term)
    digests = sorted(hashlib.md5(str(i).encode()).hexdigest() for i in range(DRAWS))
    assert _draws(spark, n) == [float(bisect.bisect_right(cdf, int(h[:12], 16) / 2 ** 48)) for h in digests]


@pytest.mark.parametrize("n", [129, 5000, 10 ** 9])
def test_large_counts_have_mean_and_variance(spark, n):
    w = _draws(spark, n)
    mean = sum(w) / DRAWS
    assert abs(mean - n) < 4 * math.sqrt(n / DRAWS)
    assert abs(sum((x - mean) ** 2 for x in w) / DRAWS / n - 1) < 0.05
    assert all(x == int(x) and x >= 0 for x in w)


def test_bootstrap_bounds_and_defined_cases(spark):
    nan = float("nan")
    hot = spark.range(200000).select(F.lit("hot").alias("model"), (F.col("id") % 2).cast("double").alias("score"))
    few = spark.createDataFrame([("few", x / 40) for x in range(40)] + [("few", None), ("few", nan), ("none", None), ("one", 0.25), (None, 0.5)],
                                "model string, score double")
    got = {r["model"]: r for r in bootstrap(hot.union(few), "model", "score").collect()}
    assert set(got) == {"hot", "few", "one", None}
    for model, mean, sd, n in (("hot", 0.5, 0.5, 200000), ("few", 19.5 / 40, 11.543 / 40, 40)):
        err = sd / math.sqrt(n)
        assert abs(got[model]["mid"] - mean) < 0.2 * err
        assert abs(got[model]["low"] - mean + 1.96 * err) < 0.3 * err
        assert abs(got[model]["high"] - mean - 1.96 * err) < 0.3 * err
    assert got["one"]["low"] == got["one"]["high"] == 0.25
    assert bootstrap(few.limit(0), "model", "score").count() == 0
    again = bootstrap(hot.repartition(3).union(few), "model", "score").collect()
    assert {r["model"]: r for r in again} == got


def test_draws_follow_the_histogram(spark):
    from tests.test_plans import _plan
    scores = spark.range(50000).select(F.lit("m").alias("model"), (F.col("id") % 3).cast("double").alias("score"))
    plan = _plan(bootstrap(scores, "model", "score"))
    below = plan[plan.index("Generate"):]                 # what runs before the replicates exist
    assert "HashAggregate" in below and "score" in below


def test_models_are_stacked_in_one_scan(spark, tmp_path):
    from qforge.operators.compare import read_models, stack_models, write_models
    from tests.test_plans import _plan
    rows = [(1, "007", "a"), (2, "007", None), (1, "x=/y z", ""), (3, "1e3", "b"), (3, "1e3", "b"), (4, None, "c")]
    df = spark.createDataFrame(rows, "id bigint, model string, prediction string")
    path = str(tmp_path / "models")
    write_models(df, path)
    back = read_models(spark, path, "id bigint, prediction string")
    assert sorted(map(repr, back.select("id", "model", "prediction").collect())) == sorted(map(repr, df.collect()))
    plan = _plan(back)
    assert plan.count("FileScan") == 1 and "Union" not in plan
    some = read_models(spark, path, "id bigint, prediction string", models=["007", "1e3"])
    frames = {m: df.where(F.col("model") == m) for m in ("007", "1e3")}
    assert sorted(map(repr, some.select("id", "model", "prediction").collect())) == sorted(map(repr, stack_models(frames).collect()))


def test_questions_come_from_the_document_itself(spark):
    rows = [(1, "One two two  three. Four", "s"), (2, "a a\tb\nc", "s"), (3, None, "s"), (4, "", None), (None, "x x x", "s"), (5, ". x", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    got = {r["id"]: r["question"] for r in FX.qa_from_documents(docs).collect()}
    assert got == {1: "who One two three?", 2: "when a b?", 3: "where ?", 4: "how ?", None: "how x?", 5: "what ?"}


def test_every_row_is_drawn_in_every_replicate(spark):
    import numpy as np
    nan = float("nan")
    rows = [("a", i, i % 7 / 7) for i in range(300)] + [("b", i, i % 2 / 1.0) for i in range(300)] \
        + [("b", 5, 0.5), ("b", None, 0.25), ("b", 3, None), ("b", 4, nan), (None, 1, 0.5), ("none", 1, None)]
    df = spark.createDataFrame(rows, "model string, id bigint, score double")

    def weight(rep, key):
        u = int(hashlib.md5(f"42:{rep}:{'' if key is None else key}".encode()).hexdigest()[:12], 16) / 2 ** 48
        k, cdf, term = 0, math.exp(-1), math.exp(-1)
        while k < 12 and u >= cdf:
            k += 1
            term /= k
            cdf += term
        return k
    want = {}
    for model in ("a", "b", None):
        mine = [(k, s) for m, k, s in rows if m == model and s is not None and s == s]
        ws = [[weight(rep, k) for k, _ in mine] for rep in range(1, 51)]
        means = [sum(w * s for w, (_, s) in zip(each, mine)) / sum(each) for each in ws if sum(each)]
        want[model] = [round(float(x), 6) for x in np.percentile(means, [2.5, 50, 97.5])]
    for parts in (1, 5):
        got = {r["model"]: [r["low"], r["mid"], r["high"]] for r in bootstrap_rows(df.repartition(parts), "model", "id", "score", n_samples=50).collect()}
        assert set(got) == set(want) and all(got[m] == pytest.approx(want[m], abs=2e-6) for m in want)


def test_q31_resamples_rows(spark):
    from qforge.plans.oracle import SQL
    from qforge.plans.queries import REGISTRY
    from tests.conftest import SF001
    from tests.test_plans import _plan
    assert "unnest(range(1, 1001)) AS rep FROM r1" in SQL["q31_rouge_bootstrap"]
    plan = _plan(REGISTRY["q31_rouge_bootstrap"](spark, SF001))
    assert "hashpartitioning(key" in plan and "MapInPandas" in plan
    assert not any("aggregate(" in x for x in plan.split("\n") if "Filter" in x)      # no score is made to filter by it


def test_no_weight_is_cut(monkeypatch):
    """Code and SQL invert the whole distribution: the largest of 2^48 draws weighs 16."""
    from fractions import Fraction
    from types import SimpleNamespace

    import duckdb

    from qforge.operators import summary
    from qforge.plans.oracle import SQL, _poisson_case
    p0 = sum(Fraction((-1) ** j, math.factorial(j)) for j in range(40))
    cdf = [sum(p0 / math.factorial(j) for j in range(k + 1)) for k in range(20)]
    edges = [math.ceil(c * 2 ** 48) for c in cdf]            # the least draw that weighs more than k
    draws = sorted({d for e in edges for d in (e - 1, e) if d < 2 ** 48} | {0, 2 ** 48 - 1})
    want = [bisect.bisect_right(edges, d) for d in draws]
    assert want[-1] == 16 and set(want) == set(range(17))

    def md5(text):                                           # the key itself is the digest's head
        return SimpleNamespace(digest=lambda: bytes.fromhex(text.decode().split(":")[2]) + bytes(10))
    monkeypatch.setattr(summary, "hashlib", SimpleNamespace(md5=md5))
    assert summary.row_weights([f"{d:012x}".encode() for d in draws], 1, 42)[:, 0].tolist() == want
    sql = f"SELECT {_poisson_case('u')} FROM (SELECT d, d / 281474976710656.0 AS u FROM (SELECT unnest(?::BIGINT[]) AS d)) ORDER BY d"
    assert [r[0] for r in duckdb.execute(sql, [draws]).fetchall()] == want
    assert _poisson_case("u") in SQL["q31_rouge_bootstrap"]
