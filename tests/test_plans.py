"""Physical-plan properties the scale design relies on."""

from pyspark.sql import functions as F

from qforge.sources import fixtures as FX


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_of_a_hot_source_use_no_window(spark):
    # one source holds a third of all rows
    rows = [(i, f"text {i}", "hot" if i % 3 == 0 else f"s{i % 50}", 6) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    ans = FX.preference_answers(docs)
    assert "Window" not in _plan(ans)
    assert ans.count() == 3000
    hot = ans.where(F.col("qid") == "hot").orderBy("pos").collect()
    assert [r["pos"] for r in hot] == list(range(1, 1001))
    assert [r["doc_id"] for r in hot] == list(range(0, 3000, 3))


def test_id_queries_read_no_text(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001
    plan = _plan(E.queries()["q15_overlap_anti"](spark, SF001))
    for scan in (x for x in plan.split("\n") if "FileScan" in x):
        assert "text" not in scan.split("ReadSchema")[1]


def test_rows_are_spread_before_they_are_scored(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001
    for name in ("q25_rouge1", "q27_rougeL"):
        df = E.queries()[name](spark, SF001)
        plan = _plan(df)
        assert "EvalPython" not in plan          # counted in the JVM at any length
        assert "REPARTITION_BY_COL" in plan
        # narrow rows: no context crosses the exchange
        spread = next(x for x in plan.split("\n") if "REPARTITION_BY_COL" in x)
        assert "context" not in spread and "text" not in spread


def test_vector_table_broadcast_is_size_checked(spark):
    from qforge.operators.bertscore import bertscore
    from qforge.operators.rouge import with_tokens
    vt = spark.createDataFrame([(f"t{i}", [1.0, float(i)]) for i in range(10)], "token string, vec array<double>")
    df = with_tokens(spark.createDataFrame([(1, "t1 t2", "t2 t3")], "id int, prediction string, reference string"))
    small = _plan(bertscore(df, ["id"], vt))
    big = _plan(bertscore(df, ["id"], vt, max_broadcast_bytes=8))
    assert "Join" not in small and "Exchange" not in small
    assert "Exchange" in big     # too big to ship: shuffle join and regroup
