"""Split scans, instruction prompts, pair estimates, ranks, wins, score and
record files, native text rules."""

import pytest
from pyspark.sql import functions as F

from qforge.functions import text as X
from qforge.operators import compare, prefs, prompts, summary
from qforge.sources import sinks, tables
from tests.test_plans import _plan

QA = "id bigint, title string, context string, question string, answers struct<text:array<string>, answer_start:array<int>>, split string"


def _records(spark):
    return spark.createDataFrame(
        [(1, "t", "the cat sat", "who sat?", (["cat"], [4]), "train"), (2, "t", "a b", "q?", ([], []), "validation"),
         (3, None, "x y", "why?", (["y"], [2]), "validation"), (4, "t", None, None, (None, None), "validation"),
         (5, "t", "c", "q", (["c"], [0]), None)], QA)


def test_split_scan_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "qa")
    tables.write_qa(_records(spark), path)
    ids = lambda **kw: sorted(r.id for r in tables.read_qa(spark, path, **kw).collect())
    assert ids() == [1, 2, 3, 4, 5]
    assert ids(split="validation") == [2, 3, 4]
    assert ids(split="validation", unanswerable=False) == [3]
    assert ids(unanswerable=False) == [1, 3, 5] and ids(split="test") == []
    assert "PartitionFilters: [isnotnull(split" in _plan(tables.read_qa(spark, path, split="train"))
    tables.write_qa(_records(spark).limit(0), path)            # an empty table replaces the former one
    assert list((tmp_path / "qa").glob("split=*")) == []


def test_instruction_prompt(spark):
    got = {r.id: r.text for r in prompts.instruction_prompts(_records(spark)).collect()}
    assert sorted(got) == [1, 3, 5]
    assert got[1] == ('<s>\n[INST] \nYou are a question generation system. Generate questions for the given answer <answer>, matching '
                      'the context. Each question starts after <question> and starts with a question word like "who, what, where, when". '
                      '[\\INST]<ctx> the  <hl> cat <hl>  sat <ctx> <ans> cat <ans> <question> who sat? <question> \n<\\s>')
    ask = {r.id: r.text for r in prompts.instruction_prompts(_records(spark), with_question=False).collect()}
    assert ask[1] == got[1].split(" who sat?")[0]


def test_expected_and_exact_pairs(spark):
    rows = [("a", i, "t", s) for i, s in enumerate([3, 5, 3, 3])] + [("b", 0, "t", 1)] + [("c", i, "t", i) for i in range(6)]
    st = prefs.pair_stats(spark.createDataFrame(rows, "qid string, pos int, text string, pm_score int"), 10)
    got = prefs.expected_pairs(st).first()
    assert got.asDict() == {"n_questions": 3, "mean_half_sq": round((8 + 0.5 + 18) / 3, 6), "mean_pairs": 6.0, "n_pairs": 18, "n_capped": 13}
    by = {r.g: r.n_pairs for r in prefs.expected_pairs(st.withColumn("g", F.when(F.col("qid") == "c", "x")), "g").collect()}
    assert by == {None: 3, "x": 15}
    none = prefs.expected_pairs(st.limit(0)).first()
    assert none.n_questions == 0 and none.mean_half_sq is None and none.n_pairs == 0
    assert prefs.expected_pairs(st.limit(0), "qid").count() == 0


def test_every_metric_has_its_rank(spark):
    board = spark.createDataFrame([("a", 0.5, 3.0), ("b", 0.5, 1.0), ("c", 0.1, None), ("d", None, 2.0)], "model string, f double, loss double")
    got = {r.model: (r.f_rank, r.loss_rank) for r in summary.metric_ranks(board, ["f", "loss"], lower_is_better=["loss"]).collect()}
    assert got == {"a": (1, 3), "b": (1, 1), "c": (3, 4), "d": (4, 2)}


def test_wins_are_shared_on_ties(spark):
    nan = float("nan")
    rows = [(1, "a", 0.9), (1, "b", 0.5), (2, "a", 0.4), (2, "b", 0.4), (2, "c", 0.1), (3, "a", None), (3, "b", nan), (3, "c", 0.0),
            (4, "c", None), (None, "a", 0.2), (None, "b", 0.1)]
    got = {r.model: (r.n_items, r.wins, r.ties, r.win_share)
           for r in compare.win_counts(spark.createDataFrame(rows, "id bigint, model string, f double"), "f").collect()}
    assert got == {"a": (4, 2, 1, 0.625), "b": (4, 0, 1, 0.125), "c": (3, 1, 0, round(1 / 3, 6))}
    assert compare.win_counts(spark.createDataFrame([], "id bigint, model string, f double"), "f").count() == 0


def test_summary_comes_from_the_stored_scores(spark, tmp_path):
    from pyspark.sql import types as T
    seen = spark.sparkContext.accumulator(0)

    @F.udf(T.DoubleType())
    def scored(x):
        seen.add(1)
        return float(x)
    scores = spark.range(20).select(F.col("id"), F.concat(F.lit("m"), F.col("id") % 2).alias("model"), F.lit("p").alias("prediction"),
                                    scored("id").alias("f"))
    path = str(tmp_path / "doc")
    got = sinks.write_scores(scores, lambda s: summary.leaderboard(s, "model", ["f"], rank_by="f"), path)
    assert {r.model: (r.n, r.f, r["rank"]) for r in got.collect()} == {"m0": (10, 9.0, 2), "m1": (10, 10.0, 1)}
    assert seen.value == 20
    back = sinks.read_scores(spark, path, scores.schema, models=["m1"])
    assert set(back.columns) == {"id", "model", "prediction", "f"}
    assert sorted(r.id for r in back.collect()) == list(range(1, 20, 2)) and "(model#" in _plan(back).split("PartitionFilters: ")[1].split("]")[0]


def test_record_files(spark, tmp_path):
    records = _records(spark).select("id", "context", "question", "answers")
    for nulls in (False, True):
        path = str(tmp_path / f"records{nulls}")
        sinks.write_json_records(records, path, keep_nulls=nulls)
        back = sinks.read_json_records(spark, path, records.schema)
        assert sorted(map(repr, back.collect())) == sorted(map(repr, records.collect()))
        assert (sum('"context":null' in r.value for r in spark.read.text(path).collect()) == 1) == nulls
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"id": 1}\n{"id": "one"}\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        sinks.read_json_records(spark, str(tmp_path / "bad"), records.schema).collect()
    sinks.review_sample(_records(spark), str(tmp_path / "few"), 2, seed=42)
    few = sinks.read_json_records(spark, str(tmp_path / "few"), records.schema)
    assert few.count() == 2 and few.columns == ["id", "context", "question", "answers"]


def test_class_attributes_and_their_language(spark):
    html = '<p id="a" class="lang-py s-code">x</p><img class="">< class="no"><a href="q"\n class="\tc">class="text"</a>'
    got = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(X.class_attributes("html").alias("c"))
    assert [r.c for r in got.collect()] == [["lang-py s-code", "", "\tc"], None, []]
    cls = [("lang-py s-code",), ("  lang-c++",), ("\tx\ny",), ("",), (" \n",), (None,), ("a-",)]
    df = spark.createDataFrame(cls, "c string").select(X.code_language("c").alias("l"))
    assert [r.l for r in df.collect()] == ["py", "c++", "x", None, None, None, ""]


def test_characters_that_cannot_be_encoded(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9",), (b"caf\xe9 x",), (b"",), (None,)], "b binary")
    assert [r.t for r in df.select(X.make_valid(F.col("b").cast("string")).alias("t")).collect()] == ["café", "caf� x", "", None]
