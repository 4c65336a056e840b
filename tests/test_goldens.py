"""Byte-exact goldens (FIXTURES.md section 4) for templates and cleanup."""

import pytest

from qforge.functions import text as X
from qforge.operators import prompts as P


@pytest.fixture(scope="module")
def rec(spark):
    return spark.createDataFrame(
        [(1, "t", "A bc d.", "Q?", (["bc"], [2]))],
        "id bigint, title string, context string, question string, "
        "answers struct<text:array<string>, answer_start:array<int>>")


def one(df, col):
    return df.select(col).first()[0]


def test_highlight(rec):
    assert one(rec.select(P.context_expr().alias("c")), "c") == "A  <hl> bc <hl>  d."


def test_answer_aware(rec):
    r = P.qa_prompts(rec).first()
    assert r["inputs"] == "generate question: <answer> bc <answer> <context> A  <hl> bc <hl>  d. <context>"
    assert r["target"] == "<question> Q? <question>"


def test_no_highlight(rec):
    r = P.qa_prompts(rec, use_highlight=False).first()
    assert r["inputs"] == "generate question: <answer> bc <answer> <context> A bc d. <context>"


def test_zero_shot(rec):
    r = P.qa_prompts(rec, zero_shot=True).first()
    assert r["inputs"] == "generate question: <context> A  <hl> bc <hl>  d. <context>"


def test_causal_eval(rec):
    assert P.causal_eval_prompts(rec).first()["text"] == "<s> A   bc   d. ### Answer: bc  ### Question:"


def test_causal_train_end(rec):
    t = P.causal_train_prompts(rec).first()["text"]
    assert t.startswith("<s>[INST] <<SYS>> You are a question generation system.")
    assert t.endswith("<<SYS>> A   bc   d. ### Answer: bc ### Answer: [/INST] ### Question: Q?  </s>")


def test_unanswerable_dropped(spark):
    df = spark.createDataFrame(
        [(1, "t", "ctx", "q", ([], []))],
        "id bigint, title string, context string, question string, "
        "answers struct<text:array<string>, answer_start:array<int>>")
    assert P.qa_prompts(df).count() == 0


def test_highlight_edges(spark):
    df = spark.createDataFrame(
        [(1, "abc", 0, "a"), (2, "abc", 2, "c"), (3, "abc", 9, "zz")],
        "id int, context string, s int, a string")
    got = {r["id"]: r["h"] for r in df.select("id", X.highlight("context", "s", "a").alias("h")).collect()}
    assert got[1] == " <hl> a <hl> bc"
    assert got[2] == "ab <hl> c <hl> "
    assert got[3] == "abc <hl>  <hl> "   # offset past the end: empty slice


@pytest.mark.parametrize("fn,inp,out", [
    (X.clean_eval, "<question> Who? <question>", "< Who? <"),
    (X.clean_eval, "question> Who? question>", " Who? "),
    (X.clean_target, "<question> Who? <question>", " Who? "),
    (X.clean_reward, "<question> Who? <question>", "Who?"),
    (X.clean_reward, "A <hl> b", "A hl> b"),
    (X.extract_completion, "<s> c ### Question: Who is it? Yes? ok", " Who is it?"),
    (X.extract_completion, "<s> c ### Question: no mark", " no mark?"),
])
def test_cleanup(spark, fn, inp, out):
    df = spark.createDataFrame([(inp,)], "x string")
    assert one(df.select(fn("x").alias("y")), "y") == out


def test_extract_answer(spark):
    df = spark.createDataFrame([("['### Question: q ### Answer: a\\nb\\tc \\\"d\\\"']",)], "x string")
    assert one(df.select(X.extract_answer("x").alias("y")), "y") == " a b c d']"


def test_metric_tokens(spark):
    df = spark.createDataFrame([("Café No. 42-x",)], "x string")
    assert one(df.select(X.metric_tokens("x").alias("t")), "t") == ["caf", "no", "42", "x"]


def test_code_language(spark):
    df = spark.createDataFrame([("lang-py s-code",), ("",), (None,)], "c string")
    got = [r[0] for r in df.select(X.code_language("c")).collect()]
    assert got == ["py", None, None]


def test_sigmoid_values(spark):
    df = spark.createDataFrame([(3.0,), (-3.0,), (1.9,)], "x double")
    got = [round(r[0], 6) for r in df.select(X.sigmoid("x")).collect()]
    assert got == [0.952574, 0.047426, 0.869892]


def test_first_word_and_count(spark):
    df = spark.createDataFrame([("  Who is  it ",), ("",)], "x string")
    rows = df.select(X.first_word("x"), X.word_count("x")).collect()
    assert (rows[0][0], rows[0][1]) == ("who", 3)
    assert (rows[1][0], rows[1][1]) == (None, 0)


def test_markdown_holds_a_slice_of_pages():
    """A batch is handed on slice by slice, none skipped; nulls stay."""
    import pyarrow as pa
    from qforge.functions import markdown as M
    pages = [None if i % 10 == 3 else f"<p>page <b>{i}</b></p>" for i in range(2 * M.SLICE_ROWS + 5)]
    out = list(M._html_to_markdown_udf.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert max(map(len, out)) <= M.SLICE_ROWS
    assert [x for part in out for x in part.to_pylist()] == [M.markdown_of(x) for x in pages]
