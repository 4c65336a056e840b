"""Text rules as tables of inputs and outputs (X3, X6, X8, X9, X12), the
shard writer round trip, and partition independence."""

import pytest
from pyspark.sql import functions as F

from qforge.functions import text as X

CASES = [
    # evaluator cleanup: the tokens go in their fixed order, so halves can be left over
    (X.clean_eval, [("<question> a question>", "< a "), ("<hl>b<hl>", "b"), ("question>question>", ""), ("", ""), (None, None),
                    ("quesquestion>tion>", "question>"), ("< question>", "< "), ("</s> é", "</s> é"), ("<<hl>question>", "<")]),
    # reward cleanup: every "<" goes last, then outer white space of any kind
    (X.clean_reward, [("<pad><pad> Who is? </s>", "Who is?"), ("\n <unk>\ta\u00a0", "a"), ("a < b", "a  b"), ("<question>", ""), (None, None),
                      ("<hl>x<hl>", "hl>xhl>"), ("<pa<unk>d>x", "pad>x"), ("question>  ", "")]),
    # blank lines
    (X.collapse_blank_lines, [("a\n\nb", "a\n\nb"), ("a\n \n\t\n b\n", "a\n\n b"), ("a\nb", "a\nb"), ("\n\n", ""), (" x ", "x"), (None, None),
                              ("a\n\u00a0\nb", "a\n\nb"), ("a \n\n\n c\n\n\n", "a \n\n c")]),
    # completion
    (X.extract_completion, [("c ### Question: who?", " who?"), ("### Question: a ### Question: b?", " a ?"), ("no marker?", None), ("", None), (None, None),
                            ("### Question:", "?"), ("### Question:?x", "?"), ("x### Question: a? b?", " a?")]),
    # words
    (X.word_count, [("", 0), (" \t\n", 0), ("a", 1), (" a\u00a0b  c\n", 3), ("é < >", 3), ("a\u2003b", 2)]),
]


@pytest.mark.parametrize("fn,pairs", CASES)
def test_text_rules(spark, fn, pairs):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(pairs)], "i int, s string")
    got = {r["i"]: r["y"] for r in df.select("i", fn("s").alias("y")).collect()}
    for i, (given, wanted) in enumerate(pairs):
        assert got[i] == wanted, repr(given)


def test_write_shards_roundtrip(spark, tmp_path):
    from qforge.sources.sinks import shard_plan, write_shards
    df = spark.createDataFrame([("a" if i < 30 else "b", i, "x" * 50) for i in range(50)],
                               "split string, k int, t string")
    planned = shard_plan(df, ["k"], "split", shard_bytes=500, byte_cols=["t"])
    out = str(tmp_path / "shards")
    write_shards(planned, out)
    back = spark.read.parquet(out)
    assert back.count() == 50
    per = {(r["split"], r["shard"]): r["count"] for r in back.groupBy("split", "shard").count().collect()}
    # split a: 30 rows x 50 bytes = 1500 bytes -> 4 shards of 8,8,7,7 rows
    assert [per[("a", s)] for s in range(4)] == [8, 8, 7, 7]
    ks = {r["shard"]: sorted(x["k"] for x in back.where((F.col("split") == "a") & (F.col("shard") == r["shard"])).collect())
          for r in back.where(F.col("split") == "a").select("shard").distinct().collect()}
    assert ks[0] == list(range(8)) and ks[3] == list(range(23, 30))   # contiguous


def test_partition_independent_scores(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001
    q = E.queries()["q25_rouge1"]
    a = sorted(map(tuple, q(spark, SF001).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, q(spark, SF001).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
