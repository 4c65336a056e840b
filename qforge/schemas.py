"""Declared schemas of the record types (no dynamic inference)."""

from pyspark.sql import types as T

ANSWERS = T.StructType([
    T.StructField("text", T.ArrayType(T.StringType()), False),
    T.StructField("answer_start", T.ArrayType(T.IntegerType()), False),
])

QA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answers", ANSWERS),
])

PREF_ANSWER = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("pm_score", T.IntegerType()),
])

PREFERENCES = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("metadata", T.ArrayType(T.StringType())),
    T.StructField("answers", T.ArrayType(PREF_ANSWER)),
])

PREDICTIONS_WIDE = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("context", "answer", "t5base", "t5small", "t5ppo", "llama")
])

METRICS_DOC = T.StructType([
    T.StructField("bertscore", T.StructType([
        T.StructField("precision", T.ArrayType(T.DoubleType())),
        T.StructField("recall", T.ArrayType(T.DoubleType())),
        T.StructField("f1", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("rouge", T.StructType([
        T.StructField(k, T.DoubleType()) for k in ("rouge1", "rouge2", "rougeL", "rougeLsum")
    ])),
    T.StructField("predictions", T.ArrayType(T.StringType())),
    T.StructField("targets", T.ArrayType(T.StringType())),
])
