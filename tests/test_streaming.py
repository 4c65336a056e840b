"""Incremental scoring survives a restart from its checkpoint."""

import os

from pyspark.sql import functions as F


def test_stream_restart_is_incremental(spark, tmp_path):
    from qforge.operators import prompts as P
    from qforge.sources import fixtures as FX
    from qforge.sources.tables import read_table
    from qforge.streaming.scores import running_model_means, scored_stream
    from tests.conftest import SF001
    qa = FX.qa_from_documents(read_table(spark, SF001, "documents"))
    preds = FX.stub_predictions(qa)
    refs = P.qa_prompts(qa).select("id", "target")
    src, ckpt, out = str(tmp_path / "in"), str(tmp_path / "ckpt"), str(tmp_path / "out")
    preds.where(F.col("model") == "echo").repartition(3).write.mode("append").parquet(src)
    first = {r["model"]: r["n"] for r in running_model_means(spark, src, preds.schema, refs, ckpt, out).collect()}
    for name in os.listdir(src):                     # what was scored is not needed any more
        if name.startswith("part-"):
            os.remove(f"{src}/{name}")
    preds.where(F.col("model") != "echo").repartition(4).write.mode("append").parquet(src)
    second = {r["model"]: (r["n"], r["rouge1_mean"]) for r in running_model_means(spark, src, preds.schema, refs, ckpt, out).collect()}
    n = preds.where(F.col("model") == "echo").count()
    assert first == {"echo": n}
    # state kept, only the new files read; the same means as the batch plan's
    whole = scored_stream(preds, refs).groupBy("model").agg(F.avg("rouge1_f").alias("m")).collect()
    assert {m: c for m, (c, _) in second.items()} == {m: n for m in FX.MODELS}
    assert all(abs(second[r["model"]][1] - r["m"]) < 1e-6 for r in whole)
    again = {r["model"]: (r["n"], r["rouge1_mean"]) for r in running_model_means(spark, src, preds.schema, refs, ckpt, out).collect()}
    assert again == second and len([d for d in os.listdir(out) if d.startswith("batch=")]) <= 2


def test_state_is_spread_over_salts(spark, tmp_path):
    """One model with all rows is many state keys; no input gives no rows."""
    from qforge.streaming.scores import running_model_means
    src, schema = str(tmp_path / "in"), "id long, model string, prediction string"
    os.mkdir(src)
    refs = spark.range(500).select("id", F.lit("a b c").alias("target"))
    empty = running_model_means(spark, src, _schema(spark, schema), refs, str(tmp_path / "c"), str(tmp_path / "o"))
    assert empty.collect() == []
    spark.range(600).select("id", F.lit("hot").alias("model"), F.lit("a b x").alias("prediction")).write.mode("append").parquet(src)
    got = running_model_means(spark, src, _schema(spark, schema), refs, str(tmp_path / "c"), str(tmp_path / "o")).collect()
    assert [tuple(r) for r in got] == [("hot", 500, 0.666667)]          # 100 predictions have no reference
    assert spark.read.parquet(str(tmp_path / "o")).count() > 50


def _schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def test_snapshot_leaves_the_state_to_its_tasks(spark):
    """The snapshot is one file, yet no task handles another partition's state."""
    from pyspark import TaskContext
    from qforge.streaming.scores import one_file

    def task(batches):
        for b in batches:
            yield b.assign(task=TaskContext.get().partitionId())
    rows = one_file(spark.range(64, numPartitions=8).mapInPandas(task, "id long, task int"))
    assert rows.rdd.getNumPartitions() == 1
    assert {r.task for r in rows.collect()} == set(range(8))
