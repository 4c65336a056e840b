"""Incremental evaluation with Structured Streaming.

Prediction files arrive in a folder; each micro-batch is joined to the
references and scored, and partial sums per (model, salt) are the stream's
state, kept under its checkpoint.  A model's rows are spread over ``SALTS``
state keys, so one model that holds most rows is many tasks' work.  Every
batch writes the partial sums so far (at most models x ``SALTS`` rows) as a
snapshot; the means are merged from the last one.  Neither a batch nor a
restart reads a prediction or a scored row twice.

With the ``availableNow`` trigger every file present is processed and the
query stops; the final table equals the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.functions.text import clean_eval, clean_target
from qforge.operators.rouge import rouge_n_stage, with_tokens
from qforge.sources.sinks import filesystem


def scored_stream(preds_stream: DataFrame, refs: DataFrame) -> DataFrame:
    """Stateless part: join each arriving prediction to its reference and
    score it (same columns as the batch ROUGE-1 plan)."""
    j = preds_stream.join(refs, "id")
    ev = j.select("id", "model", clean_eval("prediction").alias("prediction"),
                  clean_target("target").alias("reference"))
    return rouge_n_stage(with_tokens(ev), 1, ndigits=None).select("id", "model", "rouge1_f")


SALTS = 64


def one_file(rows: DataFrame) -> DataFrame:
    """``rows`` (models x ``SALTS``) in one partition, behind a shuffle: without
    it one task would merge the state of all partitions, holding each one's memory."""
    return rows.repartition(1)


def running_model_means(spark: SparkSession, pred_dir: str, pred_schema, refs: DataFrame,
                        checkpoint: str, out_path: str, files_per_batch: int = 2) -> DataFrame:
    """Score what has arrived since the last call with this ``checkpoint`` and
    return ``model, n, rouge1_mean`` over all that ever arrived.

    A snapshot is a folder of its own, named by its batch and complete once
    ``_SUCCESS`` is in it; a batch that is tried again replaces its own, and the
    one before stays until the next is complete.  Predictions without a
    reference are not scored; no predictions give no rows."""
    stream = spark.readStream.schema(pred_schema).option("maxFilesPerTrigger", files_per_batch).parquet(pred_dir)
    partial = (scored_stream(stream, refs).groupBy("model", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum("rouge1_f").alias("total")))
    fs, hadoop = filesystem(spark, out_path)

    def snapshot(rows: DataFrame, batch: int) -> None:
        one_file(rows).write.mode("overwrite").parquet(f"{out_path}/batch={batch:012d}")
        for old in sorted(s.getPath().getName() for s in fs.listStatus(hadoop(out_path)))[:-2]:
            fs.delete(hadoop(f"{out_path}/{old}"), True)
    query = (partial.writeStream.outputMode("complete").foreachBatch(snapshot)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    done = sorted(s.getPath().getName() for s in fs.listStatus(hadoop(out_path))
                  if fs.exists(hadoop(f"{out_path}/{s.getPath().getName()}/_SUCCESS"))) if fs.exists(hadoop(out_path)) else []
    sums = spark.read.schema(partial.schema).parquet(f"{out_path}/{done[-1]}") if done else spark.createDataFrame([], partial.schema)
    return (sums.groupBy("model").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .select("model", "n", F.round(F.col("total") / F.col("n"), 6).alias("rouge1_mean")))
