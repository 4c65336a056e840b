"""Model comparison: J3 (wide table), U1 (stacking), W4/W5 (blind labels and
reviewer assignment), J6/A7 (human scores joined back, averaged), A8
(question-word distribution), A9/A14 (length and dataset profile), A10
(distinct-n), T4 (best model per item, win counts)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qforge.functions.arrays import ngrams
from qforge.functions.text import first_word, metric_tokens, seeded_key, word_count


def stack_models(frames: dict) -> DataFrame:
    """Per-model prediction frames stacked into the long form."""
    parts = [df.select("id", F.lit(m).alias("model"), "prediction") for m, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_models(long_df: DataFrame, path: str, model_col: str = "model") -> None:
    """One folder of Parquet files per model, written in one pass over ``long_df``."""
    long_df.write.mode("overwrite").partitionBy(model_col).parquet(path)


def read_models(spark: SparkSession, path: str, columns: str, model_col: str = "model", models=None) -> DataFrame:
    """U1 over the folders of ``write_models``: all models in one scan instead of
    one scan and one union branch each; ``models`` reads their folders only.
    ``columns`` is the DDL of the other columns.  Model names come back as the
    strings they were, a null one as null."""
    out = spark.read.schema(f"{columns}, `{model_col}` string").parquet(path)
    return out if models is None else out.where(F.col(f"`{model_col}`").isin(list(models)))


def wide_models(long_df: DataFrame, models, key: str = "id") -> DataFrame:
    """One column per model.  The model list is given, so the pivot
    needs no extra job to discover values; one aggregation by key."""
    return long_df.groupBy(key).pivot("model", list(models)).agg(F.first("prediction"))


def long_models(wide_df: DataFrame, models, key: str = "id") -> DataFrame:
    """Inverse of J3 (``DataFrame.unpivot``)."""
    return wide_df.unpivot([key], list(models), "model", "prediction")


def blind_assignment(items: DataFrame, models, n_reviewers: int = 5, seed: int = 42,
                     key: str = "id") -> DataFrame:
    """Every item gets one row per model with a blind label Q1..Qk
    (order by ``md5(seed:item:model)``) and a reviewer 1..n (``ntile`` over
    the items in seeded order).  ``items`` is a bounded review sample; the
    ntile window runs on that sample only."""
    m = F.array(*[F.lit(x) for x in models])
    rows = items.select(key, F.explode(m).alias("model"))
    w_lbl = Window.partitionBy(key).orderBy(seeded_key(seed, key, "model"))
    rev = items.select(key, F.ntile(n_reviewers).over(
        Window.orderBy(seeded_key(seed, key), F.col(key))).cast("bigint").alias("reviewer"))
    return (rows.withColumn("label", F.concat(F.lit("Q"), F.row_number().over(w_lbl).cast("string")))
            .join(rev, key))


def human_scores(assign: DataFrame, labels: DataFrame, seed: int = 42, key: str = "id") -> DataFrame:
    """Reviewer scores (1-5) per (item, label), derived from the ``labels``
    table: ``1 + 2*quality + (1 - toxic) + md5(seed:item:label) % 2``.  Only
    labelled items receive scores.  Carries no model: the model is found
    again through the blind label (J6)."""
    lab = labels.select(F.col("doc_id").alias(key), "quality", "toxic")
    h = F.pmod(F.conv(F.substr(seeded_key(seed, key, "label"), F.lit(1), F.lit(7)), 16, 10)
               .cast("bigint"), F.lit(2))
    return (assign.select(key, "label", "reviewer").join(lab, key)
            .select(key, "label", "reviewer",
                    F.least(F.lit(5), F.lit(1) + 2 * F.col("quality") + (1 - F.col("toxic")) + h)
                    .cast("bigint").alias("score")))


def model_scores(assign: DataFrame, scores: DataFrame, key: str = "id") -> DataFrame:
    """J6 + A7: scores joined back through (item, label), mean per model."""
    j = scores.join(assign.select(key, "label", "model"), [key, "label"])
    return j.groupBy("model").agg(F.round(F.avg("score"), 6).alias("avg_score"),
                                  F.count(F.lit(1)).alias("n"))


def question_words(df: DataFrame, col: str = "question") -> DataFrame:
    """First word (lower) distribution with its share."""
    c = df.select(first_word(col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = df.count()   # a scalar, not a global window over the word table
    return c.withColumn("share", F.round(F.col("n") / F.lit(float(max(total, 1))), 6))


def length_profile(df: DataFrame, group_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """Rows, mean words, distinct titles per group."""
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.avg(word_count(text_col)), 6).alias("avg_words")]
    if title_col:
        aggs.append(F.count_distinct(title_col).alias("n_titles"))
    return df.groupBy(group_col).agg(*aggs)


def distinct_n(df: DataFrame, group_col: str, text_col: str, ns=(1, 2)) -> DataFrame:
    """A10: distinct-n per group, all ``ns`` in one pass.  Grams are
    exploded once (tagged with n, plus one sentinel per row so groups without
    grams stay), counted per (group, n, gram) -- partial aggregation, so a
    group holding a third of all rows never gathers its grams in one task --
    then folded per group."""
    toks = df.select(group_col, metric_tokens(text_col).alias("t"))
    def tagged(n):
        return F.transform(ngrams("t", n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))
    parts = [tagged(n) for n in ns]
    sentinel = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("g")))
    items = toks.select(group_col, F.inline(F.concat(*parts, sentinel)))
    per = items.groupBy(group_col, "n", "g").agg(F.count(F.lit(1)).alias("c"))
    aggs = []
    for n in ns:
        on = F.col("n") == n
        aggs += [F.count(F.when(on, F.lit(1))).alias(f"_d{n}"),
                 F.sum(F.when(on, F.col("c")).otherwise(0)).alias(f"_g{n}")]
    out = per.groupBy(group_col).agg(*aggs)
    res = [group_col]
    for n in ns:
        tot = F.col(f"_g{n}").cast("bigint")
        res += [tot.alias(f"n_grams{n}"),
                F.round(F.try_divide(F.col(f"_d{n}").cast("double"), tot), 6).alias(f"distinct{n}")]
    return out.select(*res)


def best_model_per_item(scores: DataFrame, metric: str, key: str = "id") -> DataFrame:
    """T4: the winning model per item (ties: smallest model name).  The
    window partition is one item (one row per model), so it is bounded."""
    w = Window.partitionBy(key).orderBy(F.desc(metric), F.asc("model"))
    return (scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(key, F.col("model").alias("winner"), F.round(metric, 6).alias("score")))


def win_counts(scores: DataFrame, metric: str, key: str = "id") -> DataFrame:
    """T4: how often each model has the best score of an item: ``n_items``
    scored, ``wins`` alone, ``ties`` shared, ``win_share`` with a shared first
    place counted in equal parts.

    One shuffle by item; what an item's best score is and how many models hold
    it comes from a window over its few rows, and the counts per model are
    summed before they move.  Null and NaN scores count as scored but never win;
    a model without any win has zeros."""
    s = F.when(~F.isnan(metric), F.col(metric))
    item = Window.partitionBy(key)
    top = scores.select(key, "model", s.alias("_s")).withColumn("_top", F.coalesce(F.col("_s") == F.max("_s").over(item), F.lit(False)))
    each = top.withColumn("_n", F.sum(F.col("_top").cast("int")).over(item))
    part = F.when(F.col("_top"), 1.0 / F.col("_n")).otherwise(0.0)
    return each.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("_top") & (F.col("_n") == 1)).alias("wins"),
        F.count_if(F.col("_top") & (F.col("_n") > 1)).alias("ties"), F.round(F.avg(part), 6).alias("win_share"))
