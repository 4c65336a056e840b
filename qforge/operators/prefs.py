"""Preference pairs from ranked answers: J2 (ordered pairs, ties give
none), T1 (cap of k pairs per question, seeded), T2 (best/worst answer),
A4/A5 (pair statistics), X19 (row-multiplying map).

Input is the flat answer table ``qid, pos, text, pm_score`` (one row per
answer).  The uncapped pairs (J2) are, by definition, every non-tied pair of
a question: a self equi-join on ``qid`` with ``i < j``, quadratic in the
answers of one question, as the reference's per-record enumeration is.  The
capped pairs (T1, the pipeline's output) never enumerate a question's pairs:
``capped_pairs`` draws ranks and computes the pair of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions.text import seeded_key


def answers_from_records(records: DataFrame) -> DataFrame:
    """Nested records (``answers ARRAY<STRUCT<text, pm_score>>``) to the flat
    answer table; a per-row ``posexplode``, no shuffle."""
    return records.select("qid", F.posexplode("answers").alias("p0", "a")) \
        .select("qid", (F.col("p0") + 1).cast("bigint").alias("pos"),
                F.col("a.text").alias("text"), F.col("a.pm_score").alias("pm_score"))


def pairs(answers: DataFrame) -> DataFrame:
    """For answers ``i < j`` of a question with different scores, the
    better text is ``response_j`` and the worse ``response_k``."""
    x = answers.select("qid", F.col("pos").alias("pos_i"), F.col("text").alias("t_i"),
                       F.col("pm_score").alias("s_i"))
    y = answers.select("qid", F.col("pos").alias("pos_j"), F.col("text").alias("t_j"),
                       F.col("pm_score").alias("s_j"))
    j = x.join(y, "qid").where((F.col("pos_i") < F.col("pos_j")) & (F.col("s_i") != F.col("s_j")))
    i_better = F.col("s_i") > F.col("s_j")
    return j.select(
        "qid", "pos_i", "pos_j",
        F.when(i_better, F.col("t_i")).otherwise(F.col("t_j")).alias("response_j"),
        F.when(i_better, F.col("t_j")).otherwise(F.col("t_i")).alias("response_k"),
        F.greatest("s_i", "s_j").cast("bigint").alias("score_j"),
        F.least("s_i", "s_j").cast("bigint").alias("score_k"))


def capped_pairs(answers: DataFrame, max_pairs: int = 10, seed: int = 42) -> DataFrame:
    """``max_pairs`` non-tied pairs per question, drawn uniformly without
    replacement, without enumerating a question's pairs.

    The non-tied pairs of a question are ranked 0 .. N-1 by (better score,
    better position, worse score, worse position); N comes from the score
    histogram.  Up to ``100 * max_pairs`` pairs the ranks are ordered by
    ``md5(seed:qid:rank)``; beyond, the draws are ``md5(seed:qid:t) mod N`` for
    t = 0, 1, .. without repeats.  A drawn rank is turned into its two answers
    by arithmetic: with the dense index over (qid, score, position), the
    answers worse than a score group are the index range before it.  A
    question with very many answers costs its share of one range sort of
    (qid, score, position) and ``max_pairs`` rows; texts are fetched for the
    drawn answers only."""
    from qforge.operators.index import with_row_index
    idx = with_row_index(answers.select("qid", "pm_score", "pos"), ["qid", "pm_score", "pos"], "_i")
    hist = idx.groupBy("qid", "pm_score").agg(F.count(F.lit(1)).alias("g"), F.min("_i").alias("first"))
    q = Window.partitionBy("qid")
    hist = (hist.withColumn("start", F.min("first").over(q))
            .withColumn("lower", F.col("first") - F.col("start"))
            .withColumn("upto", F.sum(F.col("g") * F.col("lower")).over(q.orderBy("pm_score")))
            .withColumn("n", F.sum(F.col("g") * F.col("lower")).over(q)))
    ranks = hist.where("n > 0").groupBy("qid").agg(F.max("n").alias("n"))
    keyed = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1),
                        lambda r: F.struct(seeded_key(seed, "qid", r).alias("k"), r.alias("r")))
    few = F.transform(F.array_sort(keyed), lambda x: x["r"])
    many = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(10 * max_pairs - 1)),
        lambda t: F.pmod(F.conv(F.substr(seeded_key(seed, "qid", t), F.lit(1), F.lit(13)), 16, 10).cast("bigint"), F.col("n"))))
    drawn = ranks.select("qid", F.posexplode(F.slice(F.when(F.col("n") <= 100 * max_pairs, few).otherwise(many), 1, max_pairs))
                         .alias("t", "r"))
    size = F.col("g") * F.col("lower")
    picked = (drawn.join(hist, "qid").where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - size))
              .withColumn("at", F.col("r") - (F.col("upto") - size))
              .select("qid", (F.col("t") + 1).cast("bigint").alias("pair_rank"),
                      (F.col("first") + F.floor(F.col("at") / F.greatest("lower", F.lit(1)))).alias("hi"),
                      (F.col("start") + F.col("at") % F.greatest("lower", F.lit(1))).alias("lo")))

    def end(side):
        return idx.select(F.col("_i").alias(side), F.col("pos").alias(f"pos_{side}"))

    def text(side, name):
        return answers.select("qid", F.col("pos").alias(f"pos_{side}"), F.col("text").alias(name), F.col("pm_score").cast("bigint").alias(f"s_{side}"))
    placed = picked.join(end("hi"), "hi").join(end("lo"), "lo")
    return (placed.join(text("hi", "response_j"), ["qid", "pos_hi"]).join(text("lo", "response_k"), ["qid", "pos_lo"])
            .select("qid", F.least("pos_hi", "pos_lo").alias("pos_i"), F.greatest("pos_hi", "pos_lo").alias("pos_j"),
                    "response_j", "response_k", F.col("s_hi").alias("score_j"), F.col("s_lo").alias("score_k"), "pair_rank"))


def best_worst(answers: DataFrame) -> DataFrame:
    """One (best, worst) pair per question: best = highest score
    (earliest position on ties), worst = lowest score (latest position).
    ``max_by``/``min_by`` aggregate partially before the shuffle, so a hot
    question costs no more than a cold one."""
    key = F.struct(F.col("pm_score"), (-F.col("pos")).alias("neg_pos"))
    val = F.struct("pos", "text", "pm_score")
    agg = answers.groupBy("qid").agg(F.max_by(val, key).alias("b"), F.min_by(val, key).alias("w"))
    return agg.select("qid",
                      F.col("b.pos").cast("bigint").alias("best_pos"),
                      F.col("w.pos").cast("bigint").alias("worst_pos"),
                      F.col("b.text").alias("response_j"), F.col("w.text").alias("response_k"),
                      F.col("b.pm_score").cast("bigint").alias("score_j"),
                      F.col("w.pm_score").cast("bigint").alias("score_k"))


def pair_stats(answers: DataFrame, max_pairs: int = 10) -> DataFrame:
    """A4/A5: per question, answer count, the reference's ``n*n/2``
    estimate, the exact non-tied pair count and the count after the cap.

    Exact count without enumerating pairs: non-tied pairs = C(n,2) minus
    the sum over score groups of C(g,2); two small aggregations."""
    per_score = answers.groupBy("qid", "pm_score").agg(F.count(F.lit(1)).alias("g"))
    ties = per_score.groupBy("qid").agg(F.sum(F.col("g") * (F.col("g") - 1) / 2).alias("tied"),
                                        F.sum("g").alias("n"))
    n = F.col("n")
    n_pairs = (n * (n - 1) / 2 - F.col("tied")).cast("bigint")
    return ties.select("qid", n.cast("bigint").alias("n_answers"),
                       (n * n / 2.0).alias("half_sq"),
                       n_pairs.alias("n_pairs"),
                       F.least(n_pairs, F.lit(max_pairs)).cast("bigint").alias("n_capped"))


def expected_pairs(stats: DataFrame, *by: str) -> DataFrame:
    """A4 next to A5: over the rows of ``pair_stats`` (per group of ``by``, if
    named) the mean of ``n*n/2``, the estimate of pairs a question, and the
    exact mean and sums of pairs before and after the cap.

    Without ``by`` an empty table gives one row of zero questions and null
    means; with ``by`` it gives none.  Nulls of ``by`` are a group."""
    n = F.count(F.lit(1))
    return stats.groupBy(*by).agg(
        n.alias("n_questions"), F.round(F.avg("half_sq"), 6).alias("mean_half_sq"),
        F.round(F.avg("n_pairs"), 6).alias("mean_pairs"),
        F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("n_capped"), F.lit(0)).alias("n_capped"))


def pairs_from_records(records: DataFrame, max_pairs: int | None = 10, seed: int = 42) -> DataFrame:
    """X19/Z2 end to end: nested records in, one row per (capped) pair out,
    every input column except ``answers`` kept.  Questions with no pair
    disappear."""
    ans = answers_from_records(records)
    p = pairs(ans) if max_pairs is None else capped_pairs(ans, max_pairs, seed).drop("pair_rank")
    return records.drop("answers").join(p, "qid")
