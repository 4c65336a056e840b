"""J1 alignment of predictions with references, and the evaluation frame
the metric queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from qforge.functions.text import clean_eval, clean_reward, clean_target


def align(preds: DataFrame, refs: DataFrame, key: str = "id", how: str = "inner") -> DataFrame:
    """Keyed equi-join of predictions with references (never a
    positional zip).  ``how="full_outer"`` reports unmatched ids."""
    return preds.join(refs, key, how)


def eval_frame(preds: DataFrame, prompts: DataFrame, cleanup: str = "eval") -> DataFrame:
    """``id, model, prediction, reference, answer`` with the cleanup the
    evaluator (X6/X7) or the reward (X8 both sides) applies."""
    j = align(preds, prompts.select("id", "target", "answer"))
    if cleanup == "eval":
        return j.select("id", "model", clean_eval("prediction").alias("prediction"),
                        clean_target("target").alias("reference"), "answer")
    return j.select("id", "model", clean_reward("prediction").alias("prediction"),
                    clean_reward("target").alias("reference"), "answer")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt by key before heavy work on each.  The scan's split
    says nothing of that work: a small file would keep it in one task."""
    return rows.repartition(*keys)
