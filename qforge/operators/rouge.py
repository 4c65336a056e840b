"""ROUGE-1/2 (M1), ROUGE-L (M2), ROUGE-Lsum (M3), ROUGE-S (M4) per row.

Scores are computed inside each (prediction, reference) row.  ROUGE-N merges
sorted grams in one fold, ROUGE-L folds a bit vector of any length, both in the
JVM; ROUGE-S counts token pairs in numpy and ROUGE-Lsum (sentence-level union
LCS) is the one Python-only piece.

Definitions (clipped counts, P/R/F as the public ``rouge_score`` package):
P = overlap / max(#pred grams, 1), R = overlap / max(#ref grams, 1),
F = 2PR / (P + R), 0 when P + R = 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qforge.functions.arrays import clipped_overlap, lcs_bitparallel, ngrams, token_masks
from qforge.functions.text import metric_tokens


def _round(ndigits):
    return (lambda c: F.round(c, ndigits)) if ndigits is not None else (lambda c: c)


def _prf_stage(t: DataFrame, prefix: str, ndigits=6) -> DataFrame:
    """P, R and F from ``_<prefix>_o`` / ``_np`` / ``_nr`` columns.  Each
    intermediate is its own projection, so Catalyst evaluates it once
    (CollapseProject never duplicates a non-trivial expression)."""
    o, n_p, n_r = F.col(f"_{prefix}_o"), F.col(f"_{prefix}_np"), F.col(f"_{prefix}_nr")
    t = t.withColumn(f"_{prefix}_p", o / F.greatest(n_p, F.lit(1))) \
         .withColumn(f"_{prefix}_r", o / F.greatest(n_r, F.lit(1)))
    p, r = F.col(f"_{prefix}_p"), F.col(f"_{prefix}_r")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    rnd = _round(ndigits)
    return t.withColumn(f"{prefix}_p", rnd(p)).withColumn(f"{prefix}_r", rnd(r)) \
            .withColumn(f"{prefix}_f", rnd(f))


def with_tokens(df: DataFrame, pred_col: str = "prediction", ref_col: str = "reference") -> DataFrame:
    """X14 on both sides: ``pred_tokens``, ``ref_tokens``."""
    return df.withColumn("pred_tokens", metric_tokens(pred_col)) \
             .withColumn("ref_tokens", metric_tokens(ref_col))


def overlap_stage(t: DataFrame, prefix: str, pred_grams, ref_grams, ndigits=6) -> DataFrame:
    """Clipped gram overlap in three projections: grams, their overlap, then
    P/R/F."""
    gp, gr = f"_{prefix}_gp", f"_{prefix}_gr"
    t = t.withColumn(gp, pred_grams).withColumn(gr, ref_grams)
    t = (t.withColumn(f"_{prefix}_o", clipped_overlap(gp, gr))
          .withColumn(f"_{prefix}_np", F.size(gp)).withColumn(f"_{prefix}_nr", F.size(gr)))
    return _prf_stage(t, prefix, ndigits)


def rouge_n_stage(t: DataFrame, n: int, prefix: str | None = None, ndigits=6) -> DataFrame:
    return overlap_stage(t, prefix or f"rouge{n}", ngrams("pred_tokens", n), ngrams("ref_tokens", n), ndigits)


def rouge_n_exploded(t: DataFrame, keys, ns=(1, 2), ndigits=6) -> DataFrame:
    """ROUGE-N for long texts, all ``ns`` in one pass.  Both sides' grams are
    exploded once with a side tag, counted per (row, n, gram) -- partial
    aggregation, so a frequent gram is combined map side -- and folded per
    row: overlap = sum(min(pred count, ref count)), gram totals = sums of
    the counts.  Linear in text length, two shuffles, input read once.  A
    sentinel element keeps rows that have no grams at all."""
    k = list(keys)

    def tagged(col, side, n):
        return F.transform(ngrams(col, n), lambda g: F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"),
                                                                g.alias("g")))
    parts = [tagged(c, side, n) for n in ns for side, c in ((0, "pred_tokens"), (1, "ref_tokens"))]
    sentinel = F.array(F.struct(F.lit(-1).alias("side"), F.lit(0).alias("n"),
                                F.lit(None).cast("string").alias("g")))
    items = t.select(*k, F.inline(F.concat(*parts, sentinel)))
    per_gram = items.groupBy(*k, "n", "g").agg(
        F.count_if(F.col("side") == 0).alias("cp"), F.count_if(F.col("side") == 1).alias("cr"))
    aggs = []
    for n in ns:
        on = F.col("n") == n
        aggs += [F.sum(F.when(on, F.least("cp", "cr")).otherwise(0)).alias(f"_rouge{n}_o"),
                 F.sum(F.when(on, F.col("cp")).otherwise(0)).alias(f"_rouge{n}_np"),
                 F.sum(F.when(on, F.col("cr")).otherwise(0)).alias(f"_rouge{n}_nr")]
    res = per_gram.groupBy(*k).agg(*aggs)
    out = []
    for n in ns:
        res = _prf_stage(res, f"rouge{n}", ndigits)
        out += [f"rouge{n}_p", f"rouge{n}_r", f"rouge{n}_f"]
    return res.select(*k, *out)


SKIP_BLOCK = 64            # first tokens whose pairs are counted together


def _pairs_after(codes: np.ndarray, first: int, size: int, d: int) -> np.ndarray:
    """``c[b, a]``: how often token b comes anywhere after token ``first + a``,
    for all d tokens b and ``size`` tokens a.  Every token occurs."""
    before = (codes[:, None] == np.arange(first, first + size)).cumsum(0)
    order = np.argsort(codes, kind="stable")
    heads = np.searchsorted(codes[order], np.arange(d))
    counts = np.add.reduceat(before[order], heads, axis=0)
    # an occurrence was counted as before itself
    own = np.arange(first, first + size)
    counts[own, own - first] -= np.bincount(codes, minlength=d)[own]
    return counts


def skip_overlap(pred: list, ref: list) -> int:
    """Clipped overlap of ordered token pairs.  Only tokens common to both
    sides count; pairs are counted for ``SKIP_BLOCK`` first tokens at a time, so
    memory is ``SKIP_BLOCK`` times the common tokens' occurrences."""
    ids = {t: k for k, t in enumerate(sorted(set(pred) & set(ref)))}
    if not ids:
        return 0
    p, r = (np.array([ids[t] for t in side if t in ids]) for side in (pred, ref))
    total = 0
    for first in range(0, len(ids), SKIP_BLOCK):
        size = min(SKIP_BLOCK, len(ids) - first)
        total += int(np.minimum(_pairs_after(p, first, size, len(ids)), _pairs_after(r, first, size, len(ids))).sum())
    return total


@F.pandas_udf(T.LongType())
def _skip_overlap(pred: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([skip_overlap(list(p), list(r)) for p, r in zip(pred, ref)], dtype="int64")


def rouge_s_stage(t: DataFrame, prefix: str = "rougeS", ndigits=6) -> DataFrame:
    """Clipped overlap of ordered token pairs from counts per pair of common
    tokens: time grows with the text times its distinct common tokens, memory
    with the text; no pair of positions and no square of the tokens is built."""
    def n_pairs(col):
        return F.expr(f"cast(size({col}) as bigint) * (size({col}) - 1) div 2")
    t = (t.withColumn(f"_{prefix}_o", _skip_overlap("pred_tokens", "ref_tokens"))
          .withColumn(f"_{prefix}_np", n_pairs("pred_tokens")).withColumn(f"_{prefix}_nr", n_pairs("ref_tokens")))
    return _prf_stage(t, prefix, ndigits)


def lcs_stage(t: DataFrame) -> DataFrame:
    """``_lcs``: native bit-parallel LCS of token lists of any length."""
    t = t.withColumn("_masks", token_masks("pred_tokens"))
    return t.withColumn("_lcs", lcs_bitparallel("pred_tokens", "ref_tokens", "_masks")).drop("_masks")


def rouge_l_stage(t: DataFrame, prefix: str = "rougeL", ndigits=6) -> DataFrame:
    n_p, n_r = F.size("pred_tokens"), F.size("ref_tokens")
    empty = (n_p == 0) | (n_r == 0)
    t = t.withColumn(f"_{prefix}_p", F.when(empty, F.lit(0.0)).otherwise(F.col("_lcs") / n_p)) \
         .withColumn(f"_{prefix}_r", F.when(empty, F.lit(0.0)).otherwise(F.col("_lcs") / n_r))
    p, r = F.col(f"_{prefix}_p"), F.col(f"_{prefix}_r")
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    rnd = _round(ndigits)
    return t.withColumn(f"{prefix}_p", rnd(p)).withColumn(f"{prefix}_r", rnd(r)) \
            .withColumn(f"{prefix}_f", rnd(f))


_LSUM = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                      T.StructField("f", T.DoubleType())])


@F.pandas_udf(_LSUM)
def _lsum_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    import re
    from qforge.functions.lcs import union_lcs_hits
    tok = re.compile(r"[a-z0-9]+")

    def sents(text):
        return [tok.findall(s.lower()) for s in (text or "").split("\n") if len(s)]

    ps, rs, fs = [], [], []
    for p, r in zip(pred, ref):
        hits, m, n = union_lcs_hits(sents(r), sents(p))
        if not m or not n:
            ps.append(0.0), rs.append(0.0), fs.append(0.0)
            continue
        rec, prec = hits / m, hits / n
        ps.append(prec), rs.append(rec)
        fs.append(2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0)
    return pd.DataFrame({"p": ps, "r": rs, "f": fs})


def rouge_lsum_stage(t: DataFrame, pred_col: str = "prediction", ref_col: str = "reference",
                     prefix: str = "rougeLsum", ndigits=6) -> DataFrame:
    t = t.withColumn("_lsum", _lsum_udf(F.col(pred_col), F.col(ref_col)))
    rnd = _round(ndigits)
    return (t.withColumn(f"{prefix}_p", rnd(F.col("_lsum.p"))).withColumn(f"{prefix}_r", rnd(F.col("_lsum.r")))
            .withColumn(f"{prefix}_f", rnd(F.col("_lsum.f"))))


def rouge_scores(df: DataFrame, keys, pred_col: str = "prediction", ref_col: str = "reference",
                 metrics=("rouge1", "rouge2", "rougeL"), ndigits=6, keep=(),
                 method: str = "row") -> DataFrame:
    """All requested ROUGE variants for each row of ``df``.

    ``keys`` (and ``keep``, e.g. the token columns) are carried through;
    output has ``<metric>_p/_r/_f``.  ``method="row"`` scores inside each
    row (no shuffle; best for questions, titles, summaries);
    ``method="exploded"`` computes ROUGE-N by aggregation (linear in text
    length; for document-length texts).  ``keys`` must identify a row."""
    if method == "exploded":
        t = with_tokens(df, pred_col, ref_col)
        ns = [int(m[5:]) for m in metrics if m[5:].isdigit()]
        rest = [m for m in metrics if not m[5:].isdigit()]
        res = rouge_n_exploded(t, keys, ns, ndigits) if ns else None
        if keep:
            res = t.select(*keys, *keep).join(res, list(keys)) if res is not None else t.select(*keys, *keep)
        if rest:
            other = rouge_scores(df, keys, pred_col, ref_col, rest, ndigits)
            res = other if res is None else res.join(other, list(keys))
        return res
    t = with_tokens(df, pred_col, ref_col)
    out = []
    for m in metrics:
        if m == "rougeL":
            t = rouge_l_stage(lcs_stage(t), ndigits=ndigits)
        elif m == "rougeLsum":
            t = rouge_lsum_stage(t, pred_col, ref_col, ndigits=ndigits)
        elif m == "rougeS":
            t = rouge_s_stage(t, ndigits=ndigits)
        else:
            t = rouge_n_stage(t, int(m[5:]), ndigits=ndigits)
        out += [f"{m}_p", f"{m}_r", f"{m}_f"]
    return t.select(*keys, *keep, *out)
