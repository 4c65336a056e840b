"""Greedy-matching embedding score (BERTScore form) over a token
vector table supplied by the caller (no model is shipped).

For a (prediction, reference) pair with token vectors p_i and r_j:
P = mean_i max_j cos(p_i, r_j), R = mean_j max_i cos(p_i, r_j),
F = 2PR / (P + R) (0 when P + R = 0); a side without tokens gives 0.

The table is ``token STRING, vec ARRAY<DOUBLE>``; tokens are the keys, so ids
play no part.  Tokens it does not hold, and tokens whose vector is null, empty
or has a null or non-finite component, count on neither side.  A zero vector
has cosine 0 with all.  Of several rows of a token the least vector holds.
Vectors are brought to unit length once, in the JVM, whatever their magnitude.

The scores are the same by both physical plans, of which the checked size of
the unit vectors chooses:

* ``broadcast``: they are under ``max_broadcast_bytes`` and go to every
  executor once; a row needs no shuffle.
* ``join``: rows are dealt into packs of about ``PACK_ROWS``.  The distinct tokens
  of a pack meet their vectors in a shuffle join (a hot token has one row a pack)
  and go to the pack's rows, so a vector is sent once for all rows of a pack.

Cosines are taken inside the pair.  A table of token pairs joined back would
shuffle |p| x |r| rows a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST = 64 << 20
PACK_ROWS = 8192           # rows that share one set of vectors

_PRF = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType()),
                     T.StructField("f", T.DoubleType())])


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``token, vec``: one vector of length 1 (or 0) per usable token."""
    v = F.col("vec").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    one = (vectors.where(F.col("token").isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)))
           .groupBy("token").agg(F.min(v).alias("vec")))
    # components are scaled by the largest first, so that squares neither vanish nor overflow
    most = F.array_max(F.transform("vec", F.abs))
    scaled = one.withColumn("vec", F.when(most > 0, F.transform("vec", lambda x: x / most)).otherwise(F.col("vec")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return (scaled.withColumn("norm", norm)
            .select("token", F.when(F.col("norm") > 0, F.transform("vec", lambda x: x / F.col("norm"))).otherwise(F.col("vec")).alias("vec")))


def _greedy(pm: np.ndarray, rm: np.ndarray):
    """P, R, F of unit vectors."""
    if len(pm) == 0 or len(rm) == 0:
        return 0.0, 0.0, 0.0
    sim = pm @ rm.T
    p, r = float(sim.max(axis=1).mean()), float(sim.max(axis=0).mean())
    f = 2 * p * r / (p + r) if p + r != 0 else 0.0
    return p, r, f


def _score_tokens_factory(bc):
    @F.pandas_udf(_PRF)
    def score_tokens(p_tokens: pd.Series, r_tokens: pd.Series) -> pd.DataFrame:
        place, mat = bc.value

        def side(tokens):
            return mat[[place[t] for t in ([] if tokens is None else tokens) if t in place]]
        return pd.DataFrame([_greedy(side(a), side(b)) for a, b in zip(p_tokens, r_tokens)], columns=["p", "r", "f"])
    return score_tokens


def _score_pack(rows: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a pack with ``_p``, ``_r``, ``_f``, by the pack's vectors."""
    tokens = known.column("token").combine_chunks()
    mat = known.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    mat = mat.reshape(len(tokens), -1) if len(tokens) else np.zeros((0, 1))

    def side(name):
        lists = rows.column(name).combine_chunks()
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=tokens), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return [part[part >= 0] for part in np.split(at, ends[:-1])]
    out = np.array([_greedy(mat[a], mat[b]) for a, b in zip(side("_pt"), side("_rt"))], dtype=np.float64).reshape(-1, 3)
    rows = rows.drop_columns(["_pack", "_pt", "_rt"])
    for name, column in zip(("_p", "_r", "_f"), out.T):
        rows = rows.append_column(name, pa.array(column))
    return rows


def bertscore(df: DataFrame, keys, vectors: DataFrame, pred_tokens: str = "pred_tokens",
              ref_tokens: str = "ref_tokens", prefix: str = "bert", ndigits=6,
              strategy: str = "auto", max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST,
              passthrough=(), near=()) -> DataFrame:
    """Score every row of ``df`` (one pair per row, told apart by ``keys``).
    ``vectors`` is ``token STRING, vec ARRAY<DOUBLE>``, all vectors of one
    length.  ``passthrough`` columns are carried to the output (no join back
    needed by callers).  Rows that agree in ``near`` (``keys``, if none are
    given) share a pack of the join; name columns of few rows a value whose
    texts share tokens."""
    spark = df.sparkSession
    units = unit_vectors(vectors)
    if strategy == "auto":
        # the check reads sizes only: what is sent holds at most this many bytes
        size = vectors.agg(F.sum(8 * F.size("vec") + F.octet_length("token") + 64)).first()[0] or 0
        strategy = "broadcast" if size <= max_broadcast_bytes else "join"
    rnd = (lambda c: F.round(c, ndigits)) if ndigits is not None else (lambda c: c)
    kcols = [F.col(k) for k in keys] + [F.col(c) for c in passthrough]

    if strategy == "broadcast":
        rows = units.collect()  # size checked above
        mat = np.array([r["vec"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
        bc = spark.sparkContext.broadcast(({r["token"]: k for k, r in enumerate(rows)}, mat))
        ids, s = df, _score_tokens_factory(bc)(F.col(pred_tokens), F.col(ref_tokens))
    else:
        packs = max(1, -(-df.count() // PACK_ROWS))
        pack = F.pmod(F.xxhash64(*(near or keys)), F.lit(packs)).cast("int")
        rows = df.select(pack.alias("_pack"), *[c.alias(f"_c{i}") for i, c in enumerate(kcols)],
                         F.col(pred_tokens).alias("_pt"), F.col(ref_tokens).alias("_rt"))
        none = F.array().cast("array<string>")
        asked = rows.select("_pack", F.explode(F.array_union(F.coalesce("_pt", none), F.coalesce("_rt", none))).alias("token")).distinct()
        met = asked.join(units, "token").select(F.col("_pack").alias("_at"), "token", "vec")
        kept = [f for f in rows.schema.fields if f.name not in ("_pack", "_pt", "_rt")]
        scored = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in ("_p", "_r", "_f")]])
        # a pack is PACK_ROWS pairs and the vectors of their distinct tokens, whatever the input's size
        done = rows.groupBy("_pack").cogroup(met.groupBy("_at")).applyInArrow(_score_pack, scored)
        names = [*keys, *passthrough]
        scores = F.struct(F.col("_p").alias("p"), F.col("_r").alias("r"), F.col("_f").alias("f")).alias("_scores")
        ids = done.select(*[F.col(f.name).alias(n) for f, n in zip(kept, names)], scores)
        s = F.col("_scores")
    return ids.select(*kcols, rnd(s["p"]).alias(f"{prefix}_p"), rnd(s["r"]).alias(f"{prefix}_r"),
                      rnd(s["f"]).alias(f"{prefix}_f"))
