"""Mixing sources to target weights by hash-threshold histograms.

Every row has a hash in [0, 2^52).  A source takes ``floor(target / size)``
whole copies of all its rows plus those rows whose hash is below its
threshold.  The threshold comes from sums of words by (source, hash bucket):
the bucket in which the running sum passes the budget is the only one
refined, by the next ``BITS`` bits, then by single hashes, so nothing is
sorted but at most ``2^BITS`` sums of a source and the rows of one bucket of a
bucket.  The last hash is taken when that brings the sum nearer to the
budget.

Targets: sources in code point order, null last, weigh ``weights`` in turn
and share ``share`` of all words; a target stops at ``most`` times its
source's words and the excess is shared again by weight.  The fixed point of
that is ``min(most * size, level * weight)``; ``level`` comes from running
sums over the sources, one row each.

Defined cases: a null text has size 0; a null source is a source; rows with
the same id and text have the same hash and are taken together; empty input
gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import Scratch

BITS = 13                      # 4 levels of 13 bits are the 52 bits of the hash
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column, seed: str) -> Column:
    """52 bits of md5(seed, id, md5(text))."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")),
                      F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, size``; one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pos = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), pos + 1).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * most)
    # sources in the order in which they reach their caps
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy()
    per = (per.withColumn("capped", F.coalesce(F.sum("cap").over(up), F.lit(0)))
           .withColumn("weight_left", F.sum("weight").over(rest) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
           .withColumn("total", F.sum("source_size").over(rest) * F.lit(float(share))))
    # the level if all sources from this one on are below their caps
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("weight_left"))
    open_ = F.col("level") * F.col("weight") < F.col("cap")
    per = per.withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(rest))
    target = F.least(F.col("cap").cast("double"),
                     F.coalesce(F.col("final.level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def mix(df: DataFrame, seed: str = "mix", weights=(5, 2, 1), share: float = 1.5, most: int = 2,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``, one row per row of
    ``df``; ``taken = copies * size``."""
    scratch = Scratch(df.sparkSession, "mix")
    sized = scratch.keep(df.select(F.col(f"`{id_col}`").alias("doc_id"), *_sized(id_col, text_col, source_col, seed)), "sizes")
    return _with_copies(sized, sized, scratch, weights, share, most) \
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, seed: str = "mix", weights=(5, 2, 1), share: float = 1.5, most: int = 2,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken."""
    scratch = Scratch(df.sparkSession, "mix")
    facts = _sized(id_col, text_col, source_col, seed)
    sizes = scratch.keep(df.select(*facts), "sizes")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *facts)
    return _with_copies(whole, sizes, scratch, weights, share, most).where("copies > 0") \
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")


def _sized(id_col: str, text_col: str, source_col: str, seed: str) -> list[Column]:
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"),
            row_hash(F.col(f"`{id_col}`"), text, seed).alias("h")]


def _with_copies(rows: DataFrame, sizes: DataFrame, scratch: Scratch, weights, share: float, most: int) -> DataFrame:
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = scratch.keep(targets.withColumn("whole", whole.cast("long"))
                           .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    limits = scratch.keep(thresholds(sizes, targets, scratch), "limits").withColumnRenamed("source", "of")
    limits = F.broadcast(limits) if _few(limits) else limits
    # a source at its cap has no budget left, but rows without words may lie below its threshold
    copies = F.least(F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0), F.lit(most).cast("long"))
    return rows.join(limits, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies)


def _few(limits: DataFrame, most: int = 100_000) -> bool:
    """Whether the per-source table is small enough to send to all tasks."""
    return limits.limit(most + 1).count() <= most


def thresholds(rows: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source the hash below which rows are taken once more.  Each level's
    state, one row a source, is written, so that plans stay small."""
    small = _few(targets)
    hint = F.broadcast if small else (lambda d: d)
    at = targets.withColumn("lo", F.lit(0).cast("long")).withColumn("got", F.lit(0).cast("long"))
    for level in range(4):
        width = 1 << (BITS * (3 - level))
        span = width << BITS
        near = rows.alias("r").join(
            hint(at).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))
            & (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + span))
        sums = near.groupBy(F.col("t.source").alias("source"), F.floor(F.col("h") / width).alias("bucket")) \
            .agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(run))
        # the first bucket whose running sum passes the budget
        hit = (sums.alias("s").join(hint(at).alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
               .where(F.col("t.got") + F.col("upto") > F.col("budget"))
               .groupBy(F.col("t.source").alias("source"))
               .agg(F.min(F.struct("bucket", (F.col("t.got") + F.col("upto") - F.col("words")).alias("got"),
                                   "words")).alias("hit")))
        at = (at.alias("t").join(hit.alias("x"), F.col("t.source").eqNullSafe(F.col("x.source")), "left")
              .select("t.source", "source_size", "target", "whole", "budget",
                      F.coalesce(F.col("x.hit.bucket") * width, F.col("lo") + span).alias("lo"),
                      F.coalesce("x.hit.got", "t.got").alias("got"), F.col("x.hit.words").alias("words")))
        # a source whose running sum never passes its budget takes the rest of its range
        at = scratch.keep(at.drop("words") if level < 3 else at, f"at_{level}")
    nearer = F.abs(F.col("got") + F.col("words") - F.col("budget")) < F.abs(F.col("got") - F.col("budget"))
    return at.select("source", "source_size", "target", "whole",
                     (F.col("lo") + F.when(nearer, 1).otherwise(0)).alias("threshold"))
