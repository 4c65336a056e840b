"""Row positions and everything built on them: W2 (dense row index), F3-F5
(positional slices / picks), F6-F7 (seeded shuffle and sample), F8-F10
(named, fractional and hashed splits), F11 (fixed-size batches), F13/J5
(fixed sample semi/anti joins).

DataFrames have no order, so a position is always the rank under a declared
total order.  The dense index is computed the way ``zipWithIndex`` does it,
but on DataFrames: one range-partitioned sort, a per-partition count (one
small row per partition), offsets broadcast back (bounded by the number of
partitions), ``monotonically_increasing_id`` minus the partition base for the
local position.  The sorted, tagged frame is checkpointed to the cluster's
checkpoint directory first, so the counts and the final rows come from the
same materialised partitions even if executors are lost.  Under the seeded
shuffle order the index needs no sort at all (``seeded_index``: md5 prefix
buckets, bucket counts, broadcast offsets, ``row_number`` per bucket).  No
unpartitioned window ever touches the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.functions.text import seeded_key
from qforge.session import ensure_checkpoint_dir


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_row_index(df: DataFrame, order, idx_col: str = "row_idx", with_total: bool = False):
    """Dense 0-based ``idx_col`` by the total order ``order``.

    ``order`` must be a total order (append a unique key) so positions are
    deterministic.  Returns the frame, or ``(frame, total_rows)``."""
    from pyspark import StorageLevel
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # the range sort reads its input twice (sample for the bounds, then the
    # shuffle); keep a computed input for the second read.  Recomputing it
    # after a lost executor is safe: the inputs here are deterministic.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    tagged = (src.orderBy(*_cols(order))
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    src.unpersist()
    counts = sorted((r["_pid"], r["_n"]) for r in
                    tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for pid, n in counts:
        offsets.append((pid, acc))
        acc += n
    total = acc
    if offsets:
        off_df = spark.createDataFrame(offsets, "_pid int, _off bigint")
    else:
        off_df = spark.createDataFrame([], "_pid int, _off bigint")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    out = (tagged.join(F.broadcast(off_df), "_pid")
           .withColumn(idx_col, F.col("_off") + local)
           .drop("_pid", "_mid", "_off"))
    return (out, total) if with_total else out


def seeded_index(df: DataFrame, key_col: str, seed: int = 42, idx_col: str = "row_idx",
                 with_total: bool = False, buckets: int = 1 << 16):
    """W2 for the seeded shuffle order ``md5(seed:key), key`` (F6), exact and
    without a global sort.

    md5 keys are uniform, so the first 12 hex digits cut the order into
    ``buckets`` near-equal ranges (bucket number is monotone in the order).
    One aggregation gives the rows per non-empty bucket (at most ``buckets``
    small rows, read back to the driver), offsets are broadcast (same bound),
    and ``row_number`` runs inside each bucket: n / 65536 rows per window
    partition by default, about 1.5M rows at 10^11 rows.
    Every step is deterministic, so no checkpoint is needed; ``key_col``
    must be unique (a total order)."""
    spark = df.sparkSession
    key = seeded_key(seed, key_col)
    frac = F.conv(F.substr(key, F.lit(1), F.lit(12)), 16, 10).cast("decimal(20,0)")
    bucket = F.least(F.lit(buckets - 1),
                     F.floor(frac * F.lit(buckets) / F.lit(16 ** 12)).cast("bigint"))
    tagged = df.withColumn("_bk", bucket).withColumn("_key", key)
    counts = sorted((r["_bk"], r["_n"]) for r in
                    tagged.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n")).collect())
    offsets, acc = [], 0
    for b, c in counts:
        offsets.append((b, acc))
        acc += c
    off_df = spark.createDataFrame(offsets or [], "_bk bigint, _off bigint")
    w = Window.partitionBy("_bk").orderBy("_key", key_col)
    out = (tagged.join(F.broadcast(off_df), "_bk")
           .withColumn(idx_col, F.col("_off") + F.row_number().over(w) - 1)
           .drop("_bk", "_key", "_off"))
    return (out, acc) if with_total else out


def seeded_order(key_col, seed: int = 42) -> list[Column]:
    """partition-independent shuffle order ``md5(seed:key), key``."""
    return [seeded_key(seed, key_col), F.col(key_col) if isinstance(key_col, str) else key_col]


HISTOGRAM = 4096           # ranges a refinement counts
FINE = 1 << 16             # rows a boundary range may hold


def _between(df: DataFrame, key: str, start: int, stop: int) -> tuple[DataFrame, int]:
    """Rows of few key ranges that hold ranks ``[start, stop)`` of the order by
    ``key`` (nulls first), and how many rows come before them.

    One histogram holds both bounds; then only the range with a bound is
    counted again, finer, until it holds few rows or one key."""
    k = F.col(f"`{key}`")
    n, nulls, least, most = df.agg(F.count(F.lit(1)), F.count_if(k.isNull()), F.min(k), F.max(k)).first()
    if start >= n or stop <= start:
        return df.where(F.lit(False)), 0
    if stop <= nulls:
        return df.where(k.isNull()), 0
    seen: dict[tuple, list] = {}

    def histogram(a: int, b: int) -> list:
        """(first key, last key, rows) of the non-empty ranges of ``a .. b``."""
        if (a, b) not in seen:
            width = -(-(b - a + 1) // HISTOGRAM)
            place = F.call_function("div", k.cast("decimal(20,0)") - F.lit(a).cast("decimal(20,0)"), F.lit(str(width)).cast("decimal(20,0)"))
            counts = df.where((k >= a) & (k <= b)).groupBy(place.cast("bigint").alias("place")).agg(F.count(F.lit(1)).alias("n"))
            seen[a, b] = [(a + r.place * width, min(b, a + (r.place + 1) * width - 1), r.n) for r in sorted(counts.collect())]   # HISTOGRAM rows at most
        return seen[a, b]

    def cut(rank: int) -> tuple[int, int, int]:
        """The range that holds ``rank``, as (first key, last key, rows before)."""
        a, b, before, rows = int(least), int(most), nulls, n - nulls
        while rows > FINE and a < b:
            for a, b, rows in histogram(a, b):
                if before + rows > rank:
                    break
                before += rows
        return a, b, before
    last = cut(min(stop, n) - 1)[1]
    if start < nulls:
        return df.where(k.isNull() | (k <= last)), 0
    first, _, before = cut(start)
    return df.where((k >= first) & (k <= last)), before


def position_slice(df: DataFrame, order, start: int, stop: int, idx_col: str = "row_idx") -> DataFrame:
    """rows whose position is in ``[start, stop)`` of ``order``.

    Where the first column is an integer, the key ranges that hold the bounds
    are found by counting (``_between``); the table is then filtered to the
    slice's keys, and only the slice and the rows of its two boundary ranges
    are sorted, however large the table.  Other orders are indexed whole, by
    their key columns where these are names.  Fewer rows than ``start`` give
    none; an empty range gives none."""
    named = all(isinstance(c, str) for c in order)
    before, start = 0, max(start, 0)
    if named and df.schema[order[0]].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        df, before = _between(df, order[0], start, stop)
    keys = list(order) if named and set(order) != set(df.columns) else None
    out = with_row_index(df.select(*keys) if keys else df, keys or order, idx_col).withColumn(idx_col, F.col(idx_col) + F.lit(before).cast("bigint"))
    out = out.where((F.col(idx_col) >= start) & (F.col(idx_col) < stop))
    if keys is None:
        return out
    # the order is a key: a slice meets its rows again by it
    own = out.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], idx_col)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    return df.join(own, same).select(*df.columns, idx_col)


def row_at(df: DataFrame, order, position: int, idx_col: str = "row_idx") -> DataFrame:
    """the one row at ``position``; none beyond the end."""
    return position_slice(df, order, position, position + 1, idx_col)


def seeded_sample(df: DataFrame, key_col: str, k: int, seed: int = 42) -> DataFrame:
    """exactly ``min(k, n)`` rows, the first k of the seeded shuffle.

    md5 keys are uniform, so the k smallest keys almost surely lie below a
    threshold of about ``k/n`` of the key space.  Rows under a safe multiple
    of it are kept (a filter, no shuffle), and the exact top-k runs on those
    few survivors; if fewer than k survive, the threshold doubles.  The final
    single-task merge therefore handles O(k) rows, independent of n and of
    the number of partitions."""
    key = seeded_key(seed, key_col)
    prefix = F.conv(F.substr(key, F.lit(1), F.lit(12)), 16, 10).cast("double") / float(16 ** 12)
    n = df.count()
    if k >= n:
        return df
    frac = min(1.0, 2.0 * k / n + 64.0 / n)
    while True:
        cand = df.where(prefix < F.lit(frac)) if frac < 1.0 else df
        if frac >= 1.0 or cand.count() >= k:
            return cand.orderBy(*seeded_order(key_col, seed)).limit(k)
        frac = min(1.0, frac * 2)


def _index(df, order, idx_col, with_total=False, seed_key=None, seed=42):
    if seed_key is not None:
        return seeded_index(df, seed_key, seed, idx_col, with_total)
    return with_row_index(df, order, idx_col, with_total)


def named_splits(df: DataFrame, order, cuts, split_col: str = "split",
                 idx_col: str = "row_idx", seed_key: str | None = None, seed: int = 42) -> DataFrame:
    """F8: consecutive named splits after a shuffle.

    ``cuts`` is ``[(name, size), ..., (last_name, None)]``; the last split
    takes the rest.  With ``seed_key`` the order is the seeded shuffle and
    positions come from ``seeded_index`` (no global sort)."""
    out = _index(df, order, idx_col, seed_key=seed_key, seed=seed)
    expr, lo = None, 0
    for name, size in cuts:
        if size is None:
            cond_val = F.lit(name)
            expr = cond_val if expr is None else expr.otherwise(cond_val)
            break
        hi = lo + size
        cond = (F.col(idx_col) >= lo) & (F.col(idx_col) < hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo = hi
    return out.withColumn(split_col, expr)


def holdout_split(df: DataFrame, key_col: str, test_size: float = 0.05, seed: int = 42,
                  idx_col: str = "row_idx") -> DataFrame:
    """``train_test_split(test_size)``: the first ``ceil(test_size*n)``
    rows of the seeded shuffle are the test split."""
    out, n = seeded_index(df, key_col, seed, idx_col, with_total=True)
    n_test = math.ceil(test_size * n)
    return out.withColumn("split", F.when(F.col(idx_col) < n_test, F.lit("test")).otherwise(F.lit("train")))


def hash_split(df: DataFrame, key_col: str, seed: int = 42,
               parts=(("train", 8), ("validation", 1), ("test", 1))) -> DataFrame:
    """stable hash buckets (80/10/10 by default); no shuffle at all."""
    from qforge.functions.text import seeded_bucket
    total = sum(p for _, p in parts)
    b = seeded_bucket(seed, key_col, total)
    expr, lo = None, 0
    for name, p in parts:
        cond = (b >= lo) & (b < lo + p)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
        lo += p
    return df.withColumn("bucket", b).withColumn("split", expr)


def batches(df: DataFrame, order, batch_size: int = 16, drop_last: bool = True,
            idx_col: str = "row_idx", seed_key: str | None = None, seed: int = 42) -> DataFrame:
    """``batch_id = position div batch_size``; the last partial batch
    is dropped, as the reference does."""
    out, n = _index(df, order, idx_col, with_total=True, seed_key=seed_key, seed=seed)
    out = out.withColumn("batch_id", F.floor(F.col(idx_col) / batch_size).cast("bigint"))
    if drop_last:
        out = out.where(F.col("batch_id") < n // batch_size)
    return out


def contiguous_shard(row_idx: Column, total: int, num_shards: int) -> Column:
    """Shard of a row under ``shard(num_shards, i, contiguous=True)``: the
    first ``total % num_shards`` shards hold one extra row."""
    div, mod = divmod(total, num_shards)
    big = (div + 1) * mod
    if div == 0:
        return row_idx
    return F.when(row_idx < big, F.floor(row_idx / (div + 1))) \
        .otherwise(F.lit(mod) + F.floor((row_idx - big) / div)).cast("bigint")


BLOCK = 1 << 16            # rows, and blocks of rows, that one window task sums


def running_mean(df: DataFrame, value_col: str, group_col: str, order_col: str,
                 out_col: str = "running_mean", block: int = BLOCK) -> DataFrame:
    """Mean so far per group in ``order_col`` order, as a prefix scan.

    A plain ``avg over (partition by group order by pos)`` puts a whole group
    in one task.  Here rows get dense positions by (group, order) first, so
    that blocks of ``block`` positions hold that many rows whatever the ids.
    Sums of blocks, and of blocks of blocks, are small tables; a prefix over
    each level inside the one above and a running sum inside each block make
    up a row's mean.  No window holds more than ``block`` rows, but the top
    one: a group's rows by ``block`` squared.

    The indexed rows are a checkpoint, so ``df`` is computed once.  Null values
    count in no mean (null before a group's first value); a null group is a
    group; ``order_col`` must be unique within a group."""
    pos = with_row_index(df, [group_col, order_col], "_pos")
    base = pos.withColumn("_b1", F.floor(F.col("_pos") / block).cast("bigint")).withColumn("_b2", F.floor(F.col("_b1") / block).cast("bigint"))

    def before(sums, parts, by):
        w = Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return (sums.withColumn("_ps", F.coalesce(F.sum("_s").over(w), F.lit(0.0))).withColumn("_pc", F.coalesce(F.sum("_c").over(w), F.lit(0))))
    level1 = base.groupBy(group_col, "_b2", "_b1").agg(F.coalesce(F.sum(value_col), F.lit(0)).cast("double").alias("_s"), F.count(value_col).alias("_c"))
    level2 = level1.groupBy(group_col, "_b2").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    top = before(level2, [group_col], "_b2").select(F.col(group_col).alias("_g"), F.col("_b2").alias("_t"), F.col("_ps").alias("_ts"), F.col("_pc").alias("_tc"))
    mid = before(level1, [group_col, "_b2"], "_b1").join(top, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_b2") == F.col("_t"))) \
        .select(F.col(group_col).alias("_g"), F.col("_b1").alias("_t"), (F.col("_ps") + F.col("_ts")).alias("_ps"), (F.col("_pc") + F.col("_tc")).alias("_pc"))
    inside = Window.partitionBy(group_col, "_b1").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    count = F.col("_pc") + F.count(value_col).over(inside)
    return (base.join(mid, F.col(group_col).eqNullSafe(F.col("_g")) & (F.col("_b1") == F.col("_t")))
            .withColumn(out_col, F.when(count > 0, (F.col("_ps") + F.coalesce(F.sum(value_col).over(inside), F.lit(0.0))) / count))
            .drop("_pos", "_b1", "_b2", "_g", "_t", "_ps", "_pc"))
