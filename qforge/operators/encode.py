"""Corpus vocabulary, fixed-length encoding, token budget.

Word-level ids (runs of non-space), not subwords: the reference's
pretrained tokenisers are per-row codecs; the table work around them --
counting, ranking, looking up, truncating, padding -- is what runs here.

FIXED VALUES: ``<pad>`` = 0, ``</s>`` = 1, ``<unk>`` = 2; corpus tokens get
ids from 3 by descending frequency (ties by token); inputs 512 ids, labels
32 ids; an encoded row is ``tokens[:n-1] + </s>`` padded with 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qforge.functions.arrays import pad_truncate
from qforge.functions.text import word_tokens

PAD, EOS, UNK = 0, 1, 2
N_SPECIAL = 3


def build_vocab(df: DataFrame, cols, max_size: int | None = None) -> DataFrame:
    """``token, tid, count``: all tokens by falling count, ties by token; with
    ``max_size`` only the ``max_size - 3`` most frequent ones.

    Counting is a partial+final aggregation (hot tokens are combined map
    side); the rank is the dense index of one range-partitioned sort, so no
    count value, token or list of counts has to fit one task or the driver."""
    from qforge.operators.index import with_row_index
    none = F.array().cast("array<string>")
    toks = df.select(F.explode(F.concat(*[F.coalesce(word_tokens(c), none) for c in cols])).alias("token"))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    ranked = with_row_index(counts, [F.desc("count"), F.col("token")], "_rank")
    if max_size is not None:
        ranked = ranked.where(F.col("_rank") < max_size - N_SPECIAL)
    return ranked.select("token", (F.col("_rank") + N_SPECIAL).alias("tid"), "count")


HOT_TOKENS = 1 << 16       # most frequent tokens, known to every task
HOT_LENGTH = 256           # bytes that such a token has at most
SLICE_ROWS = 1024          # rows of an Arrow batch that are looked up together
PLACE = 1 << 32            # column number above, position below


def _padded(seq, max_len: int):
    return (pad_truncate(seq, max_len, PAD), pad_truncate(F.array_repeat(F.lit(1), F.size(seq)), max_len, 0))


def _looked_up(batch: pa.RecordBatch, n_cols: int, tokens: pa.Array, tids: pa.Array) -> pa.RecordBatch:
    """``_k``, the ids of each column's tokens, null where ``tokens`` lacks one,
    and ``rare``, the missing ones with their places."""
    out, rows, places, words = [batch.column(0)], [], [], []
    for c in range(n_cols):
        lists = batch.column(c + 1)
        flat = lists.flatten()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        at = pc.index_in(flat, value_set=tokens)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), tids.take(at)))
        missing = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
        row = np.searchsorted(ends, missing, side="right")
        rows.append(row)
        places.append(c * PLACE + missing - offsets[row])
        words.append(flat.take(pa.array(missing)))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    rare = pa.StructArray.from_arrays([pa.array(np.concatenate(places)[order], pa.int64()),
                                       pa.concat_arrays(words).take(pa.array(order))], names=["place", "token"])
    ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), rare))
    return pa.RecordBatch.from_arrays(out, names=["_k", *(f"i{c}" for c in range(n_cols)), "rare"])


def encode_columns(df: DataFrame, key: str, specs: dict, vocab: DataFrame) -> DataFrame:
    """J7 + X18: ids of text columns, ``specs = {text_col: (max_len, out_col)}``:
    the first ``max_len - 1`` tokens, ``</s>`` appended, padded with ``<pad>``
    to ``max_len``; unknown tokens get ``<unk>``.  Masks are ``<out_col>_mask``.

    The ``HOT_TOKENS`` tokens of least id, which make up most occurrences, are
    broadcast and looked up a batch of rows at a time, so a row's tokens stay one
    array; only the others are exploded and meet their ids in a shuffle join,
    whose keys are all rare.  The arrays are stored once for both passes.  Rows
    are put together again by ``key``, which must be unique; rows that share a
    key share their tokens, a null key has none."""
    from qforge.session import scratch_path
    spark, cols = df.sparkSession, list(specs)
    is_hot = (F.col("tid") < HOT_TOKENS + N_SPECIAL) & (F.octet_length("token") <= HOT_LENGTH)
    hot = vocab.where(is_hot).select("token", F.col("tid").cast("int").alias("tid")).collect()    # HOT_TOKENS rows at most
    shared = spark.sparkContext.broadcast(([r.token for r in hot], [r.tid for r in hot]))
    n_cols = len(cols)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, tids = pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.int32())
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                yield _looked_up(batch.slice(first, SLICE_ROWS), n_cols, tokens, tids)

    texts = df.select(F.col(key).alias("_k"), *[F.slice(word_tokens(c), 1, specs[c][0] - 1).alias(f"t{i}") for i, c in enumerate(cols)])
    ints = [T.StructField(f"i{i}", T.ArrayType(T.IntegerType())) for i in range(n_cols)]
    rare = T.ArrayType(T.StructType([T.StructField("place", T.LongType()), T.StructField("token", T.StringType())]))
    schema = T.StructType([T.StructField("_k", texts.schema["_k"].dataType), *ints, T.StructField("rare", rare)])
    path = scratch_path(spark, "encoded")
    texts.mapInArrow(look_up, schema).write.parquet(path)
    coded = spark.read.schema(schema).parquet(path)

    late = (coded.where("_k is not null").select("_k", F.inline("rare"))
            .join(vocab.where(~is_hot).select("token", "tid"), "token", "left")
            .groupBy("_k").agg(F.collect_list("place").alias("places"), F.collect_list(F.coalesce("tid", F.lit(UNK)).cast("int")).alias("tids")))
    out = coded.groupBy("_k").agg(F.collect_list(F.struct(*[f.name for f in ints])).alias("rows")).join(late, "_k", "left")
    shown = [F.col("_k").alias(key)]
    for i, c in enumerate(cols):
        max_len, name = specs[c]
        none = F.array().cast("array<int>")
        at = lambda pos, i=i: F.array_position("places", pos.cast("bigint") + F.lit(i * PLACE)).cast("int") - 1
        own = F.transform(F.get("rows", 0)[f"i{i}"], lambda x, pos: F.coalesce(x, F.get("tids", at(pos))))
        # rows of one key: their tokens in the order of positions
        early = F.flatten(F.transform("rows", lambda r: F.filter(F.transform(r[f"i{i}"], lambda x, pos: F.struct(pos.cast("bigint").alias("pos"), x.alias("tid"))),
                                                                  lambda x: x["tid"].isNotNull())))
        rest = F.transform(F.filter(F.arrays_zip("places", "tids"), lambda x: F.floor(x["places"] / PLACE) == i),
                           lambda x: F.struct((x["places"] - i * PLACE).alias("pos"), x["tids"].alias("tid")))
        rest = F.coalesce(rest, F.array().cast("array<struct<pos:bigint,tid:int>>"))
        merged = F.transform(F.sort_array(F.concat(early, rest)), lambda x: x["tid"])
        ids = F.when(F.col("_k").isNull(), none).when(F.size("rows") == 1, own).otherwise(merged)
        out = out.withColumn(f"_seq_{name}", F.concat(ids, F.array(F.lit(EOS))))
        padded, mask = _padded(f"_seq_{name}", max_len)
        shown += [padded.alias(name), mask.alias(f"{name}_mask")]
    # as many rows of a key as came
    return out.withColumn("_each", F.explode(F.transform("rows", lambda r: F.lit(1)))).select(*shown)


def encode(df: DataFrame, key: str, col: str, vocab: DataFrame, max_len: int, out_col: str = "input_ids") -> DataFrame:
    """One text column: ``key, <out_col>, attention_mask``."""
    return encode_columns(df, key, {col: (max_len, out_col)}, vocab).withColumnRenamed(f"{out_col}_mask", "attention_mask")


def pad_to_longest(df: DataFrame, batch_col: str, seq_col: str, pad: int = PAD, width_col: str = "width") -> DataFrame:
    """Sequences padded to the longest of their batch; ``width_col`` is that
    length.  Batch maxima are one small aggregation joined back; each row is
    padded where it is.  A null sequence counts as empty; rows without a batch
    are a batch of their own kind."""
    size = F.coalesce(F.size(seq_col), F.lit(0))
    widths = df.groupBy(F.col(batch_col).alias("_batch")).agg(F.max(size).cast("bigint").alias(width_col))
    seq = F.coalesce(F.col(seq_col), F.array().cast(df.schema[seq_col].dataType))
    return (df.join(widths, F.col(batch_col).eqNullSafe(F.col("_batch")))
            .withColumn(seq_col, F.concat(seq, F.array_repeat(F.lit(pad).cast(df.schema[seq_col].dataType.elementType),
                                                              (F.col(width_col) - size).cast("int")))).drop("_batch"))


def ragged(ids, mask):
    """A padded sequence without its padding."""
    return F.slice(ids, 1, F.aggregate(mask, F.lit(0), lambda a, m: a + m))


def token_budget(df: DataFrame, cols_limits: dict) -> DataFrame:
    """Per text column, rows, share truncated at the limit, max and
    median token counts (one aggregation)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c, limit in cols_limits.items():
        n = F.size(word_tokens(c))
        aggs += [F.round(F.avg((n > limit - 1).cast("int")), 6).alias(f"{c}_truncated_share"),
                 F.max(n).cast("bigint").alias(f"{c}_max_tokens"),
                 F.round(F.percentile(n, 0.5), 6).alias(f"{c}_median_tokens")]
    return df.agg(*aggs)
