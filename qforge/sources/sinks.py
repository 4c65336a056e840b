"""Sinks: K1 (records as JSON lines), K2 (parallel-array document for a
bounded sample), K3 (scores + summary tables), K4/K5 (size-targeted,
contiguous shards per split), K7 (review sample).

FIXED VALUES: shard target 1000 << 20 bytes; shard count
``int(nbytes / target) + 1``; file name ``train-%05d-of-%05d.parquet``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge.operators.index import contiguous_shard, with_row_index

SHARD_BYTES = 1000 << 20


def estimated_bytes(df: DataFrame, cols) -> F.Column:
    """Per-row byte estimate: UTF-8 bytes of strings, 8 per number."""
    parts = []
    for c in cols:
        dt = df.schema[c].dataType.simpleString()
        parts.append(F.coalesce(F.octet_length(c), F.lit(0)) if dt == "string" else F.lit(8))
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out.cast("bigint")


def shard_plan(df: DataFrame, order, split_col: str = "split", shard_bytes: int = SHARD_BYTES,
               byte_cols=None, position_col: str | None = None) -> DataFrame:
    """Assign every row ``split, shard, num_shards, file_name``.

    Per split: ``num_shards = int(bytes / shard_bytes) + 1`` (one small
    aggregation), shards contiguous in ``order`` with the first
    ``n % num_shards`` one row longer.  Positions inside a split come from
    ``position_col`` when the rows already carry a dense position whose
    splits are contiguous ranges (named splits are): position minus the
    split's first position, no sort.  Otherwise one dense index over
    (split, order) is built.  A column ``_bytes`` of ``df`` is taken as the
    rows' sizes."""
    byte_cols = byte_cols or [c for c in df.columns if c not in (split_col, position_col)]
    sized = df if "_bytes" in df.columns else df.withColumn("_bytes", estimated_bytes(df, byte_cols))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")]
    if position_col:
        aggs.append(F.min(position_col).alias("first"))
    stats = {r[split_col]: r for r in sized.groupBy(split_col).agg(*aggs).collect()}
    if position_col:
        idx = sized.withColumn("_pos", F.col(position_col))
        firsts = {name: r["first"] for name, r in stats.items()}
    else:
        idx = with_row_index(sized, [F.col(split_col)] + list(order), "_pos")
        firsts, acc = {}, 0
        for name in sorted(stats):          # same order as the index: by split name
            firsts[name] = acc
            acc += stats[name]["n"]
    shard_expr, ns_expr = None, None
    for name, r in stats.items():
        ns = int(r["b"] / shard_bytes) + 1
        cond = F.col(split_col) == F.lit(name)
        s = contiguous_shard(F.col("_pos") - F.lit(firsts[name]), r["n"], ns)
        shard_expr = F.when(cond, s) if shard_expr is None else shard_expr.when(cond, s)
        ns_expr = F.when(cond, F.lit(ns)) if ns_expr is None else ns_expr.when(cond, F.lit(ns))
    out = idx.withColumn("shard", shard_expr.cast("bigint")) \
        .withColumn("num_shards", ns_expr.cast("bigint"))
    return out.withColumn("file_name", F.format_string("train-%05d-of-%05d.parquet",
                                                       F.col("shard"), F.col("num_shards"))) \
        .drop("_bytes")


def filesystem(spark, path: str):
    """Hadoop's file system of ``path`` and its path class."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _file_facts(rows: DataFrame, split_col: str) -> DataFrame:
    """``split, file_name, rows, bytes, checksum`` of stored shards; the
    checksum is the sum of the rows' hashes, whatever their order."""
    each = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns) if c != split_col]).cast("decimal(38,0)")
    return (rows.withColumn("_hash", each)
            .groupBy(F.col(split_col).cast("string").alias("split"), F.col("_metadata.file_name").alias("file_name"))
            .agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"),
                 F.sum("_hash").cast("string").alias("checksum")))


def write_shards(planned: DataFrame, path: str, split_col: str = "split") -> None:
    """K4/K5 writer: ``<path>/<split_col>=<split>/train-%05d-of-%05d.parquet``
    and a manifest (split, file_name, rows, bytes, checksum).

    One job writes all splits to a staging folder, rows of one shard in one
    task and one file, in position order; Spark's commit leaves one file a
    shard however often a task is tried.  Files are renamed into place, and
    the manifest, read off the stored files, is written last: a set without
    one is not complete, and ``read_shards`` refuses it.  What ``path`` held is
    replaced."""
    spark = planned.sparkSession
    fs, hadoop = filesystem(spark, path)
    fs.delete(hadoop(path), True)
    staging = f"{path}/_staging"
    (planned.withColumn("_split", F.col(split_col)).repartition("_split", "file_name")
     .sortWithinPartitions("_split", "file_name", "_pos").drop("_pos", "num_shards", split_col)
     .write.partitionBy("_split", "file_name").parquet(staging))
    for split in fs.listStatus(hadoop(staging)):
        if not split.isDirectory():
            continue
        target = f"{path}/{split_col}={split.getPath().getName().split('=', 1)[1]}"
        fs.mkdirs(hadoop(target))
        for shard in fs.listStatus(split.getPath()):
            part = next(f.getPath() for f in fs.listStatus(shard.getPath()) if f.getPath().getName().startswith("part-"))
            if not fs.rename(part, hadoop(f"{target}/{shard.getPath().getName().split('=', 1)[1]}")):
                raise OSError(f"could not rename {part}")
    fs.delete(hadoop(staging), True)
    schema = planned.drop("_pos", "num_shards", "file_name").schema
    facts = _file_facts(spark.read.schema(schema).parquet(path), split_col)
    facts.coalesce(1).write.json(f"{path}/_manifest")           # one row a shard


MANIFEST = "split string, file_name string, rows bigint, bytes bigint, checksum string"


def read_shards(spark, path: str, split_col: str = "split", verify: bool = True) -> DataFrame:
    """The rows of a complete shard set, with ``file_name``.

    The stored files must be those of the manifest; with ``verify`` their rows
    and checksums are compared too, file by file, before anything is given
    out.  A set without a manifest, a missing, extra or changed file is an error."""
    fs, hadoop = filesystem(spark, path)
    if not fs.exists(hadoop(f"{path}/_manifest/_SUCCESS")):
        raise FileNotFoundError(f"{path} has no manifest: the shard set is not complete")
    listed = spark.read.schema(MANIFEST).json(f"{path}/_manifest")
    rows = spark.read.parquet(path)
    rows = rows.withColumn(split_col, F.col(split_col).cast("string"))
    if verify:
        found, key = _file_facts(rows, split_col), ["split", "file_name", "rows", "bytes", "checksum"]
        wrong = listed.select(key).exceptAll(found.select(key)).unionByName(found.select(key).exceptAll(listed.select(key)))
        first = wrong.select("split", "file_name").first()
        if first is not None:
            raise ValueError(f"shard {first.split}/{first.file_name} is not as the manifest says")
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def write_json_records(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """K1/K7: valid JSON lines, one object per row, written by all tasks.  A null
    field is left out, or with ``keep_nulls`` written as ``null``; both are read
    back as null."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def read_json_records(spark, path: str, schema) -> DataFrame:
    """K1/K7 read back with a declared schema; a line that is not an object of
    that schema is an error, not a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def review_sample(qa: DataFrame, path: str, k: int = 100, seed: int = 42) -> None:
    """K7: ``k`` seeded records ``{id, context, question, answers}`` for review."""
    from qforge.operators.index import seeded_sample
    write_json_records(seeded_sample(qa, "id", k, seed).select("id", "context", "question", "answers"), path)


def parallel_array_doc(df: DataFrame, order_col: str, cols, max_rows: int = 1_000_000) -> DataFrame:
    """K2: one-row document of parallel arrays, for bounded samples only
    (checked: more than ``max_rows`` rows is an error)."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows do not fit one parallel-array document (limit {max_rows})")
    srt = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_ord"), *[F.col(c) for c in cols])))
    return df.agg(srt.alias("_rows")).select(*[F.col("_rows")[c].alias(c) for c in cols])


def write_scores(scores: DataFrame, summarise, path: str) -> DataFrame:
    """K3: ``scores`` (one row per id/model, with whatever texts it carries) in a
    folder per model, then ``summarise`` of them (per model, a few rows) as JSON.

    The summary is taken from the stored scores, so nothing is scored twice and
    the two always agree; it is written last and is returned as read back."""
    scores.write.mode("overwrite").partitionBy("model").parquet(f"{path}/scores")
    summary = summarise(read_scores(scores.sparkSession, path, scores.schema))
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return scores.sparkSession.read.schema(summary.schema).json(f"{path}/summary")


def read_scores(spark, path: str, schema, models=None) -> DataFrame:
    """K3 read back; of ``models``, if named, only their folders are read."""
    out = spark.read.schema(schema).parquet(f"{path}/scores")
    return out if models is None else out.where(F.col("model").isin(list(models)))
