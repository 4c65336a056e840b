"""JSON formats of the reference: S5 (one document of parallel arrays, read
back to rows by position), S6 (JSON array of wide prediction records), S7
(object per line with a trailing comma), K2 (writing the parallel-array
document for a bounded sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parallel_arrays(spark: SparkSession, path: str, cols, schema=None) -> DataFrame:
    """``{"predictions": [...], "targets": [...]}`` to one row per
    position: ``posexplode(arrays_zip(..))``; ``row_idx`` is the position."""
    r = spark.read.option("multiLine", True)
    doc = (r.schema(schema) if schema is not None else r).json(path)
    z = F.arrays_zip(*[F.col(c) for c in cols])
    return doc.select(F.posexplode(z).alias("row_idx", "z")) \
        .select(F.col("row_idx").cast("bigint"), *[F.col("z")[c].alias(c) for c in cols])


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A file holding one JSON array of objects."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_trailing_comma_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """``{...},`` per line (not valid JSON lines).  The text is read as
    lines and the trailing comma cut before ``from_json``, so no row is lost
    to the reader's corrupt-record handling."""
    lines = spark.read.text(path)
    body = F.regexp_replace(F.col("value"), ",\\s*$", "")
    return lines.where(F.trim(F.col("value")) != "") \
        .select(F.from_json(body, schema).alias("r")).select("r.*")


def write_trailing_comma_lines(df: DataFrame, path: str) -> None:
    """The reference's review-sample format (K7 as written there)."""
    df.select(F.concat(F.to_json(F.struct(*df.columns)), F.lit(",")).alias("value")) \
        .write.mode("overwrite").text(path)


MAX_DOC_ROWS = 1_000_000


def write_parallel_arrays(df: DataFrame, order_col: str, cols, path: str,
                          max_rows: int = MAX_DOC_ROWS) -> None:
    """K2: one JSON document of parallel arrays.  The document is one row,
    so the input must be a bounded sample: more than ``max_rows`` rows is an
    error, not a silent single-task collect."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows do not fit one parallel-array document (limit {max_rows}); "
                         "write row-wise JSON instead")
    srt = F.sort_array(F.collect_list(F.struct(F.col(order_col).alias("_ord"), *[F.col(c) for c in cols])))
    doc = df.agg(srt.alias("_rows")).select(*[F.col("_rows")[c].alias(c) for c in cols])
    doc.coalesce(1).write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, max_rows: int = MAX_DOC_ROWS) -> None:
    """The wide-predictions file format (S6 input): one JSON array of
    objects in one file.  One row holds the array, so the input must be a
    bounded sample (checked)."""
    n = df.count()
    if n > max_rows:
        raise ValueError(f"{n} rows do not fit one JSON array file (limit {max_rows})")
    arr = F.to_json(F.collect_list(F.struct(*df.columns)))
    df.agg(arr.alias("value")).coalesce(1).write.mode("overwrite").text(path)
