"""Scans of the driver tables and of files in the reference's formats.

S1-S4 are plain Parquet scans; Catalyst prunes columns and pushes filters
into them, so callers select only what they use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the driver data."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_qa(qa: DataFrame, path: str) -> None:
    """QA records with a ``split`` as Parquet, one folder per split, in one pass
    and without a shuffle."""
    from qforge.schemas import QA
    qa.select(*QA.fieldNames(), "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_qa(spark: SparkSession, path: str, split: str | None = None, unanswerable: bool = True) -> DataFrame:
    """QA records in Parquet with a declared schema.

    ``split`` keeps one split; of records stored by ``write_qa`` only that
    split's folder is read.  ``unanswerable=False`` gives the answerable-only
    version of the data: records without an answer (none, or a null list) go."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from qforge.schemas import QA
    df = spark.read.schema(T.StructType([*QA.fields, T.StructField("split", T.StringType())])).parquet(path)
    if not unanswerable:
        df = df.where(F.size("answers.answer_start") > 0)
    return df if split is None else df.where(df.split == split)
