"""Helpers shared by the operators: table reads, written intermediates and
connected components.

Intermediates are written as Parquet under the shared folder named by
``spark.checkpoint.dir`` and read back, which cuts lineage and survives lost
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qforge.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; callers select the columns they use."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Written intermediates of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, name)

    def path(self, part: str) -> str:
        return f"{self.base}/{part}"

    def keep(self, df: DataFrame, part: str) -> DataFrame:
        """Write ``df`` and read it back, so that its rows are computed once."""
        df.write.mode("overwrite").parquet(self.path(part))
        return self.spark.read.schema(df.schema).parquet(self.path(part))

    def drop(self, part: str) -> None:
        """Delete one intermediate that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(part))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges(a LONG, b LONG)`` gives ``node, root`` with root the least node of
    the component; roots and nodes without edges are absent.  Each half round is one
    aggregation and one join of written tables, so a node with very many
    edges is pre-aggregated in the first and split by the skew join in the
    second.  Null ends and self loops are ignored; repeated edges are merged;
    no edges give no rows."""
    cur = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"),
                                                    F.least("a", "b").alias("b")).distinct(), "cc_0")
    before = None
    for r in range(1, max_rounds + 1):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m"))
                           .select("a", F.least("a", "m").alias("m")), f"cc_m{r}")
        large = scratch.keep(both.where("b > a").join(low, "a")
                             .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), f"cc_l{r}")
        low2 = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), f"cc_n{r}")
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        nxt = scratch.keep(small.unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), f"cc_{r}")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for part in (f"cc_m{r}", f"cc_l{r}", f"cc_n{r}", f"cc_{r - 1}"):
            scratch.drop(part)
        cur = nxt
        if tuple(state) == before:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
