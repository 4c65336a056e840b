"""Points of a metric space dealt into cells around pivots.

Shared by the vector operators: each group's points go to the nearest of a
bounded number of pivots, and what one pivot attracts is split into shards of
about ``size`` points, so a group that holds a third of all points becomes
many cells of even size.  Pivots are fitted on a bounded sample (at most
``PIVOTS`` points of each of the ``GROUPS`` largest groups, by hash of the row
number); every point is assigned.  Smaller groups are one pivot each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.common import Scratch

PIVOTS = 64
GROUPS = 256


def usable(vec: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


def matrix(values) -> np.ndarray:
    """Rows of equal length from packed doubles."""
    parts = [bytes(v) for v in values]
    return np.frombuffer(b"".join(parts)).reshape(len(parts), -1) if parts else np.empty((0, 0))


def deal(points: DataFrame, scratch: Scratch, size: int) -> DataFrame:
    """``points(row LONG, grp STRING, p BINARY, ...)`` plus ``cell STRING``."""
    per = scratch.keep(points.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    large = per.where(F.col("n") > size).orderBy(F.desc("n"), "grp").limit(GROUPS)
    share = {r.grp: min(PIVOTS, -(-r.n // size)) for r in large.collect()}        # GROUPS rows at most
    sample: dict[str, np.ndarray] = {}
    if share:
        wanted = points.sparkSession.createDataFrame(list(share.items()), "grp string, k long")
        drawn = _first(points.select("row", "grp", "p").join(F.broadcast(wanted), "grp"))
        found: dict[str, list] = {}
        for r in drawn.collect():                                               # GROUPS * PIVOTS rows at most
            found.setdefault(r.grp, []).append((r.pos, bytes(r.p)))
        sample = {g: matrix([p for _, p in sorted(v)[:share[g]]]) for g, v in found.items()}
    shared = points.sparkSession.sparkContext.broadcast(sample)
    names = points.columns

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            groups = np.array(batch.column("grp").to_pylist(), object)
            out = np.zeros(len(groups), np.int32)
            values = batch.column("p")
            for g in set(groups.tolist()) & set(pivots):
                at = np.flatnonzero(groups == g)
                x, c = matrix([values[int(i)].as_py() for i in at]), pivots[g]
                out[at] = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*names, "pivot"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    near = scratch.keep(points.mapInArrow(nearest, f"{fields}, pivot int"), "near")
    load = scratch.keep(near.groupBy("grp", "pivot").agg(F.ceil(F.count("*") / size).cast("long").alias("shards")), "load")
    shard = F.pmod(F.xxhash64("row"), F.col("shards"))
    return scratch.keep(near.join(load, ["grp", "pivot"])
                        .select(*names, F.concat_ws("|", "grp", "pivot", shard).alias("cell")), "cells")


def _first(points: DataFrame) -> DataFrame:
    """The first PIVOTS points of each group by hash of the row number; the
    limit is applied before the shuffle."""
    order = Window.partitionBy("grp").orderBy(F.xxhash64("row"), "row")
    return points.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= PIVOTS)
