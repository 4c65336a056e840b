"""Embedding near-duplicates by dual traversal of cover trees.

Vectors link when their labels are equal and their cosine is at least
``threshold``; on normalised vectors that is a distance of at most
``sqrt(2 - 2 threshold)``.  Equal vectors of a label are one class with a
weight.  Classes are dealt into cells (``cells.deal``); two cells of a label
are compared unless their centres are further apart than their covering
radii and the distance allow; inside, a cover tree is built per cell (nested
levels, radii halved from level to level) and both trees are walked together,
dropping pairs of nodes by the same bound.  What is left is checked by the
cosine in double precision, so the pairs are exact.

A pair of cells gives link counts per class and the edges of its components
towards their least member, never all pairs; counts are summed and the edges
joined to components by Spark.

Defined cases: null labels, null, empty or zero vectors and vectors holding
null or non-finite components link with nothing; vectors of different length
do not link; vectors of any finite size, the least and the largest doubles
too, link by their direction; repeated rows are rows of their own and link with each other;
a null id never is a component's id unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge.llm.cells import deal, matrix, usable
from qforge.llm.common import Scratch, components

CELL = 1024
LEAF = 16


class Node:
    __slots__ = ("centre", "radius", "children", "members")

    def __init__(self, centre: int, radius: float, children: list, members: np.ndarray):
        self.centre, self.radius, self.children, self.members = centre, radius, children, members


class CoverTree:
    """Cover tree over unit vectors; a node's first child has its centre."""

    def __init__(self, x: np.ndarray, own: np.ndarray):
        self.x, self.own = x, own
        first = int(own[0])
        self.root = self._build(first, own, self._far(own, first))

    def _far(self, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (self.x[rows] @ self.x[centre]), 0))

    def _build(self, centre: int, rows: np.ndarray, far: np.ndarray) -> Node:
        radius = float(far.max())
        if len(rows) <= LEAF or radius < 1e-6:
            return Node(centre, radius, [], rows)
        children, cover = [], radius / 2
        while len(rows):
            near = far <= cover
            near |= rows == centre
            children.append(self._build(centre, rows[near], far[near]) if near.sum() > 1 else
                            Node(centre, 0.0, [], rows[near]))
            rows = rows[~near]
            if len(rows):
                centre = int(rows[0])
                far = self._far(rows, centre)
        if len(children) == 1:
            return children[0]
        return Node(children[0].centre, radius, children, rows)


def linked(x: np.ndarray, raw: np.ndarray, norm: np.ndarray, a: CoverTree, b: CoverTree, threshold: float):
    """Index pairs (i, j) with cosine >= threshold, i from a and j from b; each
    pair once, without i = j, when a is b."""
    reach = (2 - 2 * threshold) ** 0.5 + 1e-6
    left, right = [], []
    todo = [(a.root, b.root)]
    while todo:
        u, v = todo.pop()
        if not u.children and not v.children:
            cosine = (raw[u.members] @ raw[v.members].T) / np.outer(norm[u.members], norm[v.members])
            hit = cosine >= threshold
            if u is v:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            left.append(u.members[i])
            right.append(v.members[j])
            continue
        us, vs = u.children or [u], v.children or [v]
        ru, rv = np.array([n.radius for n in us]), np.array([n.radius for n in vs])
        far = np.sqrt(np.maximum(2 - 2 * (x[[n.centre for n in us]] @ x[[n.centre for n in vs]].T), 0))
        keep = far <= reach + ru[:, None] + rv[None, :]
        if u is v:
            keep = np.triu(keep)
        todo += [(us[i], vs[j]) for i, j in zip(*np.nonzero(keep))]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def least_member(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each index's component under the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``df``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "near_vectors")
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    rows = scratch.keep(df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                  F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("vec")), "rows")
    part = usable(F.col("vec")) & F.col("label").isNotNull() & F.exists("vec", lambda x: x != 0)
    classes = scratch.keep(rows.where(part).groupBy("label", "vec")
                           .agg(F.min("row").alias("row"), F.count("*").alias("copies")), "classes")

    @F.pandas_udf("binary")
    def unit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda v: _unit(np.asarray(v, np.float64)).tobytes())

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield p.map(lambda v: _scaled(np.asarray(v, np.float64)).tobytes())

    points = classes.select("row", F.concat_ws(":", F.size("vec").cast("string"), "label").alias("grp"), "copies",
                            unit("vec").alias("p"), packed("vec").alias("raw"))
    cells = deal(points, scratch, CELL)

    def outline(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pdf.p)
        centre = _unit(x.mean(0)) if np.abs(x.mean(0)).max() > 1e-12 else x[0]
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        return pd.DataFrame({"cell": [pdf.cell.iloc[0]], "grp": [pdf.grp.iloc[0]], "centre": [centre.tolist()], "radius": [radius]})

    outlines = scratch.keep(cells.select("cell", "grp", "p").groupBy("cell")
                            .applyInPandas(outline, "cell string, grp string, centre array<double>, radius double"), "outlines")
    far = F.sqrt(F.aggregate(F.zip_with("x.centre", "y.centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    reach = (2 - 2 * threshold) ** 0.5 + 1e-6
    pairs = outlines.alias("x").join(outlines.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.cell") <= F.col("y.cell"))) \
        .where(far <= F.lit(reach) + F.col("x.radius") + F.col("y.radius")) \
        .select(F.col("x.cell").alias("a"), F.col("y.cell").alias("b"))
    pairs = scratch.keep(pairs, "pairs")
    ends = pairs.select("a", "b", F.col("a").alias("cell")).unionByName(pairs.where("a != b").select("a", "b", F.col("b").alias("cell")))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, raw = matrix(pdf.p), matrix(pdf.raw)
        norm = np.sqrt((raw * raw).sum(1))
        copies, ids = pdf.copies.to_numpy(np.int64), pdf.row.to_numpy(np.int64)
        in_a = (pdf.cell == pdf.a).to_numpy()
        one = CoverTree(x, np.flatnonzero(in_a))
        other = one if in_a.all() else CoverTree(x, np.flatnonzero(~in_a))
        i, j = linked(x, raw, norm, one, other, threshold)
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = least_member(len(ids), i, j)
        some = np.flatnonzero(links > 0)
        return pd.DataFrame({"row": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})

    found = ends.join(cells.select("cell", "row", "copies", "p", "raw"), "cell") \
        .groupBy("a", "b").applyInPandas(compare, "row long, links long, root long")
    found = scratch.keep(found, "found")
    links = scratch.keep(found.groupBy("row").agg(F.sum("links").alias("links")), "links")
    root = scratch.keep(components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), scratch), "roots")
    facts = classes.select("label", "vec", "row", "copies").join(links, "row", "left") \
        .join(root.withColumnRenamed("node", "row"), "row", "left") \
        .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "row").alias("root"))
    facts = scratch.keep(facts, "facts")
    placed = scratch.keep(rows.join(facts, ["label", "vec"], "left").select("row", "vec_id", "n_links", "root"), "placed")
    names = scratch.keep(placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "names")
    return placed.join(names, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _scaled(v: np.ndarray) -> np.ndarray:
    """``v`` times the power of two that brings its largest component to [0.5, 1):
    cosines keep every bit, and products neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum())
