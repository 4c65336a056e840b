"""Exact top-k inner-product search by best-first search in an M-tree.

Vectors are taken as integers ``floor(scale * x)``.  Inner product is made a
distance by one more coordinate: with ``m`` the largest squared length,
``x' = (x, sqrt(m - |x|^2))`` and ``q' = (q, 0)`` give
``|q' - x'|^2 = |q|^2 + m - 2 q.x``, so the nearest points have the highest
scores.

The tree has three levels.  Pivots are the root's entries (at most
``cells.PIVOTS`` of each of ``cells.GROUPS`` vector lengths, with covering
radii: a broadcast of bounded size); pages hold about ``PAGE`` points of one
pivot; nodes of about ``NODE`` points have a centre, a covering radius, the
distance to the page's centre and the members' distances to their own.  A
query first searches the page it lies in, which gives a score its ``k``-th
best must reach; then it goes to every pivot whose ball can hold such a score
and there, in blocks of queries, walks the nodes of each page from the
nearest on.  Stored parent distances rule out nodes and members by the
triangle inequality before any distance is computed; scores are exact
integers.  Every task gives at most ``k`` rows a query and the last step
keeps the ``k`` best.

Vectors whose squared length as integers reaches 2^62 would spoil the lifted
coordinate of all others and their scores may not fit 64 bits.  They stay out
of the tree: pairs with one of them are scored in blocks of queries and chunks
of candidates, by extended floats with an error bound first and by unbounded
integers where that leaves a doubt.  Scores beyond 64 bits rank by their exact
value and are returned as the nearest 64-bit number.

Defined cases: vectors that are null, empty or hold null or non-finite
components take no part;
vectors of another length than the query's are no candidates of it; a null
id is no query and comes last among ties; rows are told apart by position,
so repeated rows are candidates of each other; fewer than ``k`` candidates
are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qforge.llm.cells import deal, matrix, usable
from qforge.llm.common import Scratch

PAGE = 1024
NODE = 64
BLOCK = 2048               # queries that search a page together
LIMIT = 2.0 ** 62 * (1 - 1e-9)   # squared length below which all scores fit 64 bits
SLACK = 1e-6               # for rounding in distances, which only ever prune
LAST = np.iinfo(np.int64).max


class Page:
    """Points of one page under nodes with centres, radii and stored distances."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.centre = p.mean(0)
        to_centre = np.sqrt(((p - self.centre) ** 2).sum(1))
        self.radius = float(to_centre.max())
        count = -(-len(p) // NODE)
        # node centres: points far from those chosen before
        chosen, far = [int(to_centre.argmax())], None
        while len(chosen) < count:
            d = ((p - p[chosen[-1]]) ** 2).sum(1)
            far = d if far is None else np.minimum(far, d)
            if far.max() == 0:
                break
            chosen.append(int(far.argmax()))
        c = p[chosen]
        near = np.argmin((c * c).sum(1) - 2 * (p @ c.T), axis=1)
        self.members = [np.flatnonzero(near == k) for k in range(len(chosen))]
        self.centres = c
        self.parent = to_centre[chosen]                                          # node to page
        self.own = [np.sqrt(((p[m] - c[k]) ** 2).sum(1)) for k, m in enumerate(self.members)]   # member to node
        self.radii = np.array([float(d.max()) if len(d) else 0.0 for d in self.own])

    def search(self, q: np.ndarray, scores, k: int, m: float, floor: np.ndarray, none):
        """Best-first search of a block of queries, the rows of ``q``.

        ``scores(members, queries)`` gives exact scores, ``none`` where a pair
        is no candidate; ``floor`` is a score each query's results must reach.
        Returns (query, member, score) of all pairs that can be among the best
        k, and each query's k best scores found."""
        n = len(q)
        qq, every = (q * q).sum(1), np.arange(n)
        best = np.full((n, k), none)
        least = floor.copy()
        out = []

        def reach(which):
            low = least[which].astype(float)
            far = np.sqrt(np.maximum(qq[which] + m - 2 * low, 0)) * (1 + SLACK) + SLACK * (1 + m ** 0.5)
            return np.where(least[which] <= none, np.inf, far)
        limit = reach(every)
        to_page = np.sqrt(((q - self.centre) ** 2).sum(1))
        # by stored distances: |d(q, page) - d(node, page)| - radius is a lower bound
        open_ = (np.abs(to_page[:, None] - self.parent) - self.radii <= limit[:, None]) & (to_page - self.radius <= limit)[:, None]
        to_node = np.full(open_.shape, np.inf)
        for node in np.flatnonzero(open_.any(0)):
            to_node[open_[:, node], node] = np.sqrt(((q[open_[:, node]] - self.centres[node]) ** 2).sum(1))
        bound = to_node - self.radii
        order = np.argsort(bound, axis=1, kind="stable")
        for step in range(bound.shape[1]):
            node_of = order[:, step]
            going = np.flatnonzero(bound[every, node_of] <= limit)
            if not len(going):
                break
            for node in np.unique(node_of[going]):
                who = going[node_of[going] == node]
                near = np.abs(to_node[who, node][:, None] - self.own[node]) <= limit[who][:, None]
                some = near.any(0)
                if not some.any():
                    continue
                rows = self.members[node][some]
                s = scores(rows, who)
                s[~near[:, some]] = none
                good = (s > none) & (s >= least[who][:, None])
                x, y = np.nonzero(good)
                out.append((who[x], rows[y], s[x, y]))
                both = np.concatenate([best[who], s], axis=1)
                best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k:]
                least[who] = np.maximum(least[who], best[who].min(1))
                limit[who] = reach(who)
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, best.dtype), best
        a, b, s = (np.concatenate(c) for c in zip(*out))
        stay = s >= least[a]
        return a[stay], b[stay], s[stay], best


def exact(x: np.ndarray, q: np.ndarray, x_rows: np.ndarray, q_rows: np.ndarray):
    """Exact scores between rows of x and of q (integers held as doubles), and
    the value for a row with itself."""
    top = max(np.abs(x).max(), 1.0) * max(np.abs(q).max(), 1.0) if len(q) else 0.0
    kind = np.float64 if top * x.shape[1] < 2.0 ** 52 else np.int64
    none = kind(-2 ** 62)
    xs, qs = x.astype(kind), q.astype(kind)

    def scores(members: np.ndarray, queries: np.ndarray) -> np.ndarray:
        s = qs[queries] @ xs[members].T
        s[q_rows[queries][:, None] == x_rows[members][None, :]] = none
        return s
    return scores, none


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose id ``every`` divides."""
    spark = df.sparkSession
    scratch = Scratch(spark, "top_k")
    vec = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    every_row = (df.where(usable(F.col(f"`{vec_col}`").cast("array<double>")))
                 .select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("v"),
                         F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
                 .withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).withColumn("far", F.col("sq") >= LIMIT)
                 .withColumn("x", F.when(F.col("far"), F.col("x"))))
    every_row = scratch.keep(every_row, "rows")
    rows = every_row.where(~F.col("far"))
    most = float(rows.agg(F.max("sq")).first()[0] or 0.0)

    @F.pandas_udf("binary")
    def lifted(vs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for v, sq in vs:
            yield pd.Series([np.append(np.asarray(a, np.float64), np.sqrt(max(most - b, 0.0))).tobytes() for a, b in zip(v, sq)], dtype=object)

    asks = F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0)
    points = rows.select("row", "vec_id", F.size("v").cast("string").alias("grp"), asks.alias("asks"), lifted("v", "sq").alias("p"))
    pages = deal(points, scratch, PAGE)

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of the page's own queries: the k-th best score in the page; and the page's outline."""
        x = matrix(pdf.p)
        page, rows = Page(x), pdf.row.to_numpy(np.int64)
        out = [(None, pdf.cell.iloc[0], None, page.centre.tobytes(), page.radius)]
        asking = np.flatnonzero(pdf.asks.to_numpy())
        if len(asking):
            q = x[asking].copy()
            q[:, -1] = 0
            scores, none = exact(x[:, :-1], q[:, :-1], rows, rows[asking])
            best = page.search(q, scores, k, most, np.full(len(q), none), none)[3].min(1)
            out += [(int(rows[t]), pdf.cell.iloc[0], None if b <= none else float(b), None, None) for t, b in zip(asking, best)]
        return pd.DataFrame(out, columns=["row", "cell", "floor", "centre", "radius"]).astype({"row": "Int64", "floor": "Float64", "radius": "Float64"})

    home = scratch.keep(pages.groupBy("cell").applyInPandas(at_home, "row long, cell string, floor double, centre binary, radius double"), "home")
    # the root's entries: per pivot a ball around the pages' centres
    pivot = F.substring_index("cell", "|", 2)
    balls = home.where("row is null").select(pivot.alias("pivot"), "cell", "centre", "radius")

    def ball(pdf: pd.DataFrame) -> pd.DataFrame:
        c = matrix(pdf.centre)
        middle = c.mean(0)
        return pd.DataFrame({"pivot": [pdf["pivot"].iloc[0]], "centre": [middle.tobytes()],
                             "radius": [float((np.sqrt(((c - middle) ** 2).sum(1)) + pdf.radius.to_numpy(float)).max())], "pages": [len(pdf)]})

    entries = scratch.keep(balls.groupBy("pivot").applyInPandas(ball, "pivot string, centre binary, radius double, pages long"), "entries")
    entries = entries.withColumn("grp", F.substring_index("pivot", "|", 1))
    queries = (pages.where("asks").select("row", "vec_id", "grp", "p")
               .join(home.where("row is not null").select("row", "floor"), "row"))

    @F.pandas_udf("boolean")
    def can_reach(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for p, floor, centre, radius in parts:
            if not len(p):
                yield pd.Series([], dtype=bool)
                continue
            x, c = _stack(p), _stack(centre)
            x[:, -1] = 0
            gap = np.sqrt(((x - c) ** 2).sum(1)) - radius.to_numpy(float)
            least = floor.to_numpy(float, na_value=-np.inf)
            limit = np.sqrt(np.maximum((x * x).sum(1) + most - 2 * least, 0)) * (1 + SLACK) + SLACK * (1 + most ** 0.5)
            yield pd.Series(np.isnan(least) | (gap <= limit))

    # vector lengths with one pivot each are joined like the others: at most PIVOTS entries a length
    sent = queries.join(entries, "grp").where(can_reach("p", "floor", "centre", "radius")) \
        .select("row", "vec_id", "p", "floor", "pivot")
    sent = scratch.keep(sent, "sent")
    load = scratch.keep(sent.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), "load")
    members = pages.select("row", "vec_id", "p", "cell", pivot.alias("pivot"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    members = members.join(load, "pivot").select("cell", part, "row", "vec_id", "p", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("q"))
    seekers = (sent.join(load, "pivot").join(balls.select("pivot", "cell"), "pivot")
               .select("cell", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"), "row", "vec_id", "p", "floor", F.lit(True).alias("q")))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf[pdf.q]
        own = pdf[~pdf.q]
        if not len(q) or not len(own):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query", "query_id", "row", "vec_id", "score")})
        x, rows, asking = matrix(own.p), own.row.to_numpy(np.int64), matrix(q.p).copy()
        asking[:, -1] = 0
        ids = np.array([LAST if pd.isna(v) else int(v) for v in own.vec_id], np.int64)
        query, query_id = q.row.to_numpy(np.int64), q.vec_id.to_numpy(np.int64)
        scores, none = exact(x[:, :-1], asking[:, :-1], rows, query)
        # a home score above 2^52 may have been rounded up
        floor = np.array([none if pd.isna(f) else f - abs(f) * 2.0 ** -50 for f in q["floor"]]).astype(none.dtype)
        a, b, s, _ = Page(x).search(asking, scores, k, most, floor, none)
        order = np.lexsort((rows[b], ids[b], -s, a))
        a, b, s = a[order], b[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, s = a[place < k], b[place < k], s[place < k]
        return pd.DataFrame({"query": query[a], "query_id": query_id[a], "row": rows[b], "vec_id": ids[b], "score": s.astype(np.int64)})

    hits = members.unionByName(seekers).groupBy("cell", "block") \
        .applyInPandas(search, "query long, query_id long, row long, vec_id long, score long").withColumn("beyond", F.lit(None).cast("binary"))
    far = _far_pairs(every_row, k, every, scale)
    hits = hits if far is None else hits.unionByName(far)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id", "row")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != int(LAST), F.col("vec_id")).alias("vec_id"), "score"))


FAR = np.longdouble


def _sortable(value: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (abs(value).bit_length() + 7) // 8
    if value >= 0:
        return b"\x01" + size.to_bytes(2) + value.to_bytes(size)
    return b"\x00" + (65535 - size).to_bytes(2) + ((1 << 8 * size) - 1 + value).to_bytes(size)


def _far_pairs(every_row: DataFrame, k: int, every: int, scale: int) -> DataFrame | None:
    """The best ``k`` of each query in each chunk, over all pairs in which the
    query or the candidate is far out; None where no row is."""
    asks = F.col("vec_id").isNotNull() & (F.col("vec_id") % every == 0)
    n_far, n_rows, n_asks, n_far_asks = every_row.agg(F.count_if("far"), F.count("*"), F.count_if(asks), F.count_if(asks & F.col("far"))).first()
    if not n_far:
        return None
    near = ~F.col("far")
    parts = []
    for name, candidates, count, queries, asked in (("all", F.col("far"), n_far, asks, n_asks), ("far", near, n_rows - n_far, asks & F.col("far"), n_far_asks)):
        chunks, blocks = max(1, -(-count // PAGE)), max(1, -(-asked // BLOCK))
        deal_, spread = (lambda n: F.pmod(F.xxhash64("row"), F.lit(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        own = ["row", "vec_id", F.size("v").alias("n"), "v", "x", F.lit(name).alias("kind")]
        parts.append(every_row.where(candidates).select(*own, deal_(chunks).alias("chunk"), spread(blocks).alias("block"), F.lit(False).alias("q")))
        parts.append(every_row.where(queries).select(*own, deal_(blocks).alias("block"), spread(chunks).alias("chunk"), F.lit(True).alias("q")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)

    def whole(v, x) -> list[int]:
        if x is None:
            return [int(c) for c in v]
        return [int(c) * scale if abs(c) >= 2.0 ** 53 else int(np.floor(c * scale)) for c in x]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, own = pdf[pdf.q], pdf[~pdf.q]
        out = []
        if len(q) and len(own):
            asked, held = ([whole(v, x) for v, x in zip(part.v, part.x)] for part in (q, own))
            a, b = (np.array([[FAR(c) for c in v] for v in part], FAR) for part in (asked, held))
            rough, doubt = a @ b.T, (np.abs(a) @ np.abs(b).T) * FAR(2.0 ** -61 * (a.shape[1] + 2))
            rows, ids = own.row.to_numpy(np.int64), [None if pd.isna(v) else int(v) for v in own.vec_id]
            for t, (row, query_id) in enumerate(zip(q.row.tolist(), q.vec_id.tolist())):
                others = np.flatnonzero(rows != row)
                if len(others) > k:
                    low = np.sort(rough[t, others] - doubt[t, others])[-k]
                    others = others[rough[t, others] + doubt[t, others] >= low]
                scored = [(-sum(x * y for x, y in zip(asked[t], held[o])), ids[o] is None, ids[o] or 0, int(rows[o])) for o in others]
                for score, empty, vec_id, found in sorted(scored)[:k]:
                    fits = max(-1 << 63, min((1 << 63) - 1, -score))
                    out.append((row, int(query_id), found, LAST if empty else vec_id, fits, None if fits == -score else _sortable(-score)))
        return pd.DataFrame(out, columns=["query", "query_id", "row", "vec_id", "score", "beyond"])
    return both.groupBy("kind", "n", "chunk", "block").applyInPandas(
        search, "query long, query_id long, row long, vec_id long, score long, beyond binary")


def _stack(values) -> np.ndarray:
    """Rows of one length or, padded with zeros, of several."""
    parts = [np.frombuffer(bytes(v)) for v in values]
    width = max(map(len, parts))
    if all(len(p) == width for p in parts):
        return np.stack(parts)
    return np.stack([np.append(np.append(p[:-1], np.zeros(width - len(p))), p[-1]) for p in parts])
