"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word shingles; two link when ``den * |A & B| >= num * |A | B|``.
Texts with equal sets are one class.

Order and prefixes: a histogram of all shingles over ``2^BUCKETS`` hash buckets
(a broadcast of fixed size) gives every shingle an estimated frequency;
shingles are ordered by it, rare ones first.  A class of ``n`` shingles has as
its prefix of level ``l`` its first ``n - ceil(num n / den) + l`` shingles, and two
linked classes share at least ``l`` shingles of both prefixes.  Each class
picks the level of least cost, where the cost counts the postings of its
prefix (what the histogram shows above its noise, and a constant share for
chance) and one verification per ``l`` of them, dearer for longer texts: long
texts and texts made of frequent passages get longer prefixes and need more
common shingles.  A pair is
verified when it shares, up to the lesser level ``l`` of the two, at least
``l`` of them.

Candidates without emitting pairs: shingles that are in the prefixes of two
classes or more elect their least class as hub; the classes that share a hub
form a cluster.  A cluster is cut into blocks of about ``4 sqrt(m)`` members and
pairs of blocks are tasks, so a hot passage is spread and a task is small.
Inside, matches are counted by array products.  Only
classes with a candidate go on; their whole sets are fetched and the exact
overlap of each candidate pair is counted in the same way.  A pair that
meets in several clusters counts in that of the least hub of the common
shingles that its level allows, and nowhere else.
Tasks give link counts per class and edges to the least member of each
component, never all pairs.

Defined cases: a null or empty text, or one without words, has no shingles and
links with nothing; fewer words than ``width`` are one shingle; rows are told
apart by position, so repeated rows are kept and linked; a null id never
names a component unless all its ids are null; no rows give no rows.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import Scratch, components
from qforge.llm.cover_tree import least_member
from qforge.llm.shingles import class_id, shingle_set, texts_of

BUCKETS = 20                # log2 of the histogram's buckets: 4 MB as a broadcast
CHUNK = 4096                # buckets per row of the histogram's table
LEVELS = 8
COLLISIONS = 0.2            # postings that any shingle is expected to share by chance
VERIFY = 1 / 8              # cost of verifying a class per shingle, in postings
BLOOM = 27                  # log2 of the bits that mark the classes to fetch
FLUSH = 300_000             # shingles of whole groups that a task holds at a time


def prefix_order(s: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Indices of the set in the global order: by estimated frequency, then hash."""
    return np.lexsort((s, rate[(s >> np.uint64(64 - BUCKETS)).astype(np.int64)]))


def choose_level(n: int, cost: np.ndarray, first: int) -> int:
    """The level of least cost; ``cost`` are the postings of the ordered shingles."""
    most = min(LEVELS, n - first + 1)
    if most <= 1:
        return 1
    run = np.cumsum(cost[:first + most - 1])[first - 1:]
    level = np.arange(1, most + 1)
    return int(np.argmin(run + VERIFY * n * run / level)) + 1


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], weight) -> Iterator[pa.Table]:
    """Tables of whole groups of rows sorted by ``keys``, cut when they weigh FLUSH."""
    held: list[pa.RecordBatch] = []
    load = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        cost = weight(batch)
        begin = 0
        for at in np.flatnonzero(new):
            if load + cost[begin:at].sum() >= FLUSH and (held or at > begin):
                if at > begin:
                    held.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(held)
                held, load, begin = [], 0, int(at)
        held.append(batch.slice(begin))
        load += int(cost[begin:].sum())
    if held:
        yield pa.Table.from_batches(held)


def spans(table: pa.Table, keys: tuple[str, ...]) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return list(zip(start.tolist(), [*start[1:].tolist(), table.num_rows]))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, by products over
    the elements that at least two of them hold, a slice at a time."""
    n = len(sets)
    out = np.zeros((n, n), np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    if n == 2:
        out[0, 1] = out[1, 0] = len(flat) - len(np.unique(flat))
        return out
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    if not len(column):
        return out
    column = np.unique(column, return_inverse=True)[1]
    width = max(256, (1 << 22) // n)
    for low in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [low, low + width])
        x = np.zeros((n, min(width, int(column[-1]) + 1 - low)), np.float32)
        x[owner[a:b], column[a:b] - low] = 1
        out += np.rint(x @ x.T).astype(np.int64)
    return out


def eligible(sizes: np.ndarray, block: np.ndarray, cross: bool, num: int, den: int) -> np.ndarray:
    """Pairs (upper triangle) of fitting sizes, of two blocks if ``cross``."""
    ok = np.triu(den * np.minimum.outer(sizes, sizes) >= num * np.maximum.outer(sizes, sizes), 1)
    return ok & (block[:, None] != block[None, :]) if cross else ok


def meet_here(ok: np.ndarray, top: np.ndarray, token: list[np.ndarray], level: list[np.ndarray], side: list[np.ndarray], enough: bool) -> np.ndarray:
    """Pairs of ``ok`` whose least hub is this one: of the shingles with levels
    up to the pair's, they share one of this hub (side 0) and none of a lesser
    hub (side -1); with ``enough``, as many as the pair's level in all."""
    out = np.zeros_like(ok)
    need = np.minimum.outer(top, top)
    for m in np.unique(need[ok]):
        those = ok & (need == m)

        def shared(which) -> np.ndarray:
            sets = [t[(v <= m) & which(d)] for t, v, d in zip(token, level, side)]
            return common(sets) if any(map(len, sets)) else np.zeros(ok.shape, np.int64)
        if enough and m > 1:
            those &= shared(lambda d: d == d) >= m
        if those.any():
            those &= shared(lambda d: d == 0) > 0
        if those.any():
            those &= shared(lambda d: d < 0) == 0
        out |= those
    return out


def place(df: DataFrame) -> tuple[Column, Column]:
    """``file`` (a hash of its path) and ``row`` (the position in it) of the rows
    of a written table, the same however its files are split."""
    meta = df.metadataColumn("_metadata")
    return F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")


def similar_texts(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``file, row, doc_id, n_shingles, n_links, component_id, component`` per row
    of ``df``, a written table.  ``file, row`` name the row as ``place()`` does;
    ``component`` is a key of the component, null without shingles."""
    spark = df.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "jaccard")
    docs = df.select(*place(df), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").alias("text"))

    # ---- one pass: classes, and the histogram of shingles
    first_schema = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()),
                              ("chunk", pa.int32()), ("counts", pa.binary())])

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros(1 << BUCKETS, np.int32)
        for batch in batches:
            cid, n, waiting, load = [], [], [], 0
            for text in texts_of(batch.column("text")):
                s = shingle_set(text, width)
                cid.append(class_id(s))
                n.append(len(s))
                waiting.append((s >> np.uint64(64 - BUCKETS)).astype(np.int32))
                load += len(s)
                if load >= 1 << 20:
                    hist += np.bincount(np.concatenate(waiting), minlength=1 << BUCKETS).astype(np.int32)
                    waiting, load = [], 0
            if load:
                hist += np.bincount(np.concatenate(waiting), minlength=1 << BUCKETS).astype(np.int32)
            k = len(cid)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "row", "doc_id")), pa.array(cid, pa.int64()), pa.array(n, pa.int64()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=first_schema)
        chunks = [(c, part.tobytes()) for c, part in enumerate(hist.reshape(-1, CHUNK)) if part.any()]
        k = len(chunks)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(k, pa.int64())] * 5, pa.array([c for c, _ in chunks], pa.int32()),
                                          pa.array([b for _, b in chunks], pa.binary())], schema=first_schema)

    survey_rows = scratch.keep(docs.mapInArrow(survey, "file long, row long, doc_id long, cid long, n long, chunk int, counts binary"), "survey")
    texts = survey_rows.where("chunk is null").select("file", "row", "doc_id", "cid", "n")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for b in pdf.counts:
            total += np.frombuffer(bytes(b), np.int32)
        return pd.DataFrame({"chunk": [pdf.chunk.iloc[0]], "total": [total.tobytes()]})

    rate = np.zeros(1 << BUCKETS, np.float32)
    sums = survey_rows.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInPandas(add, "chunk int, total binary")
    for r in sums.toLocalIterator():                    # 2^BUCKETS numbers, whatever the input
        rate[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.total), np.int64)
    mean = float(rate.mean())
    shared_rate = sc.broadcast(rate)
    noise = mean + 3 * mean ** 0.5

    # ---- second pass: prefix postings
    post_schema = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("top", pa.int8()), ("level", pa.int8())])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = shared_rate.value
        for batch in batches:
            seen: set[int] = set()
            token, info = [], []
            for text in texts_of(batch.column("text")):
                s = shingle_set(text, width)
                n = len(s)
                cid = class_id(s)
                if not n or cid in seen:
                    continue
                seen.add(cid)
                first = n - -(-num * n // den) + 1
                order = prefix_order(s, freq)[:first + LEVELS - 1]
                cost = COLLISIONS + np.maximum(freq[(s[order] >> np.uint64(64 - BUCKETS)).astype(np.int64)] - noise, 0)
                top = choose_level(n, cost, first)
                token.append(s[order[:first + top - 1]])
                info.append((cid, n, top, first))
            if not token:
                continue
            size = [len(t) for t in token]
            level = np.concatenate([np.concatenate([np.ones(first, np.int8), np.arange(2, top + 1, dtype=np.int8)]) for _, _, top, first in info])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(token).view(np.int64)), pa.array(np.repeat([i[0] for i in info], size), pa.int64()),
                pa.array(np.repeat([i[1] for i in info], size), pa.int32()), pa.array(np.repeat([i[2] for i in info], size), pa.int8()),
                pa.array(level)], schema=post_schema)

    post = scratch.keep(docs.select("text").mapInArrow(postings, "token long, cid long, n int, top byte, level byte"), "postings")
    hubs = scratch.keep(post.groupBy("token").agg(F.min("cid").alias("hub"), F.max("cid").alias("hi"))
                        .where("hub != hi").select("token", "hub"), "hubs")
    mine = post.join(hubs.hint("merge"), "token").groupBy("cid", "n", "top") \
        .agg(F.array_sort(F.collect_set(F.struct("token", "level", "hub"))).alias("t")) \
        .select("cid", "n", "top", "t", F.array_distinct(F.transform("t", lambda x: x["hub"])).alias("hubs"))
    mine = scratch.keep(mine, "mine")

    def side_of(x):
        return F.when(x["hub"] < F.col("hub"), -1).when(x["hub"] == F.col("hub"), 0).otherwise(1).cast("byte")

    # at level 1 one common shingle is enough, so only those of the hub go to its cluster
    members = mine.select("cid", "n", "top", "t", F.explode("hubs").alias("hub")) \
        .withColumn("t", F.when(F.col("top") > 1, F.col("t")).otherwise(F.filter("t", lambda x: x["hub"] == F.col("hub")))) \
        .select("cid", "n", "top", F.col("t.token").alias("tokens"), F.col("t.level").alias("levels"),
                F.transform("t", side_of).alias("sides"), "hub")
    members = scratch.keep(members, "members")
    scratch.drop("postings")
    load = members.groupBy("hub").agg(F.count("*").alias("m")).where("m > 64")
    load = scratch.keep(load.select("hub", F.ceil(F.sqrt("m") / 4).cast("int").alias("blocks")), "load")
    placed = members.join(load, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "n", "top", "tokens", "levels", "sides")
    keys = ("hub", "i", "j")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weight(batch):
            return np.diff(batch.column("tokens").offsets.to_numpy())
        for table in grouped(batches, keys, weight):
            table = table.combine_chunks()
            hub, i, j, block, n, top = (table.column(c).to_numpy() for c in ("hub", "i", "j", "block", "n", "top"))
            token, level, side = (_lists(table.column(c)) for c in ("tokens", "levels", "sides"))
            keep = np.zeros(table.num_rows, bool)
            for a, b in spans(table, keys):
                if b - a < 2:
                    continue
                at = slice(a, b)
                ok = eligible(n[at].astype(np.int64), block[at], i[a] != j[a], num, den)
                if not ok.any():
                    continue
                ok = meet_here(ok, top[at], token[at], level[at], side[at], True)
                keep[at] |= ok.any(0) | ok.any(1)
            yield from table.filter(pa.array(keep)).select(["hub", "i", "j", "block", "cid", "n"]).to_batches()

    wanted = placed.repartition(*keys).sortWithinPartitions(*keys) \
        .mapInArrow(candidates, "hub long, i int, j int, block int, cid long, n int")
    wanted = scratch.keep(wanted, "wanted")
    scratch.drop("members")

    # ---- third pass: the whole sets of classes that have a candidate
    marked = sc.broadcast(_bitmap(wanted.select("cid").distinct()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marked.value
        for batch in batches:
            found: dict[int, list] = {}
            for text in texts_of(batch.column("text")):
                s = shingle_set(text, width)
                cid = class_id(s)
                if cid in found:
                    found[cid][1] += 1
                elif bits[(cid & ((1 << BLOOM) - 1)) >> 3] >> (cid & 7) & 1:
                    found[cid] = [s.tobytes(), 1]
            yield pa.RecordBatch.from_pydict({"cid": list(found), "s": [v[0] for v in found.values()], "copies": [v[1] for v in found.values()]},
                                             pa.schema([("cid", pa.int64()), ("s", pa.binary()), ("copies", pa.int64())]))

    sets = docs.select("text").mapInArrow(fetch, "cid long, s binary, copies long").groupBy("cid") \
        .agg(F.first("s").alias("s"), F.sum("copies").alias("copies"))
    whole = wanted.join(sets.hint("merge"), "cid").join(mine.select("cid", "top", "t").hint("merge"), "cid") \
        .withColumn("t", F.filter("t", lambda x: x["hub"] <= F.col("hub"))) \
        .select(*keys, "block", "cid", "n", "top", F.col("t.token").alias("tokens"), F.col("t.level").alias("levels"),
                F.transform("t", side_of).alias("sides"), "s", "copies").repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weight(batch):
            return batch.column("n").to_numpy()
        for table in grouped(batches, keys, weight):
            table = table.combine_chunks()
            i, j, block, cid, n, top, copies = (table.column(c).to_numpy() for c in ("i", "j", "block", "cid", "n", "top", "copies"))
            token, level, side = (_lists(table.column(c)) for c in ("tokens", "levels", "sides"))
            packed = table.column("s")
            out = [[], [], []]
            for a, b in spans(table, keys):
                size = n[a:b].astype(np.int64)
                ok = eligible(size, block[a:b], i[a] != j[a], num, den)
                if ok.any():
                    ok = meet_here(ok, top[a:b], token[a:b], level[a:b], side[a:b], False)
                if not ok.any():
                    continue
                both = common([np.frombuffer(packed[k].as_py(), np.uint64) for k in range(a, b)])
                x, y = np.nonzero(ok & (den * both >= num * (size[:, None] + size[None, :] - both)))
                if not len(x):
                    continue
                links = np.bincount(x, copies[a:b][y], b - a) + np.bincount(y, copies[a:b][x], b - a)
                root = least_member(b - a, x, y)
                some = np.flatnonzero(links > 0)
                for column, values in zip(out, (cid[a:b][some], links[some].astype(np.int64), cid[a:b][root[some]])):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["cid", "links", "root"])

    found = scratch.keep(whole.mapInArrow(verify, "cid long, links long, root long"), "found")
    root = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    per = texts.where("n > 0").groupBy("cid").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    per = scratch.keep(per.join(root.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
                       .select("cid", "copies", "least", F.coalesce("root", "cid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    names = scratch.keep(per.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    facts = scratch.keep(per.join(names, "root").select("cid", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.col("root").alias("component")), "facts")
    return texts.join(facts.hint("merge"), "cid", "left").select(
        "file", "row", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("component")).alias("component"))


def one_of_each(df: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, a written table, without all but one of each
    component: that of the least id stays (null last, then by file and position
    in it); rows without shingles all stay.  The table is read twice, and how its
    files are split then may differ, so rows go by their place in a file."""
    found = similar_texts(df, width, num, den, id_col, text_col)
    scratch = Scratch(df.sparkSession, "one_of_each")
    rows = scratch.keep(found.where("component is not null and n_links > 0").select("file", "row", "doc_id", "component"), "rows")
    stay = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")).alias("s")).select("s.file", "s.row")
    gone = scratch.keep(rows.select("file", "row").join(stay, ["file", "row"], "left_anti")
                        .select(F.col("file").alias("_file"), F.col("row").alias("_row")), "gone")
    file, row = place(df)
    return df.select(*[F.col(f"`{c}`") for c in df.columns], file.alias("_file"), row.alias("_row")) \
        .join(gone.hint("merge"), ["_file", "_row"], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def _lists(column) -> list[np.ndarray]:
    """The rows of a list column as arrays."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(chunk, pa.ChunkedArray):
        chunk = pa.concat_arrays(chunk.chunks)
    at, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:])]


def _bitmap(ids: DataFrame) -> np.ndarray:
    """2^BLOOM bits with those of ``cid`` modulo 2^BLOOM set: a filter of fixed
    size that lets too many classes through at worst."""
    slot = F.col("cid").bitwiseAND((1 << BLOOM) - 1)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        low = pdf["low"].to_numpy(np.int64)
        np.bitwise_or.at(bits, low >> 3, (1 << (low & 7)).astype(np.uint8))
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [bits.tobytes()]})

    rows = ids.select(slot.alias("slot")).distinct().select(F.shiftright("slot", 19).cast("int").alias("chunk"),
                                                            F.col("slot").bitwiseAND((1 << 19) - 1).alias("low"))
    out = np.zeros(1 << (BLOOM - 3), np.uint8)
    for r in rows.groupBy("chunk").applyInPandas(pack, "chunk int, bits binary").toLocalIterator():
        out[r.chunk << 16:(r.chunk + 1) << 16] = np.frombuffer(bytes(r.bits), np.uint8)
    return out
