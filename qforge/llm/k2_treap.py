"""Ranked lexical search over K2-treaps of the term-document grid.

``index_documents`` writes, for blocks of documents in the order of the scan,
the block's terms with their postings.  ``search`` ranks all documents for
each item:

1. Document and term counts over all blocks give the terms' integer weights;
   only terms that items hold are joined.  Items are dealt into packs of about
   ``PACK`` (item, term) pairs.
2. Each block meets each pack.  The pack's terms found in the block are the
   rows of a grid, the block's documents its columns (shorter documents
   first), and a cell's impact is ``(10^9 tf) div (1000 tf + 20 m)``.  A
   ``Treap`` holds the grid: a quadtree that stores four bits per inner cell
   (which quadrants hold anything), a running count that finds them, and the
   largest impact within each cell.
3. For each item the paths of its terms' rows descend together: a state is a
   range of documents with one cell per term, bounded by the sum of weight x
   largest impact.  States are opened best first, ``WIDTH`` at a time, until
   no bound reaches the ``k``-th best score.  At one document the bound is the
   score.  A task carries each item's ``k``-th best score on to its next block.
4. Each block gives at most ``k`` rows an item; the ``k`` best of these stay.

A block holds up to ``DOCS`` documents or about ``POSTINGS`` postings, a task
one block and one pack.  A single pack of checked size is sent to all tasks;
otherwise blocks meet packs in an equi-join on (pack, salt), so that neither
side is ever one key's burden.

Defined cases: null and empty texts hold no term, count in no statistic and
are never found; items without text or without a known term give no rows;
every benchmark row is an item of its own, so repeated or null item ids are
ranked each; repeated documents are ranked each, ties going to the smaller
doc_id, null ids last; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qforge.llm.common import Scratch
from qforge.llm.words import words_of

DOCS = 1 << 13
POSTINGS = 1 << 20
PACK = 1 << 17
WIDTH = 128                # states opened at once
SALT = 4                   # blocks a salt value stands for
SENT = 16 << 20            # bytes of a pack that may go to all tasks

INDEX = ("block long, doc_ids array<long>, doc_rows binary, doc_terms binary, n_docs long, n_terms long, "
         "terms array<binary>, df array<int>, posting_docs binary, posting_tf binary")


class Treap:
    """A grid's non-empty cells with their impacts, as a K2-treap."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, impact: np.ndarray):
        self.depth = max(int(max(rows.max(), cols.max())).bit_length(), 1) if len(rows) else 1
        code = _spread(rows) << 1 | _spread(cols)
        order = np.argsort(code, kind="stable")
        code, top = code[order], impact[order].astype(np.int64)
        masks, tops = [np.zeros(len(code), np.uint8)], [top]
        for _ in range(self.depth):
            above = code >> 2
            head = np.flatnonzero(np.append(True, above[1:] != above[:-1])) if len(code) else np.empty(0, np.int64)
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & 3).astype(np.uint8), head) if len(head) else np.empty(0, np.uint8))
            top = np.maximum.reduceat(top, head) if len(head) else top
            tops.append(top)
            code = above[head]
        masks.reverse()
        tops.reverse()
        self.mask, self.top = np.concatenate(masks), np.concatenate(tops)
        # children follow level by level, in the order of their parents
        children = np.bitwise_count(self.mask).astype(np.int64)
        self.first = 1 + np.cumsum(children) - children

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(columns, scores) of all columns that can be among the best ``k``
        and score at least ``floor``, at least 1; and the score known to be
        reached by the ``k``-th best."""
        floor = max(floor, 1)
        found_cols, found = np.empty(0, np.int64), np.empty(0, np.int64)
        level = np.array([self.depth])
        col = np.zeros(1, np.int64)
        cell = np.zeros((1, len(rows)), np.int64)
        bound = np.array([int((weights * self.top[0]).sum())]) if len(self.top) and len(rows) else np.zeros(1, np.int64)
        while len(bound):
            keep = bound >= floor
            if not keep.all():
                level, col, cell, bound = level[keep], col[keep], cell[keep], bound[keep]
                if not len(bound):
                    break
            if len(bound) > WIDTH:
                best = np.argpartition(bound, len(bound) - WIDTH)
                rest, best = best[:-WIDTH], best[-WIDTH:]
            else:
                rest, best = np.empty(0, np.int64), np.arange(len(bound))
            # open the best: each range of documents into its two halves
            node, down = cell[best], level[best] - 1
            at = np.maximum(node, 0)
            mask = np.where(node >= 0, self.mask[at], 0)
            first = self.first[at]
            low_bit = (rows[None, :] >> down[:, None] & 1) * 2
            kids = []
            for half in (0, 1):
                quadrant = low_bit + half
                here = mask >> quadrant & 1
                kids.append(np.where(here > 0, first + np.bitwise_count(mask & ((1 << quadrant) - 1)), -1))
            kid = np.concatenate(kids)
            value = np.where(kid >= 0, self.top[np.maximum(kid, 0)], 0) @ weights
            kid_col = np.concatenate([col[best] * 2, col[best] * 2 + 1])
            kid_level = np.concatenate([down, down])
            leaf = kid_level == 0
            done = leaf & (value >= floor)
            if done.any():
                found_cols, found = np.append(found_cols, kid_col[done]), np.append(found, value[done])
                if len(found) >= k:
                    floor = max(floor, int(np.partition(found, len(found) - k)[len(found) - k]))
                    stay = found >= floor
                    found_cols, found = found_cols[stay], found[stay]
            go = ~leaf & (value >= floor)
            level, col = np.append(level[rest], kid_level[go]), np.append(col[rest], kid_col[go])
            cell, bound = np.concatenate([cell[rest], kid[go]]), np.append(bound[rest], value[go])
        return found_cols, found, floor


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of ``x`` (under 2^31) at even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of up to DOCS documents, by term."""
    numbers: dict[bytes, int] = {}
    ids, rows, sizes, terms, docs, tfs = [], [], [], [], [], []
    held = 0

    def out() -> pa.RecordBatch:
        term = np.concatenate(terms) if terms else np.empty(0, np.int64)
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(docs)), docs)[order].astype(np.uint16)
        tf = np.concatenate(tfs)[order] if tfs else np.empty(0, np.int64)
        values = {"block": [rows[0]], "doc_ids": [ids], "doc_rows": [np.array(rows, np.int64).tobytes()],
                  "doc_terms": [np.array(sizes, np.int64).tobytes()], "n_docs": [sum(n > 0 for n in sizes)], "n_terms": [sum(sizes)],
                  "terms": [list(numbers)], "df": [np.bincount(term, minlength=len(numbers)).tolist()],
                  "posting_docs": [doc.tobytes()], "posting_tf": [tf.astype(np.uint32).tobytes()]}
        return pa.RecordBatch.from_pydict(values, pa.schema([
            ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_rows", pa.binary()), ("doc_terms", pa.binary()),
            ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())),
            ("posting_docs", pa.binary()), ("posting_tf", pa.binary())]))
    for batch in batches:
        for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
            words = words_of(text.as_py())
            term, tf = np.unique(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64), return_counts=True)
            ids.append(doc_id)
            rows.append(row)
            sizes.append(len(words))
            terms.append(term)
            docs.append(len(term))
            tfs.append(tf)
            held += len(term)
            if len(rows) >= DOCS or held >= POSTINGS:
                yield out()
                numbers = {}
                ids, rows, sizes, terms, docs, tfs = [], [], [], [], [], []
                held = 0
    if rows:
        yield out()


def index_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of all rows of ``df`` under ``path`` and read it."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows.mapInArrow(_blocks, INDEX).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(INDEX).parquet(path)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for row, item, text in zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist(), batch.column("text")):
            out += [(row, item, t) for t in set(words_of(text.as_py()))]
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], batch.schema.field("item_id").type),
                                          pa.array(columns[2], pa.binary())], names=["item", "item_id", "term"])


def weight(n: int):
    """The weight of a term held by ``df`` of ``n`` documents."""
    return F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")


def impacts(tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """A term's share of the score in documents of ``size`` terms."""
    m = 50 + (50 * size * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One pack's items, each with its terms and their weights."""
    pdf = pdf.sort_values(["item", "term"], ignore_index=True)
    terms = sorted(set(pdf.term))
    number = {t: k for k, t in enumerate(terms)}
    heads = np.flatnonzero(np.append(True, pdf["item"].to_numpy()[1:] != pdf["item"].to_numpy()[:-1]))
    w = dict(zip(pdf.term, pdf.weight))
    return pd.DataFrame({"pack": [pdf["pack"].iloc[0]], "item_rows": [pdf["item"].to_numpy(np.int64)[heads].tobytes()],
                         "item_heads": [heads.astype(np.int64).tobytes()], "pack_terms": [terms],
                         "item_terms": [np.array([number[t] for t in pdf.term], np.int32).tobytes()],
                         "weights": [np.array([w[t] for t in terms], np.int64).tobytes()]})


def _ints(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), kind)


def _searcher(k: int, n: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[tuple, int] = {}                      # per item, of the task's packs
        for batch in batches:
            for r in range(batch.num_rows):
                col = {name: batch.column(name)[r] for name in batch.schema.names}
                yield _search_block(col, k, n, total, floors)
    return run


def _search_block(col: dict, k: int, n: int, total: int, floors: dict) -> pa.RecordBatch:
    wanted = {t: i for i, t in enumerate(col["pack_terms"].as_py())}
    df = np.array(col["df"].as_py(), np.int64)
    ends = np.cumsum(df)
    here = [(wanted[t], i) for i, t in enumerate(col["terms"].as_py()) if t in wanted]
    here.sort(key=lambda x: (-df[x[1]], x[1]))             # frequent terms side by side
    sizes, ids = _ints(col["doc_terms"], np.int64), col["doc_ids"].as_py()
    doc_rows = _ints(col["doc_rows"], np.int64)
    order = np.argsort(sizes, kind="stable")               # columns: shorter documents first
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    docs, tf = _ints(col["posting_docs"], np.uint16), _ints(col["posting_tf"], np.uint32)
    spans = [(ends[i] - df[i], ends[i]) for _, i in here]
    doc = np.concatenate([docs[a:b] for a, b in spans] or [docs[:0]]).astype(np.int64)
    count = np.concatenate([tf[a:b] for a, b in spans] or [tf[:0]]).astype(np.int64)
    row = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
    out = []
    if len(doc):
        treap = Treap(row, column[doc], impacts(count, sizes[doc], n, total))
        place = np.full(len(wanted), -1, np.int64)
        place[[p for p, _ in here]] = np.arange(len(here))
        weights = _ints(col["weights"], np.int64)
        items, heads, terms = _ints(col["item_rows"], np.int64), _ints(col["item_heads"], np.int64), _ints(col["item_terms"], np.int32)
        for t, own in zip(items.tolist(), np.split(terms, heads[1:])):
            own = own[(place[own] >= 0) & (weights[own] > 0)]
            if not len(own):
                continue
            cols, scores, floors[t] = treap.search(place[own], weights[own], k, floors.get(t, 1))
            found = sorted((-s, ids[d] is None, ids[d] or 0, int(doc_rows[d])) for d, s in zip(order[cols].tolist(), scores.tolist()))
            out += [(t, None if empty else doc_id, row, -s) for s, empty, doc_id, row in found[:k]]
    columns = list(zip(*out)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "row", "score"])


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of ``index``
    for each row of ``items``."""
    spark: SparkSession = index.sparkSession
    scratch = Scratch(spark, "search")
    asked = items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{id_col}`").alias("item_id"),
                         F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    pairs = scratch.keep(asked.mapInArrow(_item_terms, f"item long, item_id {kind}, term binary"), "pairs")
    n, total, blocks = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    n_pairs, n_bytes = pairs.agg(F.count("*"), F.sum(F.octet_length("term") + 24)).first()
    packs = max(1, -(-n_pairs // PACK))
    counts = (index.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select("t.terms", "t.df")
              .join(pairs.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
              .groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df")))
    weighed = (pairs.join(counts.withColumn("weight", weight(n or 0)).drop("df"), "term")
               .select(F.pmod(F.xxhash64("item"), F.lit(packs)).alias("pack"), "item", "term", "weight"))
    packed = scratch.keep(weighed.groupBy("pack").applyInPandas(
        _pack, "pack long, item_rows binary, item_heads binary, pack_terms array<binary>, item_terms binary, weights binary"), "packs")
    blocked = index.select(*[c for c in index.columns if c not in ("n_docs", "n_terms")])
    if packs == 1 and (n_bytes or 0) <= SENT:
        met = blocked.withColumn("pack", F.lit(0).cast("long")).join(F.broadcast(packed), "pack")
    else:                                                  # every block meets every pack, by equal (pack, salt)
        salts = max(1, -(-(blocks or 0) // SALT))
        left = (blocked.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))))
                .withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts))))
        right = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        met = left.join(right, ["pack", "salt"]).drop("salt")
    met = met.drop("pack", "block")
    hits = met.mapInArrow(_searcher(k, n or 0, total or 1), "item long, doc_id long, row long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (best.join(pairs.select("item", "item_id").distinct(), "item")
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
