"""Toxicity scores by non-negative positive-unlabelled learning.

A linear numpy model is trained on confirmed toxic texts (P) and unlabelled
texts (U) with the risk ``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``:
unlabelled texts stand for clean ones, and what toxic texts among them add is
taken off by the class prior; where that correction turns negative the step
goes the other way (non-negative estimator).  The offset is set by the same
risk under the zero-one loss.  No text is ever used as a
confirmed negative; labels other than the positive ones enter only through
the prior, their toxic share.

Features of a text: which words (lower-cased by A-Z, runs of letters, digits
and bytes beyond ASCII), word beginnings and byte 4-grams it holds, hashed to
``2^DIM_BITS`` places; the model uses the ``SCREENED`` places whose shares
among P and U differ most.

Bounds: ``max_positive`` confirmed and ``max_unlabelled`` unlabelled texts, the
first by md5 of their id, are written once; their place counts are summed by
Spark, and one bit per screened place and text is gathered for training.  The
model is one broadcast of ``2^DIM_BITS`` floats at most.  Scoring is one pass over
all whole texts in bounded pieces, without a shuffle.

Defined cases: null and empty texts have no features and get the score of the
model's offset; no confirmed example or no unlabelled text gives score 0 to
all rows; repeated rows are all scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.common import Scratch

DIM_BITS = 20
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
STEMS = (4, 5, 6)           # lengths of the word beginnings that are features
SCREENED = 512              # places that the model uses
PIECE = 1 << 22             # bytes of one text that are hashed at a time

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INNER = np.ones(256, bool)     # bytes that are part of a word
_INNER[:48] = _INNER[58:65] = _INNER[91:97] = _INNER[123:128] = False


def _place(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - DIM_BITS)).astype(np.int32)


def _piece_features(b: np.ndarray) -> np.ndarray:
    b = _LOWER[b]
    grams = np.empty(0, np.int32)
    if len(b) >= 4:
        g = (b[:-3].astype(np.uint64) | b[1:-2].astype(np.uint64) << np.uint64(8)
             | b[2:-1].astype(np.uint64) << np.uint64(16) | b[3:].astype(np.uint64) << np.uint64(24))
        grams = _place(g, 1)
    inner = np.concatenate([[False], _INNER[b], [False]])
    edge = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = edge[::2], edge[1::2]
    # a word's hash: its bytes as a polynomial, by prefix sums modulo 2^64
    power = np.cumprod(np.full(len(b), 0x100000001B3, np.uint64))
    inverse = pow(0x100000001B3, -1, 1 << 64)
    back = np.cumprod(np.full(len(b) + 1, inverse, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power)])
    words = _place((sums[end] - sums[start]) * back[start], 2)
    stems = [_place((sums[np.minimum(start + k, end)] - sums[start]) * back[start], 2 + k) for k in STEMS]
    return np.unique(np.concatenate([grams, words, *stems]))


def features(text: bytes) -> np.ndarray:
    """Sorted distinct places of a text; long texts in pieces cut at a word's end."""
    parts, at = [], 0
    whole = np.frombuffer(text, np.uint8)
    while at < len(whole):
        end = min(at + PIECE, len(whole))
        if end < len(whole):
            outer = np.flatnonzero(~_INNER[_LOWER[whole[at:end]]])
            end = at + int(outer[-1]) + 1 if len(outer) else end
        parts.append(_piece_features(whole[at:end]))
        at = end
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.empty(0, np.int32)


class Model:
    """Screened places, their weights and the offset; ``2^DIM_BITS`` floats at most."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, offset: float):
        self.places, self.weights, self.offset = places, weights, offset
        self.dense = np.zeros(1 << DIM_BITS, np.float32)
        self.dense[places] = weights

    def score(self, found: np.ndarray) -> float:
        z = float(self.dense[found].sum(dtype=np.float64)) + self.offset
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def screen(sample: DataFrame, n_positive: int, n_unlabelled: int, most: int = SCREENED) -> np.ndarray:
    """Places whose share among P differs most from that among U, in standard
    errors.  Counted where the texts are: a task gives one row per place that
    its texts hold; ``most`` rows reach the driver."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << DIM_BITS), np.int64)
        for batch in batches:
            for text, p, u in zip(batch.column("text"), batch.column("p").to_pylist(), batch.column("u").to_pylist()):
                found = features(text.as_py() or b"")
                counts[0, found] += p
                counts[1, found] += u
        place = np.flatnonzero(counts.any(0))
        for at in range(0, len(place), 1 << 16):
            part = place[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["place", "p", "u"])

    held = sample.select("text", "p", "u").mapInArrow(tally, "place long, p long, u long").groupBy("place").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = (F.col("p") + F.col("u") + 1) / F.lit(float(n_positive + n_unlabelled + 2))
    error = F.sqrt(both * (1 - both) * F.lit(1 / n_positive + 1 / n_unlabelled))
    z = F.abs(F.col("p") / F.lit(float(n_positive)) - F.col("u") / F.lit(float(n_unlabelled))) / error
    best = held.select("place", z.alias("z")).where("z > 2").orderBy(F.desc("z"), "place").limit(most)
    return np.sort(np.array([r.place for r in best.collect()], np.int64))


class NnPu:
    """Linear model trained with the non-negative PU risk (logistic loss, Adam)."""

    def __init__(self, prior: float, steps: int = 2000, batch: int = 512, rate: float = 0.01, decay: float = 3e-3, seed: int = 7):
        self.prior, self.steps, self.batch, self.rate, self.decay, self.seed = prior, steps, batch, rate, decay, seed

    def slope(self, xp: np.ndarray, xu: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The step's direction: of the whole risk, or, where the corrected
        negative risk is below zero, away from that."""
        now = w.astype(np.float32)
        zp, zu = (xp @ now).astype(float), (xu @ now).astype(float)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        negative = np.logaddexp(0, zu).mean() - self.prior * np.logaddexp(0, zp).mean()
        up, down_p, down_u = self.prior * (sp - 1) / len(xp), -self.prior * sp / len(xp), su / len(xu)
        if negative >= 0:
            return ((up + down_p).astype(np.float32) @ xp + down_u.astype(np.float32) @ xu).astype(float)
        return -(down_p.astype(np.float32) @ xp + down_u.astype(np.float32) @ xu).astype(float)

    def fit(self, places: np.ndarray, p: np.ndarray, u: np.ndarray) -> Model:
        """``p`` and ``u``: which of ``places`` each text holds, as 0 and 1."""
        dim = len(places)
        p, u = (np.column_stack([x, np.ones(len(x))]).astype(np.float32) for x in (p, u))
        w, m, v = (np.zeros(dim + 1) for _ in range(3))
        w[dim] = np.log(self.prior / (1 - self.prior))
        rng = np.random.default_rng(self.seed)
        for t in range(1, self.steps + 1):
            xp = p[rng.integers(0, len(p), self.batch)]
            xu = u[rng.integers(0, len(u), self.batch)]
            grad = self.slope(xp, xu, w)
            grad[:dim] += self.decay * w[:dim]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            w -= self.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        weights = w[:dim].astype(np.float32)
        return Model(places, weights, -cut(p[:, :dim] @ weights, u[:, :dim] @ weights, self.prior))


def cut(p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """The threshold of least non-negative PU risk under the zero-one loss; of
    equal ones the middle of the widest gap."""
    values = np.unique(np.concatenate([p, u]).astype(float))
    if len(values) < 2:
        return float(values[0]) + 1.0
    middle, gap = (values[1:] + values[:-1]) / 2, np.diff(values)
    found = 1 - np.searchsorted(np.sort(p), middle) / len(p)
    flagged = 1 - np.searchsorted(np.sort(u), middle) / len(u)
    risk = prior * (1 - found) + np.maximum(0, flagged - prior * found)
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(middle[best[np.argmax(gap[best])]])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5 (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on rows that are not held out; None without examples of either kind."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).where(F.col("id").isNotNull())
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), "toxic").where(~held_out(F.col("id")))
    prior = marks.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    order = F.md5(F.col("id").cast("string"))
    positive = ids.join(marks.where("toxic = 1").select("id"), "id", "left_semi").distinct() \
        .orderBy(order, "id").limit(max_positive)
    unlabelled = ids.where(~held_out(F.col("id"))).distinct().orderBy(order, "id").limit(max_unlabelled)
    # at most max_positive + max_unlabelled ids
    chosen = {kind: [r.id for r in frame.collect()] for kind, frame in (("p", positive), ("u", unlabelled))}
    if not chosen["p"] or not chosen["u"]:
        return None
    spark = docs.sparkSession
    p, u = set(chosen["p"]), set(chosen["u"])
    wanted = spark.createDataFrame([(i, int(i in p), int(i in u)) for i in sorted(p | u)], "id long, p int, u int")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    # one text an id, so at most max_positive + max_unlabelled texts, however often an id is repeated
    sample = Scratch(spark, "toxicity").keep(
        texts.join(F.broadcast(wanted), "id").groupBy("id", "p", "u").agg(F.max("text").alias("text")), "sample")
    places = screen(sample, len(p), len(u))

    def held(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: np.packbits(np.isin(places, features(x or b""))).tobytes())
    # one bit a place: SCREENED / 8 bytes a text
    bits = {r.id: np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=len(places))
            for r in sample.select("id", F.pandas_udf("binary")(held)("text").alias("bits")).toLocalIterator()}
    p, u = (np.stack([bits[i] for i in chosen[kind]]) for kind in ("p", "u"))
    return NnPu(min(max(float(prior), 0.001), 0.5)).fit(places, p, u)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """``docs`` plus ``held_out, score, predicted``; earlier columns of these
    names are replaced."""
    model = train(docs, labels, id_col, text_col, max_positive, max_unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for part in parts:
            yield part.map(lambda x: 0.0 if fitted is None else fitted.score(features((x or "").encode()))).astype("float64")

    own = ("held_out", "score", "predicted")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return (docs.select(*rest, held_out(F.col(f"`{id_col}`")).alias("held_out"), scored(F.col(f"`{text_col}`")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
