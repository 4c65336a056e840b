"""Array functions: n-grams, multiset overlap, LCS, pad/truncate.

Every ``sequence`` is guarded by a size check: ``sequence(1, 0)`` counts
*down* in Spark, it does not return an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams, each joined by a single space."""
    t = _c(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def clipped_overlap(pred_grams, ref_grams) -> Column:
    """Sum over distinct grams of ``min(count_pred, count_ref)``: the size of
    the multiset intersection.  Both sides are sorted together, a gram's
    prediction occurrences before its reference ones, and one fold spends the
    former on the latter; linear after the sort."""
    def side(grams, k):
        return F.transform(_c(grams), lambda g: F.struct(g.alias("g"), F.lit(k).alias("side")))

    def state(g, left, o):
        return F.struct(g.alias("g"), left.cast("int").alias("left"), o.cast("bigint").alias("o"))

    def step(s, x):
        same = s["g"] == x["g"]
        return (F.when(x["side"] == 0, state(x["g"], F.when(same, s["left"] + 1).otherwise(1), s["o"]))
                .when(same & (s["left"] > 0), state(s["g"], s["left"] - 1, s["o"] + 1))
                .otherwise(state(x["g"], F.lit(0), s["o"])))
    both = F.array_sort(F.concat(side(pred_grams, 0), side(ref_grams, 1)))
    return F.aggregate(both, state(F.lit(None).cast("string"), F.lit(0), F.lit(0)), step, lambda s: s["o"])


def pad_truncate(ids, n: int, pad: int = 0) -> Column:
    """Truncate to ``n`` and right-pad with ``pad``."""
    return F.slice(F.concat(_c(ids), F.array_repeat(F.lit(pad), n)), 1, n)


LIMB = 62                  # bits of a limb: the sum of two and a carry stays below 2^63
FULL = (1 << LIMB) - 1


def token_masks(tokens) -> Column:
    """``struct(keys, masks)``: the distinct tokens, sorted, and for each its
    places as a bit vector in limbs of ``LIMB`` bits.  One fold over the sorted
    (token, place) pairs."""
    t = _c(tokens)
    limbs = F.ceil(F.size(t) / LIMB).cast("int")
    zero = F.array_repeat(F.lit(0).cast("bigint"), limbs)
    pairs = F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("i"))))

    def state(keys, masks):
        return F.struct(keys.alias("keys"), masks.alias("masks"))

    def marked(mask, i):
        return F.transform(mask, lambda v, w: F.when(w == F.floor(i / LIMB), v.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(LIMB))))).otherwise(v))

    def step(s, x):
        n = F.size(s["keys"])
        same = (n > 0) & (F.get(s["keys"], n - 1) == x["t"])
        last = F.get(s["masks"], n - 1)
        return F.when(F.coalesce(same, F.lit(False)),
                      state(s["keys"], F.concat(F.slice(s["masks"], 1, n - 1), F.array(marked(last, x["i"]))))) \
            .otherwise(state(F.array_append(s["keys"], x["t"]), F.array_append(s["masks"], marked(zero, x["i"]))))
    return F.aggregate(pairs, state(F.array().cast("array<string>"), F.array().cast("array<array<bigint>>")), step)


def lcs_bitparallel(pred_tokens, ref_tokens, masks) -> Column:
    """LCS length by the bit-parallel recurrence (Hyyro 2004) over bit vectors
    of any length: for each reference token with mask M, ``V = (V + (V & M)) |
    (V & ~M)``, limb by limb with carry; the LCS is the number of zero bits
    among the low ``m``.  ``masks`` is a column of ``token_masks`` of the
    prediction, materialised so that it is built once a row."""
    p, r, known = _c(pred_tokens), _c(ref_tokens), _c(masks)
    m = F.size(p)
    limbs = F.ceil(m / LIMB).cast("int")
    full = F.lit(FULL).cast("bigint")

    def limb_step(vector, mask):
        def step(s, i):
            v, k = F.get(vector, i), F.get(mask, i)
            total = v + v.bitwiseAND(k) + s["carry"]
            return F.struct(F.call_function("shiftright", total, F.lit(LIMB)).alias("carry"),
                            F.array_append(s["out"], total.bitwiseAND(full).bitwiseOR(v.bitwiseAND(F.bitwise_not(k)))).alias("out"))
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(vector) - 1), start, step, lambda s: s["out"])

    def step(vector, token):
        at = F.array_position(known["keys"], token).cast("int")
        return F.when(at == 0, vector).otherwise(limb_step(vector, F.get(known["masks"], at - 1)))

    vector = F.aggregate(r, F.array_repeat(full, limbs), step)

    def ones(acc, v, w):
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(m - w * LIMB, F.lit(LIMB))) - 1
        return acc + F.bit_count(v.bitwiseAND(low))
    kept = F.aggregate(F.transform(vector, lambda v, w: F.struct(v.alias("v"), w.alias("w"))), F.lit(0),
                       lambda acc, x: ones(acc, x["v"], x["w"]))
    return F.when((m == 0) | (F.size(r) == 0), F.lit(0)).otherwise(m - kept)
