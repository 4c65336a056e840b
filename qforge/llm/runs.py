"""Periodic runs of words, by internal pattern matching.

A run is a stretch of consecutive words with smallest period ``q`` and length
at least ``max(24, 3 q)`` that no neighbouring word extends with that period.

Many texts are searched at once: their words become integers that no two
texts share, laid end to end with separators.  Prefix doubling sorts the
suffixes; after each doubling the places whose ``B`` words occur once drop
out, and for the aligned block of ``B = 8, 16, 32, ..`` words at every
multiple of ``B`` its suffix-array interval is kept if it holds another place.
A wavelet tree over the suffix array answers range successor: which are the
occurrences of a block in a neighbouring window, from the next one on?

A run of period ``q`` (``B <= q < 2 B``, or ``q < 8`` with ``B = 8``) holds an
aligned block and its copy ``q`` words on, which lies in the window
``[B, 2 B)`` behind it.  One or two occurrences there are candidate periods.
More form a progression whose difference ``p`` is the block's own period;
then the block and the window's occurrences lie in two ``p``-periodic
stretches, and the shift between these two's starts or ends is the only
possible period.  A candidate's stretch is extended both ways word by word;
stretches of one extent keep their least period.

Row-local: one pass over the documents, no shuffle.  A task holds one batch
of texts, about ``BATCH`` words or one longer text, at some 150 bytes a word.

Defined cases: null and empty texts have no words, no runs and an empty
collapsed text; repeated rows are searched each; invalid UTF-8 is taken as
bytes; a column of the frame that bears the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 24                 # words of a run
TIMES = 3                  # periods of a run
BLOCK = 8                  # words of the shortest block; a run has LEAST >= 3 * BLOCK
BATCH = 1 << 17            # words searched at once

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:binary>"


class WaveletTree:
    """Values in the order given; counts and selections in ranges of places."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.levels = []
        v = values.astype(np.int64)
        for bit in range(bits - 1, -1, -1):
            ones = (v >> bit & 1).astype(bool)
            packed = np.zeros((len(v) >> 6) + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[:len(raw)] = raw
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.levels.append((packed, before, len(v) - int(before[-1])))
            v = np.concatenate([v[~ones], v[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        packed, before, _ = self.levels[level]
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in places ``[lo, hi)`` are under ``x``."""
        lo, hi = lo.astype(np.int64), hi.astype(np.int64)
        x = np.minimum(x, (1 << self.bits) - 1)
        count = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(one, (hi - b) - (lo - a), 0)
            zeros = self.levels[level][2]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest value (from 0) in places ``[lo, hi)``."""
        lo, hi, k = lo.astype(np.int64), hi.astype(np.int64), k.astype(np.int64)
        value = np.zeros(len(lo), np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            low = (hi - b) - (lo - a)
            one = k >= low
            k = np.where(one, k - low, k)
            zeros = self.levels[level][2]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
        return value


def repeated_blocks(s: np.ndarray, longest: int):
    """The suffix array of ``s`` as far as it was needed, the places in it
    that repeat ``BLOCK`` words, and per block length ``(B, blocks, lo, hi)``:
    aligned blocks and their intervals."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.empty(n, bool)
    first[:1] = True
    first[1:] = s[sa[1:]] != s[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    alone = first & np.append(first[1:], True)
    open_ = np.flatnonzero(~alone)             # places of the suffix array in groups of two or more
    levels, repeat, width = [], open_[:0], 1
    while len(open_):
        if width >= BLOCK:
            if width == BLOCK:
                repeat = open_
            place = sa[open_]
            lo = rank[place]
            ends = np.flatnonzero(np.append(lo[1:] != lo[:-1], True))
            hi = open_[ends[np.searchsorted(open_[ends], open_)]] + 1
            on = place % width == 0
            levels.append((width, place[on], lo[on], hi[on]))
        if TIMES * 2 * width > longest and width >= BLOCK:      # no run has a period of 2 * width
            break
        place = sa[open_]
        head = rank[place]
        after = rank[np.minimum(place + width, n)]
        order = np.lexsort((after, head))
        place, head, after = place[order], head[order], after[order]
        sa[open_] = place
        new = np.empty(len(place), bool)
        new[:1] = True
        new[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        rank[place] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    return sa, repeat, levels


def equal_ahead(s: np.ndarray, i: int, q: int) -> int:
    """How many words from ``i`` on equal those ``q`` words on."""
    done, step, room = 0, 64, len(s) - q - i
    while done < room:
        m = min(step, room - done)
        differ = s[i + done:i + done + m] != s[i + q + done:i + q + done + m]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + m, step * 2
    return done


def equal_behind(s: np.ndarray, i: int, q: int) -> int:
    """How many words before ``i`` equal those ``q`` words on."""
    done, step = 0, 64
    while done < i:
        m = min(step, i - done)
        differ = s[i - done - m:i - done][::-1] != s[i + q - done - m:i + q - done][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, step = done + m, step * 2
    return done


def stretch(s: np.ndarray, j: int, q: int) -> tuple[int, int]:
    """The largest ``[start, stop)`` around ``j`` with period ``q``."""
    return j - equal_behind(s, j, q), j + q + equal_ahead(s, j, q)


def candidates(s: np.ndarray, longest: int) -> np.ndarray:
    """(period, block) pairs that hold every run's own."""
    sa, repeat, levels = repeated_blocks(s, longest)
    if not levels:
        return np.empty((0, 2), np.int64)
    tree = WaveletTree(sa[repeat], max(1, len(s).bit_length()))
    out = []

    def successors(block, lo, hi, k):
        """The occurrence number ``k`` of each block's interval."""
        return np.stack([tree.smallest(lo, hi, k) - block, block], axis=1)
    for width, block, lo, hi in levels:
        lo, hi = np.searchsorted(repeat, lo), np.searchsorted(repeat, hi)
        if width == BLOCK:
            c0, c1 = tree.below(lo, hi, block + 1), tree.below(lo, hi, block + BLOCK)
            for t in range(BLOCK - 1):
                on = c1 - c0 > t
                out.append(successors(block[on], lo[on], hi[on], c0[on] + t))
        c0, c1 = tree.below(lo, hi, block + width), tree.below(lo, hi, block + 2 * width)
        for t in range(2):
            on = (c1 - c0 > t) & (c1 - c0 <= 2)
            out.append(successors(block[on], lo[on], hi[on], c0[on] + t))
        many = np.flatnonzero(c1 - c0 >= 3)
        if len(many):
            one = tree.smallest(lo[many], hi[many], c0[many])
            two = tree.smallest(lo[many], hi[many], c0[many] + 1)
            seen = (0, 0, 0)
            for j, a, p in zip(block[many].tolist(), one.tolist(), (two - one).tolist()):
                if not (seen[0] == p and seen[1] <= j and j + width <= seen[2]):
                    seen = (p, *stretch(s, j, p))
                if seen[1] <= a and a + width <= seen[2]:
                    continue                                # the same stretch: shorter periods
                start, stop = stretch(s, a, p)
                out.append(np.array([[q, j] for q in {start - seen[1], stop - seen[2]} if width <= q < 2 * width], np.int64).reshape(-1, 2))
    return np.unique(np.concatenate(out), axis=0)


def find_runs(s: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs of ``s`` as (start, length, period), in that order; ``longest``
    bounds their length."""
    least: dict[tuple[int, int], int] = {}
    period = stop = -1
    for q, j in candidates(s, longest).tolist():
        if q == period and j + q <= stop:
            continue                                        # within the stretch before
        start, stop = stretch(s, j, q)
        period = q
        if stop - start >= max(LEAST, TIMES * q):
            least[start, stop] = min(q, least.get((start, stop), q))
    return sorted((a, b - a, q) for (a, b), q in least.items())


def search_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words."""
    parts, begin, at, code = [], [], 0, 0
    numbers: dict[bytes, int]
    for words in texts:
        numbers = {}
        own = [numbers.setdefault(w, len(numbers)) for w in words]
        own.append(len(numbers))                            # a separator found nowhere else
        parts.append(np.array(own, np.int64) + code)
        begin.append(at)
        at += len(own)
        code += len(numbers) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if parts:
        found = find_runs(np.concatenate(parts), max(map(len, texts)))
        place = np.searchsorted(begin, [a for a, _, _ in found], "right") - 1
        for t, (a, n, q) in zip(place.tolist(), found):
            out[t].append((a - begin[t], n, q))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Without the words any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _runs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        counts, runs, kept = [], [], []
        group: list[list[bytes]] = []
        size = 0

        def search():
            long = [k for k, w in enumerate(group) if len(w) >= LEAST]
            found = dict(zip(long, search_texts([group[k] for k in long])))
            for k, words in enumerate(group):
                own = found.get(k, [])
                counts.append(len(words))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                kept.append(b" ".join(collapse(words, own)))
        for text in batch:
            words = (text or b"").split()                   # exactly the six ASCII white-space bytes cut
            if group and size + len(words) > BATCH:
                search()
                group, size = [], 0
            group.append(words)
            size += len(words)
        if group:
            search()
        yield pd.DataFrame({"n_words": counts, "runs": runs, "collapsed": kept})


def runs_column(text: Column) -> Column:
    """The runs of a text column and the text without their repeats."""
    return F.pandas_udf(RESULT)(_runs)(text.cast("binary"))


def periodic_runs(df: DataFrame, text_col: str = "text", out: str = "periodic") -> DataFrame:
    """``df`` with the struct ``out``: ``n_words``, ``runs`` (start, length and
    period in words, by start, then period) and ``collapsed``, the words that
    no run repeats, joined by single blanks."""
    return df.withColumn(out, runs_column(F.col(f"`{text_col}`")))
