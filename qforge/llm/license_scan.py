"""License scan by ordered signature rules.

A text's words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased)
are joined by single blanks.  One Aho-Corasick pass over that finds which
rules' keywords occur; only those rules' regular expressions run, over the
whole text.  Detections are intervals of words.  They are taken by falling
priority, longer ones first, then in rule order; one that lies within an
interval already taken is suppressed, one that merely overlaps stays.

Base phrases are rules like the others, but their places are counted and their
labels kept whether or not a stronger rule suppresses them.

The scan is row-local: one pass over the documents, no shuffle.  Memory in a
task is a few times its largest text.

Defined cases: null and empty texts have no words and no detections (null
places, empty labels, score 0); repeated rows are scanned each; bytes beyond
ASCII are word characters whatever they encode; a column of the frame that
bears the result's name is replaced.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qforge.llm.license_rules import Rule, rules
from qforge.llm.words import WORD

RESULT = ("struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,"
          "labels:array<string>,score:double,"
          "detections:array<struct<start:bigint,stop:bigint,label:string,kind:string,confidence:double>>>")


class Detection(NamedTuple):
    start: int             # first word
    stop: int              # after the last word
    rule: int


def word_line(text: bytes) -> tuple[str, int]:
    """The words joined by single blanks, with one before and one after them
    (one character a byte), and their number."""
    a = np.frombuffer(b" " + text.translate(WORD) + b" ", np.uint8)
    inner = a != 32
    keep = inner.copy()
    keep[1:] |= inner[:-1]
    keep[0] = True
    return a[keep].tobytes().decode("latin-1"), int(np.count_nonzero(inner[1:] & ~inner[:-1]))


class Scanner:
    def __init__(self, rule_list: list[Rule]):
        self.rules = rule_list
        self.gate = ahocorasick.Automaton()
        by_word: dict[str, list[int]] = {}
        for k, rule in enumerate(rule_list):
            by_word.setdefault(rule.keyword, []).append(k)
        for word, which in by_word.items():
            self.gate.add_word(word, tuple(which))
        self.gate.make_automaton()

    def detect(self, line: str) -> list[Detection]:
        """All matches of the rules whose keyword occurs."""
        found = sorted(set(k for which in set(w for _, w in self.gate.iter(line)) for k in which))
        spans = [(m.start(), m.end(), k) for k in found for m in self.rules[k].pattern.finditer(line)]
        if not spans:
            return []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(blanks, [s for s, _, _ in spans]) - 1
        stops = np.searchsorted(blanks, [e for _, e, _ in spans])
        return [Detection(int(a), int(b), k) for a, b, (_, _, k) in zip(starts, stops, spans)]

    def resolve(self, found: list[Detection]) -> list[Detection]:
        """Detections that lie in none of a higher rank."""
        kept: list[Detection] = []
        for priority in sorted({self.rules[d.rule].priority for d in found}, reverse=True):
            above = sorted(kept)
            starts, reach = [d.start for d in above], list(np.maximum.accumulate([d.stop for d in above])) if above else []
            furthest = -1
            level = (d for d in found if self.rules[d.rule].priority == priority)
            for d in sorted(level, key=lambda d: (d.start, -d.stop, d.rule)):
                at = bisect_right(starts, d.start)
                if (at and reach[at - 1] >= d.stop) or furthest >= d.stop:
                    continue
                furthest = d.stop
                kept.append(d)
        return sorted(kept)

    def scan(self, text: bytes | None) -> tuple:
        line, n_words = word_line(text or b"")
        found = self.detect(line)
        base = [d for d in found if self.rules[d.rule].base]
        kept = self.resolve(found)
        base_labels = {self.rules[d.rule].label for d in base}
        labels = base_labels | {self.rules[d.rule].label for d in kept}
        score = max((self.rules[d.rule].confidence for d in kept), default=0.0)
        return (n_words, len(base), min((d.start for d in base), default=None), max((d.start for d in base), default=None),
                sorted(base_labels), sorted(labels), score,
                [{"start": d.start, "stop": d.stop, "label": self.rules[d.rule].label, "kind": self.rules[d.rule].kind,
                  "confidence": self.rules[d.rule].confidence} for d in kept])


@functools.cache
def scanner() -> Scanner:
    """One scanner per Python worker."""
    return Scanner(rules())


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")


def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    scan = scanner().scan
    for batch in texts:
        out = pd.DataFrame([scan(t) for t in batch], columns=FIELDS)
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def license_column(text: Column) -> Column:
    """The scan's result for a text column, as a struct."""
    return F.pandas_udf(RESULT)(_scan)(text.cast("binary"))


def scan_licenses(df: DataFrame, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``df`` with the struct ``out``: ``n_words``; of the base phrases
    ``n_base`` (places), ``first_word``, ``last_word`` and ``base_labels``;
    ``labels`` of base phrases and surviving detections; ``score``, the
    highest confidence among these; and the ``detections`` themselves."""
    return df.withColumn(out, license_column(F.col(f"`{text_col}`")))
