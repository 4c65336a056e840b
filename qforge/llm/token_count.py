"""Token counts without token ids: pieces are counted once per distinct
pre-token, joined to per-document pre-token frequencies and summed.

A pre-token is a run of blanks with the letters and digits, or with the
other characters, that follow.  No piece of the model reaches over such a cut (checked against
every piece when the model is read; a model that fails raises), so the pieces
of a text are those of its pre-tokens.

Plan: one pass counts pre-tokens per task; their sums by key give the
distinct pre-tokens with their frequency, and each of those is counted once.
Pre-tokens that hold at least 1 / ``HOT`` of all occurrences are at most
``HOT`` by construction and, with ``HOT_LENGTH`` characters each at most, form
a broadcast of proven size; a second pass sums them in place.  All others
leave as (row, pre-token, frequency) and meet their counts in a shuffle join
on the pre-token, which cannot be skewed: no key is frequent.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); rows are told
apart by position, so repeated or null ids are kept; strings like ``<s>``
inside a text are ordinary text, as the library's default has it; empty input
gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from qforge.llm.common import Scratch

HOT = 1 << 20
HOT_LENGTH = 64
FLUSH = 1 << 19            # distinct pre-tokens held by a task before it hands them on


def word_class() -> str:
    """Letters, decimal digits, combining marks and all characters beyond the
    basic plane, as ranges of a character class."""
    spans, start = [], None
    for code in range(0x10001):
        kind = unicodedata.category(chr(code)) if code < 0x10000 else ""
        if kind[:1] in ("L", "M") or kind == "Nd":
            start = code if start is None else start
        elif start is not None:
            spans.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    return "".join(spans) + "\\U00010000-\\U0010ffff"


@functools.cache
def pre_token() -> re.Pattern:
    word = word_class()
    return re.compile(f" *[{word}]+| *[^ {word}]+| +")


BLANK = "▁"


class PieceCounter:
    """Counts the pieces of a pre-token with the model's own library."""

    def __init__(self, model: bytes):
        self.cut = pre_token()
        proto = model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are read")
        if proto.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are read")
        for piece in proto.pieces:
            if piece.type == model_pb2.ModelProto.SentencePiece.NORMAL:
                text = piece.piece.replace(BLANK, " ")
                if len(self.cut.findall(text)) != 1:
                    raise ValueError(f"the piece {piece.piece!r} reaches over a pre-token")
            elif piece.type == model_pb2.ModelProto.SentencePiece.USER_DEFINED:
                raise ValueError("models with user-defined pieces are not read")
        self.prefix = spec.add_dummy_prefix
        spec.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def pre_tokens(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(BLANK, " ")
        return self.cut.findall(" " + text if self.prefix else text)

    def count(self, pre_tokens: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(pre_tokens, num_threads=1)] if pre_tokens else []


_counters: dict[str, PieceCounter] = {}


def counter_of(model: bytes) -> PieceCounter:
    """One counter per model and Python worker."""
    key = hashlib.md5(model).hexdigest()
    if key not in _counters:
        _counters[key] = PieceCounter(model)
    return _counters[key]


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``df``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "tokens")
    with open(model_file, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    text = F.col(f"`{text_col}`")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter_of(model.value).pre_tokens
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": list(seen), "freq": list(seen.values())},
                                              pa.schema([("word", pa.string()), ("freq", pa.int64())]))
        for batch in batches:
            for text in batch.column("text"):
                seen.update(cut(text.as_py()))
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model.value)
        for batch in batches:
            n = counter.count(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["word", "freq", "pieces"])

    words = (rows.select("text").mapInArrow(tally, "word string, freq long")
             .groupBy("word").agg(F.sum("freq").alias("freq")))
    words = scratch.keep(words.mapInArrow(pieces, "word string, freq long, pieces long"), "words")
    total = words.agg(F.sum("freq")).first()[0] or 0
    often = (F.col("freq") * HOT >= total) & (F.length("word") <= HOT_LENGTH)
    hot = spark.sparkContext.broadcast({r.word: r.pieces for r in words.where(often).select("word", "pieces").toLocalIterator()})

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("word", pa.string()),
                        ("n", pa.int64())])

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = counter_of(model.value).pre_tokens, hot.value
        for batch in batches:
            got: list[list] = [[], [], [], [], []]

            def put(*values):
                for column, value in zip(got, values):
                    column.append(value)
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                here, n = Counter(cut(text)), 0
                for word, k in here.items():
                    one = known.get(word)
                    if one is None:
                        put(row, None, None, word, k)
                    else:
                        n += k * one
                put(row, doc_id, len(text.encode()) if text else 0, None, n)
                if len(got[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, schema.types)], schema=schema)
                    for column in got:
                        column.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, schema.types)], schema=schema)

    parts = rows.withColumn("doc_id", F.col("doc_id").cast("long")) \
        .mapInArrow(per_document, "row long, doc_id long, n_bytes long, word string, n long")
    parts = scratch.keep(parts, "parts")
    rare = parts.where("word is not null").select("row", "word", "n") \
        .join(words.where(~often).select("word", "pieces"), "word") \
        .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rare"))
    whole = parts.where("word is null").select("row", "doc_id", "n_bytes", "n")
    n_tokens = F.col("n") + F.coalesce("rare", F.lit(0))
    return (whole.join(rare, "row", "left")
            .select("doc_id", "n_bytes", n_tokens.cast("long").alias("n_tokens"), (n_tokens > limit).alias("over_limit")))
