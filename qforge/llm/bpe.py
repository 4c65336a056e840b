"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A pre-token is encoded in time linear in its length: an Aho-Corasick
automaton over the reversed tokens gives the longest token that starts at
each place; tokens are taken left to right, and a token is accepted only if
merging would keep the boundary between it and the token before (the
pair-compatibility table, filled on demand); otherwise the next shorter token
that is a prefix of it is tried, and without one the place is marked dead and
the token before is taken back.  This gives the merges of byte-pair encoding
exactly.

``Vocabulary`` reads a ``tokenizers`` JSON file of the kind word_bpe (BPE with
a word-end suffix after NFC, white space and lower-case normalisation);
another kind raises.  What is a letter, its lower case and its composed form
follow Python's Unicode tables; a word with a character that these do not know,
or with several marks in a row, is normalised and cut by the ``tokenizers``
library's own tables, so both agree whichever is newer.  The file's bytes travel in one broadcast, whose size is
that of the file.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

#: Words and pre-tokens kept per Python worker; a table is emptied when it is full.
CACHE_WORDS = 250_000
CACHE_PIECES = 250_000
#: Longer ones are encoded each time and not kept.
CACHE_LENGTH = 64
#: Judged token pairs kept per worker; emptied when full.
CACHE_PAIRS = 500_000
#: Characters of an Arrow batch that are encoded and handed on together, and rows at most.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 512

# FIXED VALUES: white space as the file's normaliser understands it, and the
# byte-level alphabet's rule (printable Latin-1 bytes stand for themselves,
# the others follow from U+0100 on).
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def characters(*categories: str) -> str:
    """Ranges of the characters of these Unicode categories, for a character class."""
    category, ranges, first = unicodedata.category, [], -1
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and category(chr(i)) in categories
        if inside and first < 0:
            first = i
        elif not inside and first >= 0:
            ranges.append(f"\\U{first:08x}-\\U{i - 1:08x}")
            first = -1
    return "".join(ranges)


class Vocabulary:
    """Tokens, merges, the automaton and the decoding table of one file."""

    SHIFT = 0x1000      # a character with the word-end suffix, as one character

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or spec.get("decoder"):
            raise ValueError("only BPE files with the word-end suffix </w> and no decoder are read")
        self.suffix = model["end_of_word_suffix"]
        self.bytes = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        if pattern != PIECES:
            raise ValueError("only files with the known pre-token pattern are read")
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        # not assigned as far as Python knows, or marks in a row, whose order depends on the tables
        self.latin = re.compile("[\\x00-\u02ff]*")         # settled, and no marks
        self.unsure = re.compile(f"[{characters('Cn')}]|[{characters('Mn', 'Mc', 'Me')}]{{2}}")
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cutter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        ids = model["vocab"]
        text = {i: t for t, i in ids.items()}
        self.form = {i: self._inner(t) for i, t in text.items()}
        self.length = {i: len(f) for i, f in self.form.items()}
        by_form = {f: i for i, f in self.form.items()}
        # ids of merged tokens rise with their rank, which the compatibility test relies on
        self.pair: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        last = -1
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = ids[left + right]
            if whole <= last:
                raise ValueError("merge ranks and ids differ in order")
            last = whole
            self.pair[ids[left], ids[right]] = whole
            self.split[whole] = (ids[left], ids[right])
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        automaton = ahocorasick.Automaton()
        for i, f in self.form.items():
            automaton.add_word(f[::-1], i)
            self.shorter[i] = next((by_form[f[:k]] for k in range(len(f) - 1, 0, -1) if f[:k] in by_form), None)
        automaton.make_automaton()
        self.automaton = automaton
        # offset table: the decoded form of token i is blob[start[i]:start[i + 1]]
        for content, i in self.special.items():
            text[i] = content
        parts = [text.get(i, "").encode() + b" " for i in range(max(text) + 1)]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
        self.blob = b"".join(parts)

    @classmethod
    def from_json(cls, data: bytes) -> Vocabulary:
        return cls(json.loads(data))

    def _inner(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + self.SHIFT)
        return token

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging keeps a boundary between the tokens left and right.

        Undo merges on both sides of the boundary, latest first; a pair seen
        across it that merges earlier than the last undone merge would have
        been merged instead."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit, good = len(self.start), True
        while True:
            if self.pair.get((left, right), limit) < limit:
                good = False
                break
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                break
            # of two equal merges the left one is done first, so the right one is undone first
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]
        if len(self.compatible) >= CACHE_PAIRS:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token (normalised text)."""
        raw = [self.bytes[b] for b in piece.encode()]
        raw[-1] = chr(ord(raw[-1]) + self.SHIFT)
        n = len(raw)
        longest: list[int] = [-1] * n
        for end, token in self.automaton.iter("".join(reversed(raw))):
            at = n - 1 - end
            if longest[at] < 0 or self.length[token] > self.length[longest[at]]:
                longest[at] = token
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + self.length[token]
            if not dead[end] and (not out or self._fits(out[-1], token)):
                out.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
                continue
            shorter = self.shorter[token]
            if shorter is not None:
                token = shorter
                continue
            dead[pos] = 1
            token = out.pop()
            pos -= self.length[token]
        return out

    def split_text(self, text: str) -> Iterator[tuple[str, int]]:
        """(segment, -1) of ordinary text and (content, id) of added tokens."""
        at = 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                yield text[at:m.start()], -1
            yield m.group(), self.special[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], -1

    def pre_tokens(self, text: str) -> list[str]:
        if not self.latin.fullmatch(text) and self.unsure.search(text):
            return [piece for piece, _ in self.cutter.pre_tokenize_str(self.normal.normalize_str(text))]
        # lower-casing is by character: a final capital sigma isn't special
        return self.pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, token in self.split_text(text):
            if token >= 0:
                out.append(token)
            else:
                for piece in self.pre_tokens(part):
                    out += self.encode_piece(piece)
        return out

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """Token strings joined by blanks, special ones included."""
        blob, start = self.blob, self.start
        return b"".join([blob[start[i]:start[i + 1]] for i in ids])[:-1]


class Codec:
    """A vocabulary with the tables of words and pre-tokens seen by this worker.

    No pre-token and no composition of characters reaches over white space, so
    a word between white space is normalised and cut once, when first seen.
    The tables hold ids as decimals joined by a blank and nothing else: a worker
    shares its executor's memory.  The decoded text is looked up by them."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.pieces = Table(self._piece, CACHE_PIECES)
        self.words = Table(self._word, CACHE_WORDS)
        self.word = re.compile(f"[^{SPACE}]+")
        self.decimal = [str(i).encode() for i in range(len(vocab.start) - 1)]
        self.token = {d: vocab.decode_bytes([i]) for i, d in enumerate(self.decimal)}

    def _piece(self, piece: str) -> bytes:
        return b" ".join([self.decimal[i] for i in self.vocab.encode_piece(piece)])

    def _word(self, word: str) -> bytes:
        return joined([self.pieces[p] for p in self.vocab.pre_tokens(word)])

    def run(self, text: str) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as decimals joined by a blank, the decoded text."""
        forms: list[bytes] = []
        for part, token in self.vocab.split_text(text):
            forms += [self.decimal[token]] if token >= 0 else map(self.words.__getitem__, self.word.findall(part))
        ids = joined(forms)
        each = ids.split()
        return len(each), ids, b" ".join(map(self.token.__getitem__, each))


def joined(forms: list[bytes]) -> bytes:
    return forms[0] if len(forms) == 1 else b" ".join(filter(None, forms))


class Table(dict):
    """Computed values by key, bounded to ``most`` entries of CACHE_LENGTH characters."""

    def __init__(self, compute, most: int):
        self.compute, self.most = compute, most

    def __missing__(self, key: str):
        value = self.compute(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


_codecs: dict[str, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One codec per vocabulary file and Python worker, kept between tasks."""
    key = hashlib.md5(data).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(Vocabulary.from_json(data))
    return _codecs[key]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows of about SLICE_BYTES of text, so that a worker
    holds the forms of few texts besides the batch itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and (held + size > SLICE_BYTES or i - first >= SLICE_ROWS):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def encoded(codec: Codec, batch: pa.RecordBatch, mine: list[str]) -> pa.RecordBatch:
    """``batch`` with the columns ``mine``."""
    got: dict[str, list] = {m: [] for m in mine}
    for text in batch.column("text"):
        n, ids, words = codec.run(text.as_py() or "")
        got["n_tokens"].append(n)
        if "ids" in got:
            got["ids"].append(ids.decode())
        if "decoded" in got:
            got["decoded"].append(words.decode())
        got["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
        got["decoded_sha256"].append(hashlib.sha256(words).hexdigest())
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *(pa.array(v, pa.int64() if m == "n_tokens" else pa.string()) for m, v in got.items())],
        names=[*batch.schema.names, *mine])


def encode_decode(df: DataFrame, vocabulary_file: str, text_col: str = "text", outputs=("ids", "decoded")) -> DataFrame:
    """``df`` plus ``n_tokens``, ``ids`` (decimals joined by a blank),
    ``decoded`` and their SHA-256; ``outputs`` names which of ids and decoded
    are carried, so that a caller who needs only the digests moves none.

    One pass over the rows, no shuffle.  A null text counts as empty; an empty
    text has no ids and decodes to nothing; repeated rows are all kept; empty
    input gives no rows; earlier columns of these names are replaced."""
    with open(vocabulary_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    mine = ["n_tokens", *outputs, "ids_sha256", "decoded_sha256"]
    rest = [c for c in df.columns if c.lower() not in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256") or c == text_col]
    frame = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest) if c != text_col],
                      F.col(f"`{text_col}`").alias("text"))
    fields = frame.drop("text").schema.fields
    kinds = {"n_tokens": "long"}
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "text string",
                     *(f"{m} {kinds.get(m, 'string')}" for m in mine)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for batch in batches:
            for part in slices(batch):
                yield encoded(codec, part, mine)

    done = frame.mapInArrow(work, out)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(rest) if c != text_col]
    return done.select(*back, *([F.col("text").alias(text_col)] if text_col not in mine else []), *mine)
