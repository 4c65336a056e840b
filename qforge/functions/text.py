"""Column -> Column text functions (all JVM-side built-ins, codegen-able
except where a higher-order function is needed).

Python's ``str.split()`` / ``str.strip()`` treat any Unicode whitespace as a
separator; Java's ``\\s`` is ASCII unless ``(?U)`` is set, so every pattern
here that stands in for a Python whitespace rule carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "(?U)\\s"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- X5 / P1
def highlight(context, start, answer, hl: str = "<hl>") -> Column:
    """``ctx[:s] + " hl " + ctx[s:s+len(a)] + " hl " + ctx[s+len(a):]``.

    The highlighted span is cut from the *context*; ``start`` is a 0-based
    code-point offset, as in Python slicing.  Null start gives null."""
    ctx, s, a = _c(context), _c(start), _c(answer)
    n = F.length(a)
    mark = F.lit(f" {hl} ")
    return F.concat(
        F.substr(ctx, F.lit(1), s),
        mark,
        F.substr(ctx, s + 1, n),
        mark,
        F.substr(ctx, s + n + 1, F.greatest(F.length(ctx), F.lit(1))),
    )


def first(arr) -> Column:
    """Null-safe first array element (``arr[0]`` raises under ANSI)."""
    return F.get(_c(arr), 0)


# ---------------------------------------------------------------- cleanup
# FIXED VALUES, in the order they are removed
#   evaluator:  question>  <question>  <hl>
#   reward:     <pad>  <unk>  </s>  question>  <question>  <
EVAL_TOKENS = ("question>", "<question>", "<hl>")
REWARD_TOKENS = ("<pad>", "<unk>", "</s>", "question>", "<question>", "<")


def clean_eval(pred) -> Column:
    """Evaluator cleanup, order-sensitive: ``question>``, then
    ``<question>``, then ``<hl>`` are removed."""
    p = _c(pred)
    for tok in EVAL_TOKENS:
        p = F.replace(p, F.lit(tok), F.lit(""))
    return p


def clean_target(target) -> Column:
    """Drop ``<question>``; outer spaces kept."""
    return F.replace(_c(target), F.lit("<question>"), F.lit(""))


def py_strip(x) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def clean_reward(pred) -> Column:
    """Reward cleanup: drop ``<pad>``, ``<unk>``, ``</s>``,
    ``question>``, ``<question>``, ``<`` in that order, then strip."""
    p = _c(pred)
    for tok in REWARD_TOKENS:
        p = F.replace(p, F.lit(tok), F.lit(""))
    return py_strip(p)


def strict_clean(pred) -> Column:
    """Order-independent cleanup: removes every marker form."""
    p = F.regexp_replace(_c(pred), "</?question>|<hl>|<pad>|<unk>|</s>", "")
    return py_strip(p)


def extract_completion(pred, marker: str = "### Question:") -> Column:
    """Text after the first marker up to the next one, cut at the
    first ``?``, with ``?`` appended.  Missing marker gives null."""
    after = F.get(F.split(_c(pred), _quote(marker)), 1)
    return F.concat(F.substring_index(after, "?", 1), F.lit("?"))


def extract_answer(pred, marker: str = "### Answer:") -> Column:
    """Text after the first answer marker; list-repr escapes undone:
    literal ``\\n`` and ``\\t`` become a space, ``\\"`` is removed."""
    after = F.get(F.split(_c(pred), _quote(marker)), 1)
    after = F.replace(after, F.lit("\\n"), F.lit(" "))
    after = F.replace(after, F.lit("\\t"), F.lit(" "))
    return F.replace(after, F.lit('\\"'), F.lit(""))


def _quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in ".^$*+?()[]{}|\\#" else ch)
    return "".join(out)


# ---------------------------------------------------------------- words
def words(x) -> Column:
    """Python ``str.split()`` as an array (empty for blank text)."""
    s = py_strip(_c(x))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, f"{WS}+"))


def word_count(x) -> Column:
    return F.size(words(x))


def first_word(x) -> Column:
    """X11: ``x.split()[0].lower()``; null when there is no word."""
    return F.lower(F.get(words(x), 0))


def preview(x, n: int = 128) -> Column:
    """``q[:n]``."""
    return F.left(_c(x), F.lit(n))


def metric_tokens(x) -> Column:
    """ROUGE tokenisation: lower-case, runs of ``[a-z0-9]``."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(x) -> Column:
    """Word-level tokens for vocabulary building: runs of non-space."""
    return F.regexp_extract_all(_c(x), F.lit("\\S+"), F.lit(0))


def sigmoid(x) -> Column:
    """X15."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


# ---------------------------------------------------------------- html bits
def code_language(cls) -> Column:
    """First class token, last ``-`` segment (``lang-py`` -> ``py``); null
    where there is no token.  Tokens are parted by HTML white space (fixed rule)."""
    first_cls = F.get(F.regexp_extract_all(_c(cls), F.lit(r"[^ \t\n\f\r]+"), F.lit(0)), 0)
    return F.when(F.coalesce(first_cls, F.lit("")) == "", F.lit(None).cast("string")) \
        .otherwise(F.element_at(F.split(first_cls, "-"), -1))


def class_attributes(html) -> Column:
    """Values of the ``class`` attributes of an HTML text, in order of appearance."""
    return F.regexp_extract_all(_c(html), F.lit("<[A-Za-z][^<>]*?\\sclass=\"([^\"<>]*)\""), F.lit(1))


def collapse_blank_lines(x) -> Column:
    """``re.sub(r"\\n\\s*\\n", "\\n\\n", x).strip()``."""
    return py_strip(F.regexp_replace(_c(x), f"\\n{WS}*\\n", "\n\n"))


def make_valid(x) -> Column:
    """Replace invalid UTF-8 sequences (``encode('utf-8','replace')``)."""
    return F.make_valid_utf8(_c(x))


# ---------------------------------------------------------------- checks
def seeded_key(seed, *cols) -> Column:
    """md5 of ``seed:col1:col2..``: a partition-independent random key."""
    parts = [F.lit(str(seed))] + [_c(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def seeded_bucket(seed, col, k: int) -> Column:
    """First 7 hex digits of the seeded md5 as an integer, modulo k."""
    return F.pmod(F.conv(F.substr(seeded_key(seed, col), F.lit(1), F.lit(7)), 16, 10)
                  .cast("bigint"), F.lit(k))
