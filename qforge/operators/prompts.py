"""Prompt / target builders (P1-P15), the unanswerable guard (F1, F2) and
the span check (X22).  All plain ``Project``/``Filter`` plans: no Python, no
shuffle; the ``size(answers.answer_start) > 0`` filter is pushed to the scan
side of every projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qforge import markers as M
from qforge.functions.text import highlight


def _answer():
    return F.get(F.col("answers.text"), 0)


def _start():
    return F.get(F.col("answers.answer_start"), 0)


def _answerable():
    return F.size(F.col("answers.answer_start")) > 0


def context_expr(ms: M.MarkerSet = M.T5, use_highlight: bool = True):
    """Highlighted (or plain) context; null when unanswerable (F1)."""
    ctx = highlight("context", _start(), _answer(), ms.hl) if use_highlight else F.col("context")
    return F.when(_answerable(), ctx)


def answer_aware_input(ms: M.MarkerSet = M.T5, use_highlight: bool = True):
    """``generate question: <answer> a <answer> <context> c <context>``."""
    return F.concat(F.lit(f"{M.T5_PREFIX}{ms.answer} "), _answer(),
                    F.lit(f" {ms.end_answer} {ms.context} "), context_expr(ms, use_highlight),
                    F.lit(f" {ms.end_context}"))


def zero_shot_input(ms: M.MarkerSet = M.T5, use_highlight: bool = True):
    """Context-only input, highlight retained."""
    return F.concat(F.lit(f"{M.T5_PREFIX}{ms.context} "), context_expr(ms, use_highlight),
                    F.lit(f" {ms.end_context}"))


def target_expr(ms: M.MarkerSet = M.T5, guard: bool = True):
    """P5: ``<question> q <question>`` (null when unanswerable)."""
    t = F.concat(F.lit(f"{ms.question} "), F.col("question"), F.lit(f" {ms.end_question}"))
    return F.when(_answerable(), t) if guard else t


def qa_prompts(qa: DataFrame, ms: M.MarkerSet = M.T5, use_highlight: bool = True,
               zero_shot: bool = False, lower: bool = False) -> DataFrame:
    """``id, title, inputs, target`` for answerable rows.

    The answerable filter is written first, so Catalyst pushes it below the
    projection (the reference filtered after mapping)."""
    inputs = zero_shot_input(ms, use_highlight) if zero_shot else answer_aware_input(ms, use_highlight)
    if lower:  # P13, described in the report only; off by default
        inputs = F.lower(inputs)
    return (qa.where(_answerable())
            .select("id", "title", inputs.alias("inputs"), target_expr(ms).alias("target"))
            .where(F.col("inputs").isNotNull()))


def rl_prompts(qa: DataFrame, ms: M.MarkerSet = M.T5, use_highlight: bool = True) -> DataFrame:
    """Context renamed ``query`` (the full input), plus ``target`` and a
    flat ``answer``."""
    return (qa.where(_answerable())
            .select("id", "title", "question",
                    answer_aware_input(ms, use_highlight).alias("query"),
                    target_expr(ms).alias("target"), _answer().alias("answer")))


def _causal_context(ms: M.MarkerSet):
    """Causal context: highlight with the (empty) marker, then the answer
    block ``### Answer: a <end>`` appended."""
    return F.concat(highlight("context", _start(), _answer(), ms.hl),
                    F.lit(f" {ms.answer} "), _answer(), F.lit(f" {ms.end_answer}"))


def causal_train_prompts(qa: DataFrame, ms: M.MarkerSet = M.CAUSAL_TRAIN) -> DataFrame:
    """``<s>[INST] <<SYS>> system <<SYS>> ctx [/INST] ### Question: q  </s>``."""
    text = F.concat(F.lit(f"<s>[INST] <<SYS>> {M.CAUSAL_SYSTEM} <<SYS>> "), _causal_context(ms),
                    F.lit(f" [/INST] {ms.question} "), F.col("question"),
                    F.lit(f" {ms.end_question} </s>"))
    return qa.where(_answerable()).select("id", "title", text.alias("text"))


def causal_eval_prompts(qa: DataFrame, ms: M.MarkerSet = M.CAUSAL_EVAL) -> DataFrame:
    """``<s> ctx ### Question:`` with the empty end-answer marker."""
    text = F.concat(F.lit("<s> "), _causal_context(ms), F.lit(f" {ms.question}"))
    return qa.where(_answerable()).select("id", "title", "question", text.alias("text"))


def plain_qa_prompts(df: DataFrame, question_col: str = "question", lower: bool = False,
                     preview_chars: int = 128, add_lower: bool = False) -> DataFrame:
    """P9 (+P13, X13): ``### Question: q ### Answer: `` and a preview;
    ``add_lower`` also emits the lower-cased prompt (P13) in the same
    projection."""
    def prompt(q):
        return F.concat(F.lit(M.QA_QUESTION), q, F.lit(M.QA_ANSWER))
    q = F.lower(F.col(question_col)) if lower else F.col(question_col)
    out = df.withColumn("prompt", prompt(q)) \
        .withColumn("preview", F.left(F.col(question_col), F.lit(preview_chars)))
    return out.withColumn("prompt_lower", prompt(F.lower(F.col(question_col)))) if add_lower else out


def report_prompts(qa: DataFrame, ms: M.MarkerSet = M.REPORT) -> DataFrame:
    """Report formula ``<ctx> c <ctx> <ans> a`` (context first)."""
    text = F.concat(F.lit(f"{ms.context} "), context_expr(ms), F.lit(f" {ms.end_context} {ms.answer} "),
                    _answer())
    return qa.where(_answerable()).select("id", text.alias("inputs"))


def instruction_prompts(qa: DataFrame, ms: M.MarkerSet = M.REPORT, with_question: bool = True) -> DataFrame:
    """P15, instruction form: system text, highlighted context, answer and, for
    training, the question to be learned; without ``with_question`` the prompt
    ends where the question is to be generated."""
    head = F.concat(F.lit(f"{M.REPORT_OPEN}{ms.context} "), context_expr(ms),
                    F.lit(f" {ms.end_context} {ms.answer} "), _answer(), F.lit(f" {ms.end_answer} {ms.question}"))
    text = F.concat(head, F.lit(" "), F.col("question"), F.lit(f" {ms.end_question}{M.REPORT_CLOSE}")) if with_question else head
    return qa.where(_answerable()).select("id", "title", text.alias("text"))


def span_check(qa: DataFrame) -> DataFrame:
    """Does the context slice equal the answer, and is the offset the
    first occurrence?  One row per answerable record."""
    s, a = _start(), _answer()
    sliced = F.substr(F.col("context"), s + 1, F.length(a))
    first_pos = F.instr(F.col("context"), a) - 1
    return (qa.where(_answerable())
            .select("id", s.cast("bigint").alias("answer_start"),
                    (sliced == a).alias("slice_ok"),
                    (first_pos == s).alias("first_occurrence"),
                    first_pos.cast("bigint").alias("first_pos")))
