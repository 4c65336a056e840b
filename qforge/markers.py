"""Marker sets used by the prompt templates.

FIXED VALUES (must equal the reference for byte-identical prompts):
  T5 markers:        question "<question>", end "<question>",
                     context "<context>", end "<context>",
                     answer "<answer>", end "<answer>", highlight "<hl>"
  T5 task prefix:    "generate question: "
  closed-tag set:    question "<question>", end "</question>",
                     context "<context>", end "</context>",
                     answer "<answer>", end "</answer>", highlight "<hl>"
  causal (train):    question "### Question:", end "", context "### Context:",
                     end "", answer "### Answer:", end "### Answer:", highlight ""
  causal (eval):     same as train but answer end ""
  report markers:    context "<ctx>", answer "<ans>", highlight "<hl>"
  causal system text (train prompt), verbatim:
    You are a question generation system. Generate questions for the given
    answer <answer>, matching the context. Each question starts after
    <question> and starts with a question word like "who, what, where, when"
  plain QA prompt:   "### Question: " + q + " ### Answer: "
  report instruction prompt (report markers, system text as above):
    "<s>\n[INST] \n" + system + ". [\\INST]" + "<ctx> c <ctx> <ans> a <ans> <question> q <question> \n<\\s>"
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MarkerSet:
    question: str
    end_question: str
    context: str
    end_context: str
    answer: str
    end_answer: str
    hl: str


T5 = MarkerSet("<question>", "<question>", "<context>", "<context>",
               "<answer>", "<answer>", "<hl>")
CLOSED = MarkerSet("<question>", "</question>", "<context>", "</context>",
                   "<answer>", "</answer>", "<hl>")
CAUSAL_TRAIN = MarkerSet("### Question:", "", "### Context:", "",
                         "### Answer:", "### Answer:", "")
CAUSAL_EVAL = MarkerSet("### Question:", "", "### Context:", "",
                        "### Answer:", "", "")
REPORT = MarkerSet("<question>", "<question>", "<ctx>", "<ctx>",
                   "<ans>", "<ans>", "<hl>")

T5_PREFIX = "generate question: "
CAUSAL_SYSTEM = ('You are a question generation system. Generate questions for the '
                 'given answer <answer>, matching the context. Each question starts '
                 'after <question> and starts with a question word like '
                 '"who, what, where, when"')
REPORT_OPEN = f"<s>\n[INST] \n{CAUSAL_SYSTEM}. [\\INST]"
REPORT_CLOSE = " \n<\\s>"
QA_QUESTION = "### Question: "
QA_ANSWER = " ### Answer: "
