"""Rule-based reward (G1-G5) as one column expression.

reward = sigmoid(F1 + answer-in-question term + question-word term +
length term); any input that makes the reference raise (no word in the
prediction or target, a null answer) gives 0.0.

FIXED VALUES
  code weights:  leaked -5.0 else +1.0; first words differ -0.5 else +0.5;
                 target longer than 20 words -0.5 else +0.5
  paper weights: leaked -1.0 else +1.0; same word term; longer than 32
                 words -0.5 else +0.5
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from qforge.functions.text import first_word, sigmoid, word_count, words


@dataclass(frozen=True)
class RewardConfig:
    leak_penalty: float = -5.0
    leak_bonus: float = 1.0
    word_penalty: float = -0.5
    word_bonus: float = 0.5
    length_penalty: float = -0.5
    length_bonus: float = 0.5
    max_words: int = 20
    length_on: str = "target"   # the code looks at the target, not the prediction


CODE = RewardConfig()
PAPER = RewardConfig(leak_penalty=-1.0, leak_bonus=1.0, max_words=32)


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def leaked(pred, answer) -> Column:
    """``answer.lower() in prediction.lower()``."""
    return F.contains(F.lower(_c(pred)), F.lower(_c(answer)))


def reward_terms(pred, target, answer, cfg: RewardConfig = CODE) -> dict:
    p, t, a = _c(pred), _c(target), _c(answer)
    leak = F.when(leaked(p, a), F.lit(cfg.leak_penalty)).otherwise(F.lit(cfg.leak_bonus))
    word = F.when(first_word(t) != first_word(p), F.lit(cfg.word_penalty)).otherwise(F.lit(cfg.word_bonus))
    len_src = t if cfg.length_on == "target" else p
    length = F.when(word_count(len_src) > cfg.max_words, F.lit(cfg.length_penalty)) \
        .otherwise(F.lit(cfg.length_bonus))
    valid = (a.isNotNull() & p.isNotNull() & t.isNotNull()
             & (F.size(words(p)) > 0) & (F.size(words(t)) > 0))
    return {"leak": leak, "word": word, "length": length, "valid": valid}


def reward(f1, pred, target, answer, cfg: RewardConfig = CODE) -> Column:
    """The reward as a column; 0.0 where the reference would raise."""
    terms = reward_terms(pred, target, answer, cfg)
    raw = _c(f1) + terms["leak"] + terms["word"] + terms["length"]
    return F.when(terms["valid"], sigmoid(raw)).otherwise(F.lit(0.0))
