"""Metrics, rewards and decoding scores as column expressions. What an empty set means differs by metric and is stated each time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import or_empty

_STR = "array<string>"


def ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def hit(pred: Column, gold: Column) -> Column:
    """Whether any prediction is gold."""
    return F.coalesce(F.arrays_overlap(or_empty(pred, _STR), or_empty(gold, _STR)), F.lit(False)).cast("double")


def hits_at_1(pred: Column, gold: Column) -> Column:
    """Whether the first prediction is gold; 0 without predictions."""
    return F.coalesce(F.array_contains(or_empty(gold, _STR), F.get(or_empty(pred, _STR), F.lit(0))), F.lit(False)).cast("double")


def _common(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    p, g = F.array_distinct(or_empty(pred, _STR)), F.array_distinct(or_empty(gold, _STR))
    return F.size(F.array_intersect(p, g)), F.size(p), F.size(g)


def answer_precision(pred: Column, gold: Column) -> Column:
    """Share of distinct answers that are gold; 0 without answers."""
    c, p, _ = _common(pred, gold)
    return ratio(c, p, 0.0)


def answer_recall(pred: Column, gold: Column) -> Column:
    """Share of distinct golds that were answered; 0 without golds."""
    c, _, g = _common(pred, gold)
    return ratio(c, g, 0.0)


def answer_f1(pred: Column, gold: Column, n_gold: Column | None = None) -> Column:
    """Harmonic mean of both; without golds 1 if there are no answers, else 0. ``n_gold``: how many golds there are, where ``gold`` has only those among the answers."""
    c, p, g = _common(pred, gold)
    g = g if n_gold is None else n_gold
    return F.when(g == 0, (p == 0).cast("double")).otherwise(harmonic(ratio(c, p, 0.0), ratio(c, g, 0.0)))


def chunk_f1(gold: Column, pred: Column) -> Column:
    """F1 of two claim arrays as sets: 1 if both are empty, 0 if one is or nothing is shared."""
    g, p = F.array_distinct(or_empty(gold)), F.array_distinct(or_empty(pred))
    tp = F.size(F.array_intersect(p, g))
    both = F.size(p) + F.size(g)
    return F.when(both == 0, 1.0).otherwise(2.0 * tp / F.greatest(both, F.lit(1)))


def quality(p: Column, r: Column, mode: str = "f1", w_p: float = 0.5, w_r: float = 0.5) -> Column:
    """F1, or a weighted sum of precision and recall."""
    if mode == "f1":
        return harmonic(p, r)
    if mode == "weighted_pr":
        return w_p * p + w_r * r
    raise ValueError(f"unknown quality mode {mode!r}")


def normalized_cost(cost: Column, cap: float) -> Column:
    """Cost as a share of the cap, clamped to 0..1."""
    if cap <= 0:
        raise ValueError("the cap must be positive")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cost / cap))


def reward(pred: Column, gold: Column, cost: Column, lam: float = 0.1, cap: float = 20.0, correct: str = "f1", mode: str = "cost", oracle: Column | None = None, n_gold: Column | None = None) -> Column:
    """Correctness less ``lam`` times the normalised cost; mode ``regret`` counts only the cost beyond the oracle's. ``n_gold`` as in ``answer_f1``."""
    if lam < 0:
        raise ValueError("lam must not be negative")
    if correct not in ("f1", "hit"):
        raise ValueError(f"unknown correctness {correct!r}")
    if mode not in ("cost", "regret"):
        raise ValueError(f"unknown reward mode {mode!r}")
    if mode == "regret":
        if oracle is None:
            raise ValueError("regret needs the oracle's cost")
        cost = F.greatest(F.lit(0.0), cost - oracle)
    return (answer_f1(pred, gold, n_gold) if correct == "f1" else hit(pred, gold)) - lam * normalized_cost(cost, cap)


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array; null for an empty one."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def log_softmax(values: Column) -> Column:
    whole = log_sum_exp(values)
    return F.transform(values, lambda x: x - whole)


def decode_confidence(logprob: Column, n_choices: Column) -> Column:
    """exp(mean log-probability of a choice); 1 without choices."""
    return F.when(n_choices > 0, F.exp(logprob / n_choices)).otherwise(F.lit(1.0))


def agreement(total: Column, length: Column) -> Column:
    """exp(mean log of the mass the grammar kept); null if not measured, 1 for nothing emitted."""
    return F.when(total.isNull(), None).when(length > 0, F.exp(total / length)).otherwise(F.lit(1.0))


def min_agreement(least: Column) -> Column:
    return F.exp(least)


def clipped_surrogate(ratio_: Column, advantage: Column, low: float = 0.2, high: float = 0.28) -> Column:
    """min(ratio * advantage, clip(ratio, 1-low, 1+high) * advantage)."""
    return F.least(ratio_ * advantage, F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio_)) * advantage)
