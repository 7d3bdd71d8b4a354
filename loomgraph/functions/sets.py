"""Arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CLAIM
from .text import core_name


def or_empty(c: Column, kind: str = f"array<{CLAIM}>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def effective_pred(pred: Column, uncertain: Column) -> Column:
    """Distinct predictions that are not uncertain."""
    return F.array_except(or_empty(pred), or_empty(uncertain))


def counts(pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """True positives, false positives, false negatives of two arrays as sets."""
    return F.size(F.array_intersect(pred, gold)).cast("long"), F.size(F.array_except(pred, gold)).cast("long"), F.size(F.array_except(gold, pred)).cast("long")


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def by_core_name(claims: Column) -> Column:
    """Claims with their targets' core names."""
    return F.transform(or_empty(claims), lambda x: F.struct(x["rel"].alias("rel"), core_name(x["target"]).alias("target")))


def first_occurrences(c: Column) -> Column:
    """Distinct elements in the order of their first appearance."""
    return F.array_distinct(c)
