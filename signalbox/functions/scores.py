"""Numeric helpers over logits, probabilities and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbox.functions.text import bind


def softmax(logits: Column) -> Column:
    def shifted(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp(x.cast("double") - top))

    def scaled(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(weights, lambda w: w / t))

    return bind(bind(F.array_max(logits).cast("double"), shifted), scaled)


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0.0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def at_least(score: Column, threshold: float | Column) -> Column:
    """``score >= threshold`` where null and NaN count as below, unlike Spark's NaN ordering."""
    return F.coalesce((score >= threshold) & ~F.isnan(score), F.lit(False))
