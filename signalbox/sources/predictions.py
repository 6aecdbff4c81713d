"""Stored router predictions, whose columns differ by producer, in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which producers store the row id and the two probabilities.
ID_NAMES = ("id", "problem_idx")
THINK_NAMES = ("think_probability", "think_score")
NO_THINK_NAMES = ("no_think_probability", "no_think_score")


def _first_present(df: DataFrame, names: tuple[str, ...], kind: str) -> Column:
    present = [F.col(n).cast(kind) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast(kind)


def unify_predictions(df: DataFrame) -> DataFrame:
    """Common columns: ``row_id, problem, answer, problem_type, think_/no_think_probability``."""
    kinds = F.col("problem_type") if "problem_type" in df.columns else F.lit(None)
    return df.select(
        _first_present(df, ID_NAMES, "string").alias("row_id"),
        F.col("problem").cast("string").alias("problem"),
        F.col("answer").cast("string").alias("answer"),
        kinds.cast("array<string>").alias("problem_type"),
        _first_present(df, THINK_NAMES, "double").alias("think_probability"),
        _first_present(df, NO_THINK_NAMES, "double").alias("no_think_probability"),
    )


def union_predictions(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [unify_predictions(f) for f in frames])
