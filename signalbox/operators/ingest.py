"""Question banks to one canonical schema, with quality checks and the combine step."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: category of a question whose bank names no source.
UNKNOWN_SOURCE = "Unknown"


def _canonical(
    df: DataFrame,
    question: Column,
    category: Column,
    answer: Column,
    choices: Column | None = None,
    choice_index: Column | None = None,
    explanation: Column | None = None,
) -> DataFrame:
    def or_null(column: Column | None, kind: str) -> Column:
        return (F.lit(None) if column is None else column).cast(kind)

    return df.select(
        question.alias("question"),
        category.alias("category"),
        or_null(choices, "array<string>").alias("choices"),
        or_null(choice_index, "int").alias("choice_index_correct"),
        or_null(explanation, "string").alias("explanation_correct"),
        answer.cast("string").alias("answer_correct"),
    )


def from_solution_bank(df: DataFrame) -> DataFrame:
    """Bank with ``problem, subject, solution, answer``."""
    return _canonical(
        df, F.col("problem"), F.col("subject"), F.col("answer"), explanation=F.col("solution")
    )


def from_year_part_bank(df: DataFrame, series: str = "AIME") -> DataFrame:
    """Bank with ``Year, Part, Question, Answer``; the part is optional."""
    part = F.when(F.col("Part").isNotNull(), F.concat(F.lit("Part_"), F.col("Part").cast("string")))
    category = F.concat_ws("_", F.lit(series), F.col("Year").cast("string"), part)
    return _canonical(df, F.col("Question"), category, F.col("Answer"))


def from_choice_bank(df: DataFrame) -> DataFrame:
    """Multiple-choice bank with ``question, category, options, answer_index`` (0-based)."""
    return _canonical(
        df,
        F.col("question"),
        F.col("category"),
        F.get(F.col("options"), F.col("answer_index").cast("int")),
        choices=F.col("options"),
        choice_index=F.col("answer_index"),
    )


def from_source_bank(df: DataFrame) -> DataFrame:
    """Bank with ``problem, source, answer``; any solve-rate column is ignored."""
    category = F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN_SOURCE))
    return _canonical(df, F.col("problem"), category, F.col("answer"))


def quality_check(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """One row ``(has_missing, has_empty)`` over all columns, computed in one pass."""
    skipped = set(ignore)
    fields = [f for f in df.schema.fields if f.name not in skipped]

    def missing(field: T.StructField) -> Column:
        test = F.col(field.name).isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            test = test | F.isnan(field.name)
        return test

    def any_row(tests: list[Column]) -> Column:
        if not tests:
            return F.lit(False)
        return F.coalesce(F.bool_or(reduce(lambda a, b: a | b, tests)), F.lit(False))

    empty = [
        F.coalesce(F.col(f.name) == "", F.lit(False))
        for f in fields
        if isinstance(f.dataType, T.StringType)
    ]
    return df.agg(
        any_row([missing(f) for f in fields]).alias("has_missing"),
        any_row(empty).alias("has_empty"),
    )


def require_clean(df: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    """Stop the ingest when the bank has missing or empty values."""
    found = quality_check(df, ignore).first()
    if found.has_missing or found.has_empty:
        raise ValueError(f"bank rejected: missing={found.has_missing}, empty={found.has_empty}")
    return df


def mcq_violations(questions: DataFrame) -> DataFrame:
    """Multiple-choice rows whose answer is not the choice its index names."""
    named = F.get(F.col("choices"), F.col("choice_index_correct"))
    return questions.filter(F.col("choices").isNotNull()).filter(
        ~F.col("answer_correct").eqNullSafe(named)
    )


def union_banks(banks: list[DataFrame]) -> DataFrame:
    """All banks in one frame, tagged with the bank's position; nothing is dropped."""
    tagged = [bank.withColumn("bank", F.lit(i)) for i, bank in enumerate(banks)]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def id_violations(combined: DataFrame) -> DataFrame:
    """Ids that are missing or occur more than once, with their count.

    Counting is combined on the map side, so a heavily repeated id costs one row per task.
    """
    return (
        combined.groupBy("unique_id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("unique_id").isNull() | (F.col("copies") > 1))
    )


def combine_banks(banks: list[DataFrame]) -> DataFrame:
    """Combined banks, refused when an id is missing or repeated within or across banks."""
    combined = union_banks(banks)
    bad = id_violations(combined).first()
    if bad is not None:
        if bad.unique_id is None:
            raise KeyError(f"{bad.copies} records are missing unique_id")
        raise ValueError(f"unique_id {bad.unique_id} occurs {bad.copies} times")
    return combined


def combine_check(combined: DataFrame) -> DataFrame:
    """One row: records, unique ids, and whether they agree."""
    per_id = combined.groupBy("unique_id").agg(F.count(F.lit(1)).alias("copies"))
    return per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("records"),
        F.count("unique_id").alias("unique_ids"),
    ).withColumn("consistent", F.col("records") == F.col("unique_ids"))
