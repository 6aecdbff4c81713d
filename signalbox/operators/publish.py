"""Publishing layout: one wide row per question, padded to a shared schema, with statistics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.arrays import correct_count, graded_count, response_fields
from signalbox.functions.scores import ratio
from signalbox.operators.grading import LLM_JUDGE, METHODS
from signalbox.operators.metrics import UNKNOWN_METHOD

# File stem to published split name.
SPLIT_NAMES = {"train": "train", "val": "validation", "validation": "validation", "test": "test"}
EXPLANATION_PREVIEW = 200


def max_responses(*splits: DataFrame) -> int:
    """Largest number of responses over all splits; needed to fix the column list."""
    largest = [s.agg(F.max(graded_count()).alias("m")).first().m or 0 for s in splits]
    return max(largest, default=0)


def _responses() -> Column:
    return F.col("responses")


def _verdicts() -> Column:
    return response_fields("is_correct", "extraction_method")


def _correct(response: Column) -> Column:
    return F.coalesce(response["is_correct"], F.lit(False))


def _method(response: Column) -> Column:
    return F.coalesce(response["extraction_method"], F.lit(UNKNOWN_METHOD))


def _with_method(method: str) -> Column:
    return F.filter(_verdicts(), lambda r: r["extraction_method"] == method)


def method_counts_map() -> Column:
    """Map from method to its count within one question, counted inside the array."""
    methods = F.transform(
        F.col("responses.extraction_method"), lambda name: F.coalesce(name, F.lit(UNKNOWN_METHOD))
    )
    used = F.array_distinct(methods)

    def entry(name: Column) -> Column:
        hits = F.filter(methods, lambda method: method == name)
        return F.struct(name, F.size(hits).cast("long"))

    return F.map_from_entries(F.transform(used, entry))


def _question_columns() -> list[Column]:
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    return [
        text("unique_id"),
        text("problem"),
        F.coalesce(F.col("is_mcq"), F.lit(False)).alias("is_mcq"),
        F.col("choices"),
        F.col("choice_index_correct"),
        text("explanation_correct"),
        text("answer_correct"),
        text("category"),
    ]


def _slot_columns(slot: int) -> list[Column]:
    """Five columns of one response slot; slots past the end hold neutral values."""
    response = F.get(_responses(), F.lit(slot))
    present = F.size(_responses()) > slot
    empty = F.lit("")
    n = slot + 1
    return [
        F.coalesce(response["full_response"], empty).alias(f"response_{n}"),
        F.coalesce(response["extracted_answer"], empty).alias(f"extracted_answer_{n}"),
        F.coalesce(response["is_correct"], F.lit(False)).alias(f"is_correct_{n}"),
        F.when(present, _method(response)).otherwise(empty).alias(f"extraction_method_{n}"),
        F.coalesce(response["judge_explanation"], empty).alias(f"judge_explanation_{n}"),
    ]


def statistics_columns() -> list[Column]:
    """Totals and per-method counts and accuracies of one question."""
    total = graded_count().cast("long")
    correct = correct_count().cast("long")
    columns = [
        total.alias("total_responses"),
        correct.alias("correct_responses"),
        ratio(correct, total).alias("accuracy"),
    ]
    for method in METHODS:
        used = _with_method(method)
        right = F.size(F.filter(used, _correct))
        count = F.size(used).cast("long")
        columns += [count.alias(f"{method}_count"), ratio(right, count).alias(f"{method}_accuracy")]
    return columns


def publish_wide(graded: DataFrame, slots: int | None = None, extra: list[str] | None = None) -> DataFrame:
    """Wide rows for publishing: a narrow transformation of nested rows, no shuffle."""
    count = max_responses(graded) if slots is None else slots
    wide = [column for slot in range(count) for column in _slot_columns(slot)]
    stats = statistics_columns()
    return graded.select(
        *(extra or []),
        *_question_columns(),
        *wide,
        *stats[:3],
        method_counts_map().alias("extraction_method_counts"),
        *stats[3:],
    )


def question_statistics(graded: DataFrame) -> DataFrame:
    """The statistics alone, without any response text."""
    return graded.select("unique_id", *statistics_columns())


def publish_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """All present splits in one frame with one schema and a ``split`` column.

    A missing split is simply absent; no split at all is an error.
    """
    unknown = set(splits) - set(SPLIT_NAMES)
    if unknown:
        raise ValueError(f"unknown split names: {sorted(unknown)}")
    if not splits:
        raise ValueError("no split to publish")
    slots = max_responses(*splits.values())
    parts = [
        publish_wide(frame.withColumn("split", F.lit(SPLIT_NAMES[name])), slots, ["split"])
        for name, frame in splits.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def method_counts(graded: DataFrame) -> DataFrame:
    """The per-question method map as rows ``(unique_id, extraction_method, n)``."""
    return graded.select("unique_id", F.explode(method_counts_map()).alias("extraction_method", "n"))


def perfect_questions(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("accuracy") == 1.0)


def failed_questions(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("accuracy") == 0.0)


def average_accuracy(stats: DataFrame) -> DataFrame:
    return stats.agg(F.avg("accuracy").alias("average_accuracy"))


def method_weighted_accuracy(stats: DataFrame) -> DataFrame:
    """Uses of each method and its accuracy weighted by them, from per-question statistics."""
    sums = [
        column
        for method in METHODS
        for column in (
            F.coalesce(F.sum(f"{method}_count"), F.lit(0)).alias(f"{method}_n"),
            F.sum(F.col(f"{method}_accuracy") * F.col(f"{method}_count")).alias(f"{method}_s"),
        )
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(method).alias("extraction_method"),
                F.col(f"{method}_n").alias("total_responses"),
                ratio(F.col(f"{method}_s"), F.col(f"{method}_n")).alias("accuracy"),
            )
            for method in METHODS
        ]
    )
    return stats.agg(*sums).select(F.inline(rows))


def judge_used(graded: DataFrame, preview: int = EXPLANATION_PREVIEW) -> DataFrame:
    """Every judged response with the head of the judge's explanation."""
    fields = response_fields("extraction_method", "judge_explanation")
    rows = graded.select("unique_id", F.posexplode(fields).alias("pos", "r"))
    return rows.filter(F.col("r.extraction_method") == LLM_JUDGE).select(
        "unique_id",
        (F.col("pos") + 1).alias("response_number"),
        F.left(F.coalesce(F.col("r.judge_explanation"), F.lit("")), F.lit(preview)).alias("explanation"),
    )
