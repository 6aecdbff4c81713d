"""Accuracy by any grouping; all aggregates combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.arrays import correct_count, graded_count
from signalbox.functions.scores import ratio

# Fixed value: method of a response that names none.
UNKNOWN_METHOD = "unknown"


def _total() -> Column:
    return F.count("response_idx")


def _correct() -> Column:
    return F.count_if(F.col("is_correct") & F.col("response_idx").isNotNull())


def _with_accuracy(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", ratio(F.col("correct_responses"), F.col("total_responses")))


def overall_accuracy(graded: DataFrame) -> DataFrame:
    """One row: correct, total, accuracy; 0 for an empty input."""
    return _with_accuracy(graded.agg(_correct().alias("correct_responses"), _total().alias("total_responses")))


def accuracy_by_category(graded: DataFrame) -> DataFrame:
    """Per category, best first. ``graded`` is exploded with ``outer`` rows kept.

    A question is counted at its first response, or at its null row when it has none, so no
    distinct count (and no shuffle of ids) is needed.
    """
    opens = F.col("response_idx").isNull() | (F.col("response_idx") == 0)
    per = graded.groupBy("category").agg(
        F.count_if(opens).alias("total_questions"),
        _total().alias("total_responses"),
        _correct().alias("correct_responses"),
    )
    return _with_accuracy(per).orderBy(F.desc("accuracy"), "category")


def accuracy_by_method(graded: DataFrame) -> DataFrame:
    """Per extraction method, most used first."""
    method = F.coalesce("extraction_method", F.lit(UNKNOWN_METHOD))
    per = (
        graded.filter(F.col("response_idx").isNotNull())
        .groupBy(method.alias("extraction_method"))
        .agg(_total().alias("total_responses"), _correct().alias("correct_responses"))
    )
    return _with_accuracy(per).orderBy(F.desc("total_responses"), "extraction_method")


def accuracy_by_model(graded: DataFrame) -> DataFrame:
    per = graded.groupBy("model").agg(_correct().alias("correct_responses"), _total().alias("total_responses"))
    return _with_accuracy(per)


def accuracy_grouping_sets(graded: DataFrame) -> DataFrame:
    """Per model, per model and category, per model and method, from one scan.

    Rows are first reduced to their finest groups, so the expansion into three grouping sets
    touches a handful of rows instead of every response.
    """
    finest = graded.groupBy("model", "category", "extraction_method").agg(
        _correct().alias("c"), _total().alias("t")
    )
    m, c, x = F.col("model"), F.col("category"), F.col("extraction_method")
    rolled = finest.groupingSets([[m], [m, c], [m, x]], m, c, x).agg(
        F.grouping_id().alias("_level"),
        F.sum("c").alias("correct_responses"),
        F.sum("t").alias("total_responses"),
    )
    level = (
        F.when(F.col("_level") == 1, F.lit("category"))
        .when(F.col("_level") == 2, F.lit("method"))
        .otherwise(F.lit("model"))
    )
    return _with_accuracy(rolled.withColumn("level", level).drop("_level"))


def question_accuracy(results: DataFrame, mode: str) -> DataFrame:
    """Per question ``{mode}_correct_count``, ``_total_count``, ``_accuracy``; responses dropped.

    Counts are taken inside the array and read its flags only. A question without responses has a null accuracy.
    """
    correct, total = correct_count(), graded_count()
    return (
        results.withColumn(f"{mode}_correct_count", correct)
        .withColumn(f"{mode}_total_count", total)
        .withColumn(f"{mode}_accuracy", F.when(total > 0, correct / total))
        .drop("responses")
    )
