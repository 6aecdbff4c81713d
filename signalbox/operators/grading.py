"""Grade responses: extract, verify, send the unresolved ones to a judge, merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.answers import (
    EXTRACTION_FAILED,
    answers_equal,
    answers_match,
    each_matches,
    extract_answer,
    extraction_failed,
    gold_answer,
)
from signalbox.functions.arrays import response_fields
from signalbox.functions.text import bind
from signalbox.operators.prompts import judge_prompt
from signalbox.operators.stages import Judge, judge_stage

# Names of the extraction methods in stored results.
MATH_VERIFY = "math_verify"
LLM_JUDGE = "llm_judge"
REGEX_FALLBACK = "regex_fallback"
REGEX = "regex"
METHODS = (MATH_VERIFY, LLM_JUDGE, REGEX_FALLBACK)

Verifier = Callable[[Column, Column], Column]


def row_gold() -> Column:
    return gold_answer(F.col("is_mcq"), F.col("choice_index_correct"), F.col("answer_correct"))


def explode_responses(
    results: DataFrame,
    keep: Sequence[str] | None = None,
    outer: bool = False,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One row per response with its 0-based ``response_idx``.

    Only ``keep`` columns and ``fields`` of the responses travel, or all of them by default.

    The outer explode with a test afterwards reads the array once; a plain explode would first
    filter on its size and so compute a derived array twice.
    """
    kept = [c for c in (keep or results.columns) if c != "responses"]
    array = response_fields(*fields) if fields else F.col("responses")
    rows = results.select(*kept, F.posexplode_outer(array).alias("response_idx", "_response"))
    if not outer:
        rows = rows.filter(F.col("response_idx").isNotNull())
    return rows.select(*kept, "response_idx", "_response.*")


def grade_in_place(results: DataFrame, verifier: Verifier = answers_equal, algebra: bool = False) -> DataFrame:
    """Grade inside the response array: no explode, no shuffle, the order kept.

    Every response is tagged ``math_verify`` and keeps the raw extract, "not found" included. With
    ``algebra`` the arrays of questions that have some also go through :func:`each_matches`; a ``verifier``
    has to be an expression that may stand inside a lambda.
    """

    def graded(text: Column, gold: Column) -> Column:
        return bind(
            extract_answer(text),
            lambda answer: F.struct(
                text.alias("full_response"),
                answer.alias("extracted_answer"),
                verifier(gold, answer).alias("is_correct"),
                F.lit(MATH_VERIFY).alias("extraction_method"),
                F.lit(None).cast("string").alias("judge_explanation"),
            ),
        )

    with_gold = results.withColumn("_gold", row_gold())
    responses = F.transform("responses", lambda r: graded(r["full_response"], F.col("_gold")))
    found = with_gold.withColumn("responses", responses)
    if algebra:
        found = found.withColumn("_solved", each_matches(F.col("_gold"), F.col("responses.extracted_answer")))
        solved = F.transform(
            "responses", lambda r, i: r.withField("is_correct", r["is_correct"] | F.coalesce(F.get("_solved", i), F.lit(False))))
        found = found.withColumn("responses", F.when(F.col("_solved").isNull(), F.col("responses")).otherwise(solved)).drop("_solved")
    return found.drop("_gold")


def grade_rows(rows: DataFrame, verifier: Verifier = answers_equal) -> DataFrame:
    """Exploded form of :func:`grade_in_place`: adds extract, correctness and method.

    Pass :func:`answers_match` to compare algebra too, which runs Python beside the rows.
    """
    graded = rows.withColumn("extracted_answer", extract_answer(F.col("full_response")))
    return graded.withColumn(
        "is_correct", verifier(row_gold(), F.col("extracted_answer"))
    ).withColumn("extraction_method", F.lit(MATH_VERIFY))


def grade_math_only(rows: DataFrame, verifier: Verifier = answers_equal) -> DataFrame:
    """First phase of judged grading: ``extracted_answer, is_correct, needs_judge``."""
    found = rows.withColumn("_found", extract_answer(F.col("full_response")))
    failed = extraction_failed(F.col("_found"))
    correct = F.when(failed, F.lit(False)).otherwise(verifier(row_gold(), F.col("_found")))
    return (
        found.withColumn("is_correct", correct)
        .withColumn(
            "extracted_answer",
            F.when(failed, F.lit(EXTRACTION_FAILED)).otherwise(F.col("_found")),
        )
        .withColumn("needs_judge", ~F.col("is_correct"))
        .drop("_found")
    )


def grade_three_phase(
    results: DataFrame,
    judge: Judge,
    max_workers: int = 40,
    compat: bool = False,
    resolved_method: str = MATH_VERIFY,
    keep: Sequence[str] = (),
    with_prompt: bool = False,
    in_flight: int | None = None,
) -> DataFrame:
    """Regex first, judge for the rest, one row per response.

    Responses are read and graded once, algebra included. One stage asks the judge about unresolved rows and lets the
    others pass, so there is no join, no union and no shuffle. ``with_prompt`` also hands the judge its
    rendered prompt as ``judge_prompt``. Write the result once before using it
    twice; the judge may be neither cheap nor deterministic.
    """
    base = ["unique_id", "problem", "is_mcq", "choices", "choice_index_correct", "answer_correct"]
    columns = [*base, *[c for c in keep if c not in base]]
    checked = grade_math_only(explode_responses(results, columns), answers_match)
    out = ["unique_id", "response_idx", *[c for c in keep if c != "unique_id"], "full_response",
           "extracted_answer", "is_correct", "extraction_method", "judge_explanation"]
    tasks = (
        checked.withColumn("extraction_method", F.lit(resolved_method))
        .withColumn("judge_explanation", F.lit(None).cast("string"))
        .withColumn("correct_answer", row_gold())
    )
    if with_prompt:
        prompt = judge_prompt(
            F.col("problem"), F.col("full_response"), F.col("correct_answer"), F.col("choices"),
            F.col("is_mcq"), compat,
        )
        tasks = tasks.withColumn("judge_prompt", prompt)
    return judge_stage(tasks, judge, max_workers=max_workers, compat=compat, only="needs_judge", in_flight=in_flight).select(*out)


def grade_with_fallback(results: DataFrame, judge: Judge, max_workers: int = 40) -> DataFrame:
    """Single-response variant whose resolved rows carry the tag ``regex``."""
    return grade_three_phase(results, judge, max_workers, resolved_method=REGEX)


def nest_responses(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Graded rows back to one row per question, responses in their original order.

    Only for storing the nested layout, whose rows hold all responses of a question by
    definition. Metrics work on the exploded rows and never need this shuffle.
    """
    fields = ["full_response", "extracted_answer", "is_correct", "extraction_method", "judge_explanation"]
    packed = rows.groupBy("unique_id").agg(
        F.array_sort(F.collect_list(F.struct("response_idx", *fields))).alias("_packed")
    )
    nested = packed.select(
        "unique_id",
        F.transform("_packed", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("responses"),
    )
    empty = F.array().cast(nested.schema["responses"].dataType)
    kept = questions.drop("responses")
    return kept.join(nested, "unique_id", "left").withColumn(
        "responses", F.coalesce("responses", empty)
    )
