"""Inputs shaped like the library's data model, derived from the given tables.

Every view is a narrow expression over whole tables, except the label join of the predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.answers import answers_equal, choice_letter, extract_answer
from signalbox.functions.text import bind
from signalbox.operators.grading import LLM_JUDGE, MATH_VERIFY, REGEX_FALLBACK, grade_in_place, row_gold
from signalbox.session import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per document; even ids are multiple choice."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    mcq = doc % 2 == 0
    options = F.array("source", "lang", chars.cast("string"), F.lit("none"))
    answer = (
        F.when(doc % 2 == 1, (chars % 97).cast("string"))
        .when(doc % 4 == 0, F.col("source"))
        .otherwise(chars.cast("string"))
    )
    return table(spark, sf_dir, "documents").select(
        F.md5(doc.cast("string")).alias("unique_id"),
        "doc_id",
        F.col("text").alias("problem"),
        F.col("lang").alias("category"),
        "source",
        mcq.alias("is_mcq"),
        F.when(mcq, options).alias("choices"),
        F.when(mcq, (doc % 4).cast("int")).alias("choice_index_correct"),
        F.lit(None).cast("string").alias("explanation_correct"),
        answer.alias("answer_correct"),
    )


def _response_text(kind: Column, gold: Column) -> Column:
    boxed = F.concat(F.lit("work <answer>\\boxed{"), gold, F.lit("}</answer>"))
    return (
        F.when(kind <= 3, boxed)
        .when(kind == 4, F.concat(F.lit("so $"), gold, F.lit("$")))
        .when(kind == 5, F.lit("<answer>wrong</answer>"))
        .when(kind == 6, F.lit("<answer>\\boxed{\\frac{1}{2}}</answer>"))
        .when(kind == 7, F.lit("no final answer"))
        .when(kind == 8, F.lit("Error generating response: timeout"))
        .otherwise(F.lit("   "))
    )


def response_kind(doc: Column, slot: Column, shift: int = 0) -> Column:
    return (doc * 7 + slot * 3 + shift) % 10


def raw_results(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Questions with one to four responses in an array; ``shift`` gives another model's answers."""
    doc = F.col("doc_id")
    gold = F.when(F.col("is_mcq"), choice_letter(F.col("choice_index_correct"))).otherwise(
        F.col("answer_correct")
    )
    slots = F.sequence(F.lit(0), (doc % 4).cast("int"))
    responses = F.transform(
        slots,
        lambda i: F.struct(_response_text(response_kind(doc, i, shift), gold).alias("full_response")),
    )
    return questions(spark, sf_dir).withColumn("responses", responses)


def graded_results(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Graded in place by extraction and equality alone."""
    return grade_in_place(raw_results(spark, sf_dir, shift))


def judged_results(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Graded results in which a fixed rule stands for the judge, so all methods occur."""
    doc = F.col("doc_id")

    def verdict(text: Column, kind: Column, answer: Column, correct: Column) -> Column:
        asked = kind.isin(5, 6)
        return F.struct(
            text.alias("full_response"),
            answer.alias("extracted_answer"),
            F.when(correct, True).when(asked, doc % 3 == 0).otherwise(False).alias("is_correct"),
            F.when(correct, F.lit(MATH_VERIFY))
            .when(asked, F.lit(LLM_JUDGE))
            .otherwise(F.lit(REGEX_FALLBACK))
            .alias("extraction_method"),
            F.when(~correct & asked, F.concat(F.lit("judged: "), answer)).alias("judge_explanation"),
        )

    def judged(text: Column, i: Column) -> Column:
        kind = response_kind(doc, i, shift)
        return bind(
            extract_answer(text),
            lambda answer: bind(
                answers_equal(F.col("_gold"), answer), lambda correct: verdict(text, kind, answer, correct)
            ),
        )

    with_gold = raw_results(spark, sf_dir, shift).withColumn("_gold", row_gold())
    return with_gold.withColumn(
        "responses", F.transform("responses", lambda r, i: judged(r["full_response"], i))
    ).drop("_gold")


_STORED: dict[tuple[str, str, int], str] = {}


def stored_results(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """The judged results as a stored table, which is what later steps read in practice.

    Written to the shared folder on first use in an application. Reading it back gives column
    and nested-field pruning, and filters that do not repeat the grading.
    """
    key = (spark.sparkContext.applicationId, sf_dir, shift)
    if key not in _STORED:
        path = fresh_dir(spark, "judged")
        judged_results(spark, sf_dir, shift).write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router scores per document with quality scores and a label where one is known."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    think = (chars % 1024).cast("double") / 1024.0
    label = F.when(F.col("quality") == 1, F.lit("think")).when(F.col("quality") == 0, F.lit("no_think"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars", "text")
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            F.md5(doc.cast("string")).alias("unique_id"),
            F.col("text").alias("prompt"),
            think.alias("think_probability"),
            (1.0 - think).alias("no_think_probability"),
            ((doc % 512).cast("double") / 512.0).alias("difficulty_score"),
            label.alias("label"),
            F.when(doc % 11 != 0, (chars % 50).cast("double") / 2.0).alias("think_score"),
            F.when(doc % 13 != 0, (doc % 50).cast("double") / 2.0).alias("no_think_score"),
        )
    )


def two_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning and difficulty score per document."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        ((chars % 1024).cast("double") / 1024.0).alias("reasoning_score"),
        ((doc % 512).cast("double") / 512.0).alias("difficulty_score"),
    )


def chunks_of(events: DataFrame) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id")
    return events.select(
        F.col("user_id").alias("request_id"),
        number.alias("seq"),
        F.when(kind != "error", F.concat(kind, F.lit(" "))).alias("content"),
        F.when(
            kind.isin("view", "error"), F.concat(F.lit("r"), number.cast("string"), F.lit(" "))
        ).alias("reasoning"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response chunks: one request per user, events in order."""
    return chunks_of(table(spark, sf_dir, "events"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
