"""Routing decisions over score columns and the model catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.scores import argmax, at_least

# The selectable models with display name, provider and reasoning support.
MODEL_CATALOG = [
    ("google/gemini-2.5-pro-preview", "Gemini 2.5 Pro", "openrouter", True),
    ("google/gemini-2.5-flash-preview", "Gemini 2.5 Flash", "openrouter", True),
    ("google/gemini-2.0-flash-001", "Gemini 2.0 Flash", "openrouter", False),
    ("google/gemma-3-4b-it", "Gemma 3 4B", "openrouter", True),
    ("qwen/qwen3-14b", "Qwen 3 14B", "openrouter", True),
    ("anthropic/claude-3.7-sonnet:thinking", "Claude 3.7 Sonnet (Thinking)", "openrouter", True),
    ("anthropic/claude-3.7-sonnet", "Claude 3.7 Sonnet", "openrouter", False),
]
UNKNOWN_MODEL = "Unknown Model"
DEFAULT_PROVIDER = "openrouter"
AUTOMATIC = "automatic"
MODEL_NOT_FOUND = "Error: Model not found"

# Fixed values: (reasoning needed, high difficulty) to model, and class label to model.
DECISION_TABLE = {
    (True, True): "google/gemini-2.5-pro-preview",
    (True, False): "qwen/qwen3-14b",
    (False, True): "google/gemini-2.0-flash-001",
    (False, False): "google/gemma-3-4b-it",
}
CLASS_MODELS = {
    "large_llm": "google/gemini-2.5-flash-preview",
    "small_llm": "google/gemini-2.0-flash-001",
}

REASONING_THRESHOLD = 0.4
DIFFICULTY_THRESHOLD = 0.5
SELECTOR_THRESHOLD = 0.5


def model_catalog(spark: SparkSession) -> DataFrame:
    """The catalog as a seven-row dimension."""
    return spark.createDataFrame(
        MODEL_CATALOG, "model_key string, display_name string, provider string, supports_reasoning boolean"
    )


def model_lookup(df: DataFrame, key_col: str = "model_key") -> DataFrame:
    """Add display name, provider and reasoning support, with defaults for unknown keys.

    The broadcast side is the fixed catalog above, never data.
    """
    catalog = model_catalog(df.sparkSession).withColumnRenamed("model_key", key_col)
    joined = df.join(F.broadcast(catalog), key_col, "left")
    return (
        joined.withColumn("display_name", F.coalesce("display_name", F.lit(UNKNOWN_MODEL)))
        .withColumn("provider", F.coalesce("provider", F.lit(DEFAULT_PROVIDER)))
        .withColumn("supports_reasoning", F.coalesce("supports_reasoning", F.lit(False)))
    )


def _literal_map(pairs: dict[str, str | bool]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def key_of_display_name(name: Column) -> Column:
    """Model key of a display name, null when there is none; the first catalog row wins."""
    keys = {display: key for key, display, _, _ in reversed(MODEL_CATALOG)}
    return F.try_element_at(_literal_map(keys), name)


def supports_reasoning(key: Column) -> Column:
    flags = _literal_map({key: flag for key, _, _, flag in MODEL_CATALOG})
    return F.coalesce(F.try_element_at(flags, key), F.lit(False))


def available_models(spark: SparkSession) -> DataFrame:
    return model_catalog(spark).select("display_name")


def reasoning_models(spark: SparkSession) -> DataFrame:
    return model_catalog(spark).filter("supports_reasoning").select("model_key")


def routable_models(spark: SparkSession) -> DataFrame:
    """Distinct models the two-score table can select."""
    rows = [(model,) for model in DECISION_TABLE.values()]
    return spark.createDataFrame(rows, "model_key string").distinct()


def decide(reasoning_needed: Column, high_difficulty: Column) -> Column:
    """The two-by-two decision table as one expression."""
    (first, second), *rest = DECISION_TABLE
    chosen = F.when(
        (reasoning_needed == first) & (high_difficulty == second), F.lit(DECISION_TABLE[(first, second)])
    )
    for needed, hard in rest:
        chosen = chosen.when(
            (reasoning_needed == needed) & (high_difficulty == hard), F.lit(DECISION_TABLE[(needed, hard)])
        )
    return chosen


def route_two_head(
    df: DataFrame,
    reasoning_threshold: float = REASONING_THRESHOLD,
    difficulty_threshold: float = DIFFICULTY_THRESHOLD,
) -> DataFrame:
    """Threshold ``reasoning_score`` and ``difficulty_score`` into a model; ``>=`` on both."""
    return (
        df.withColumn("reasoning_needed", at_least(F.col("reasoning_score"), reasoning_threshold))
        .withColumn("high_difficulty", at_least(F.col("difficulty_score"), difficulty_threshold))
        .withColumn("selected_model", decide(F.col("reasoning_needed"), F.col("high_difficulty")))
    )


def route_class(df: DataFrame, probabilities: Column, labels: list[str]) -> DataFrame:
    """Label of the largest probability and the model it stands for; unknown labels stop the job."""
    names = F.array(*[F.lit(label) for label in labels])
    label = F.get(names, argmax(probabilities))
    model = F.try_element_at(_literal_map(CLASS_MODELS), label)
    invalid = F.raise_error(F.concat(F.lit("Invalid model type: "), label))
    return df.withColumn("label", label).withColumn(
        "selected_model", F.when(label.isNull() | model.isNotNull(), model).otherwise(invalid)
    )


def route_win_rate(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Strong or weak model by ``confidence``; a missing score is the neutral 0.5."""
    score = F.coalesce("confidence", F.lit(0.5))
    return (
        df.withColumn("confidence", score)
        .withColumn("no_think_probability", 1.0 - F.col("confidence"))
        .withColumn("think_probability", F.col("confidence"))
        .withColumn("route", F.when(at_least(F.col("confidence"), threshold), "strong").otherwise("weak"))
    )


def select_model(df: DataFrame, threshold: float = SELECTOR_THRESHOLD) -> DataFrame:
    """Resolve ``model_selection``: ``automatic`` routes by scores, anything else names a model.

    Adds ``model_key``, ``error`` for an unknown name, and ``use_reasoning``: the model supports
    it and ``enable_reasoning`` does not switch it off (null counts as on).
    """
    automatic = F.col("model_selection") == AUTOMATIC
    routed = decide(
        at_least(F.col("reasoning_score"), threshold), at_least(F.col("difficulty_score"), threshold)
    )
    key = F.when(automatic, routed).otherwise(key_of_display_name(F.col("model_selection")))
    chosen = df.withColumn("model_key", key)
    return chosen.withColumn(
        "error", F.when(F.col("model_key").isNull(), F.lit(MODEL_NOT_FOUND))
    ).withColumn(
        "use_reasoning",
        supports_reasoning(F.col("model_key")) & F.coalesce("enable_reasoning", F.lit(True)),
    )
