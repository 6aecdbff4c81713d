"""Explicit schemas: nothing is inferred at scan."""

from __future__ import annotations

from pyspark.sql import types as T

QUESTION = T.StructType(
    [
        T.StructField("unique_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("choice_index_correct", T.IntegerType()),
        T.StructField("explanation_correct", T.StringType()),
        T.StructField("answer_correct", T.StringType()),
    ]
)

RAW_RESPONSE = T.StructType([T.StructField("full_response", T.StringType())])

GRADED_RESPONSE = T.StructType(
    [
        T.StructField("full_response", T.StringType()),
        T.StructField("extracted_answer", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("judge_explanation", T.StringType()),
    ]
)

_RESULT_FIELDS = [
    T.StructField("unique_id", T.StringType()),
    T.StructField("problem", T.StringType()),
    T.StructField("is_mcq", T.BooleanType()),
    T.StructField("choices", T.ArrayType(T.StringType())),
    T.StructField("choice_index_correct", T.IntegerType()),
    T.StructField("explanation_correct", T.StringType()),
    T.StructField("answer_correct", T.StringType()),
    T.StructField("category", T.StringType()),
]

RAW_RESULT = T.StructType([*_RESULT_FIELDS, T.StructField("responses", T.ArrayType(RAW_RESPONSE))])
GRADED_RESULT = T.StructType(
    [*_RESULT_FIELDS, T.StructField("responses", T.ArrayType(GRADED_RESPONSE))]
)

RESULT_COLUMNS = [field.name for field in _RESULT_FIELDS]

# Two layouts of stored router predictions: the score names and the id type differ per producer.
PREDICTION_WITH_ID = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("think_probability", T.DoubleType()),
        T.StructField("no_think_probability", T.DoubleType()),
        T.StructField("think_score", T.DoubleType()),
        T.StructField("no_think_score", T.DoubleType()),
    ]
)
PREDICTION_WITH_INDEX = T.StructType(
    [
        T.StructField("problem_idx", T.LongType()),
        T.StructField("problem_type", T.ArrayType(T.StringType())),
        *[f for f in PREDICTION_WITH_ID.fields if f.name != "id"],
    ]
)
