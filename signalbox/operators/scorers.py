"""Prompt scorers: logistic heads on hashed text features with Spark ML, and heads from word counts alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.terms import term_counts

#: Column of the word counts of a text, a sparse vector.
COUNTS = "_tf"


def with_word_counts(df: DataFrame, text_col: str = "text", buckets: int = 4096) -> DataFrame:
    """Add the hashed word counts of whole texts; rows that have them, as stored ones, stay as they are.

    Splitting and hashing texts is most of the work of fitting and scoring, and the counts are far smaller than
    the texts: what fits or scores the same rows more than once can store them.
    """
    return df if COUNTS in df.columns else df.withColumn(COUNTS, term_counts(F.col(text_col), buckets))


def _head(label: str, column: str, iterations: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="_features", labelCol=label, probabilityCol=column, rawPredictionCol=f"{column}_raw",
        predictionCol=f"{column}_class", maxIter=iterations, regParam=0.01,
    )


@dataclass
class TextHeads:
    """Shared features and one independent sigmoid head per name.

    Words are counted in Arrow batches, the rest of scoring is a JVM transformation: the fixed-size
    coefficients travel with the tasks and whole texts are read, without a token limit.
    """

    text_col: str
    features: IDFModel
    heads: dict[str, LogisticRegressionModel]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``{name}_score`` per head."""
        kept = df.columns
        scored = self.features.transform(with_word_counts(df, self.text_col, self.features.idf.size))
        for name, head in self.heads.items():
            scored = head.transform(scored).withColumn(
                f"{name}_score", vector_to_array(f"_{name}")[1]
            )
        return scored.select(*kept, *[f"{name}_score" for name in self.heads])

    def classify(self, df: DataFrame, labels: tuple[str, str], head: str) -> DataFrame:
        """Add ``{label}_probability`` for a two-class head, first label for class 0."""
        score = F.col(f"{head}_score")
        return TextHeads(self.text_col, self.features, {head: self.heads[head]}).score(df).select(
            *df.columns,
            (1.0 - score).alias(f"{labels[0]}_probability"),
            score.alias(f"{labels[1]}_probability"),
        )


def fit_text_heads(
    train: DataFrame, targets: dict[str, str], text_col: str = "text", buckets: int = 4096, iterations: int = 20
) -> TextHeads:
    """Fit one logistic head per ``{name: 0/1 label column}`` on shared features.

    Words are counted once and kept (memory, then disk) while the features are fitted and the heads iterate.
    """
    counted = with_word_counts(train, text_col, buckets).select(COUNTS, *targets.values()).persist()
    try:
        features = IDF(inputCol=COUNTS, outputCol="_features").fit(counted)
        ready = features.transform(counted)
        heads = {
            name: _head(label, f"_{name}", iterations).fit(ready.filter(F.col(label).isNotNull()))
            for name, label in targets.items()
        }
    finally:
        counted.unpersist()
    return TextHeads(text_col, features, heads)


#: Word buckets of :class:`CountHeads`, the values of three hexadecimal digits.
COUNT_BUCKETS = 1 << 12


def word_buckets(text: Column) -> Column:
    """Bucket of each word of a text: the first three hexadecimal digits of its MD5 digest."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.transform(found, lambda w: F.conv(F.substring(F.md5(w), 1, 3), 16, 10).cast("int"))


@dataclass
class CountHeads:
    """One head per name: a coefficient for each word bucket, from counts that any engine can repeat.

    A score is the sigmoid of ``sharpness`` times the mean coefficient of a text's words, so it does not
    grow with the length; a text without words scores 0.5. The coefficients are of fixed size and travel with
    the tasks; scoring is one expression in the row, without a shuffle.
    """

    text_col: str
    coefficients: dict[str, np.ndarray]
    sharpness: float = 20.0

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``{name}_score`` per head."""
        buckets = word_buckets(F.col(self.text_col))

        def head(values: np.ndarray) -> Column:
            table = F.lit(values)
            total = F.aggregate(buckets, F.lit(0.0), lambda sum_, b: sum_ + F.get(table, b))
            mean = total / F.nullif(F.size(buckets), F.lit(0))
            return 1 / (1 + F.exp(-self.sharpness * F.coalesce(mean, F.lit(0.0))))

        return df.select("*", *[head(values).alias(f"{name}_score") for name, values in self.coefficients.items()])

    def classify(self, df: DataFrame, labels: tuple[str, str], head: str) -> DataFrame:
        """Add ``{label}_probability`` for a two-class head, first label for class 0."""
        one = CountHeads(self.text_col, {head: self.coefficients[head]}, self.sharpness)
        score = F.col(f"{head}_score")
        probabilities = (1.0 - score).alias(f"{labels[0]}_probability"), score.alias(f"{labels[1]}_probability")
        return one.score(df).select(*df.columns, *probabilities)


def fit_count_heads(train: DataFrame, targets: dict[str, str], text_col: str = "text") -> CountHeads:
    """Log ratios of smoothed word shares for each ``{name: 0/1 label column}``, counted in one pass.

    Words are reduced to their buckets on the map side, so the shuffle and the driver see a fixed number of
    counts whatever the data. Rows whose label is null count for no class; without any the ratios are 0.
    """
    rows = train.select(F.explode(word_buckets(F.col(text_col))).alias("bucket"), *set(targets.values()))
    counts = [
        F.count_if(F.col(column) == label).alias(f"{name}_{label}") for name, column in targets.items() for label in (0, 1)
    ]
    found = rows.groupBy("bucket").agg(*counts).toPandas()
    coefficients = {}
    for name in targets:
        shares = []
        for label in (0, 1):
            seen = np.zeros(COUNT_BUCKETS)
            seen[found["bucket"].to_numpy(dtype=int)] = found[f"{name}_{label}"].to_numpy(dtype=float)
            shares.append(np.log((seen + 1) / (seen.sum() + COUNT_BUCKETS)))
        coefficients[name] = shares[1] - shares[0]
    return CountHeads(text_col, coefficients)
