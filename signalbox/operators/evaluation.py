"""Router evaluation: threshold sweeps, summaries and strategy comparison, one pass each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbox.functions.scores import at_least, ratio
from signalbox.operators.splits import dense_index

# Thresholds swept, the class names and the default cut.
THRESHOLDS = tuple(i / 100 for i in range(10, 91, 5))
THINK, NO_THINK = "think", "no_think"
HALF = 0.5


def pick(score: Column, threshold: float | Column = HALF) -> Column:
    return F.when(at_least(score, threshold), F.lit(THINK)).otherwise(F.lit(NO_THINK))


def threshold_sweep(
    predictions: DataFrame, labelled: bool = True, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """One row per threshold: think share and counts, and accuracy over labelled rows.

    A row is described by how many thresholds it reaches and by its label, so one scan counts
    rows into a few dozen groups on the map side. Only those groups meet the thresholds: the
    input is never multiplied by them, and more thresholds cost no more passes.
    """
    cuts = sorted(float(t) for t in thresholds)
    score = F.col("think_probability")
    reached = reduce(add, [at_least(score, t).cast("int") for t in cuts])
    groups = {"_reached": reached}
    if labelled:
        label = F.col("label")
        known = label.isin(THINK, NO_THINK)
        groups["_label"] = F.when(label.isNull() | known, label).otherwise(F.lit("other"))
    counted = predictions.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(
        F.count(F.lit(1)).alias("_n")
    )
    spread = counted.select(
        "*", F.posexplode(F.array(*[F.lit(t) for t in cuts])).alias("_i", "threshold")
    )
    think = F.col("_i") < F.col("_reached")

    def rows_where(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("_n"))), F.lit(0))

    sums = [F.sum("_n").alias("_rows"), rows_where(think).alias("think_count")]
    if labelled:
        picked = F.when(think, F.lit(THINK)).otherwise(F.lit(NO_THINK))
        sums += [
            rows_where(F.col("_label").isNotNull()).alias("_labelled"),
            rows_where(picked == F.col("_label")).alias("_hits"),
        ]
    share = ratio(F.col("think_count"), F.col("_rows")) * 100
    columns = [
        F.col("threshold"),
        share.alias("think_percentage"),
        (100 - share).alias("no_think_percentage"),
        F.col("think_count"),
        (F.col("_rows") - F.col("think_count")).alias("no_think_count"),
    ]
    if labelled:
        columns.append(ratio(F.col("_hits"), F.col("_labelled")).alias("accuracy"))
    return spread.groupBy("threshold").agg(*sums).select(*columns)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Most accurate threshold, the lowest on ties, null when nothing beats 0."""
    useful = F.when(F.col("accuracy") > 0, F.struct("accuracy", -F.col("threshold")))
    return sweep.agg(
        F.max_by("threshold", useful).alias("best_threshold"),
        F.coalesce(F.max(F.when(F.col("accuracy") > 0, F.col("accuracy"))), F.lit(0.0)).alias("best_accuracy"),
    )


def score_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("think_probability").alias("avg_think"),
        F.avg("no_think_probability").alias("avg_no_think"),
        F.min("think_probability").alias("min_think"),
        F.max("think_probability").alias("max_think"),
    )


def classify_half(predictions: DataFrame) -> DataFrame:
    """Counts strictly above one half on each score; an exact tie is in neither."""

    def above(name: str) -> Column:
        return F.count_if((F.col(name) > HALF) & ~F.isnan(name))

    n = F.count(F.lit(1))
    return predictions.agg(
        above("think_probability").alias("think_count"),
        above("no_think_probability").alias("no_think_count"),
        (ratio(above("think_probability"), n) * 100).alias("think_percentage"),
        (ratio(above("no_think_probability"), n) * 100).alias("no_think_percentage"),
    )


def label_accuracy(predictions: DataFrame, threshold: float = HALF) -> DataFrame:
    hits = F.count_if(pick(F.col("think_probability"), threshold) == F.col("label"))
    total = F.count("label")
    return predictions.agg(
        hits.alias("correct"), total.alias("total"), ratio(hits, total).alias("accuracy")
    )


def _distribution(df: DataFrame, column: Column, name: str, extra: Column | None = None) -> DataFrame:
    """Count and percent of each of the few classes."""
    per = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return per.select(name, "n", (F.col("n") / total * 100).alias("percentage")).orderBy(name)


def label_distribution(predictions: DataFrame) -> DataFrame:
    return _distribution(predictions.filter(F.col("label").isNotNull()), F.col("label"), "label")


def pick_distribution(predictions: DataFrame, threshold: float = HALF) -> DataFrame:
    return _distribution(predictions, pick(F.col("think_probability"), threshold), "pick")


def router_pick() -> Column:
    """Think when its probability is not lower; a missing prediction means no_think."""
    think, no_think = F.col("think_probability"), F.col("no_think_probability")
    known = ~F.isnan(think) & ~F.isnan(no_think)
    return F.when(known & (think >= no_think), F.lit(THINK)).otherwise(F.lit(NO_THINK))


def pick_value_counts(joined: DataFrame) -> DataFrame:
    per = joined.groupBy(router_pick().alias("router_pick")).agg(F.count(F.lit(1)).alias("n"))
    return per.orderBy(F.desc("n"), "router_pick")


def pair_modes(no_think: DataFrame, think: DataFrame) -> DataFrame:
    """Results of both modes side by side; shared columns come from the no-think side."""
    own = [c for c in think.columns if c == "unique_id" or c not in no_think.columns]
    return no_think.join(think.select(*own), "unique_id")


def pair_by_position(
    left: DataFrame, right: DataFrame, left_order: str, right_order: str
) -> DataFrame:
    """Row i beside row i for inputs without ids; the longer side keeps its tail."""
    own = [c for c in right.columns if c not in left.columns]
    numbered_left = dense_index(left, left_order)
    numbered_right = dense_index(right, right_order).select("idx", *own)
    return numbered_left.join(numbered_right, "idx", "full")


def router_vs_inference(inference: DataFrame, predictions: DataFrame, key: str = "unique_id") -> DataFrame:
    """Attach predictions to measured results by ``key`` and add ``router_pick``.

    ``key`` may be a dense ``idx`` on both sides for positional parity. Predictions without a
    result are ignored; results without a prediction fall to no_think.
    """
    scores = predictions.select(key, "think_probability", "no_think_probability")
    joined = inference.join(scores, key, "left")
    return joined.withColumn("router_pick", router_pick())


def _strategies(joined: DataFrame, suffix: str, what: str) -> DataFrame:
    think, no_think = F.col(f"think_{suffix}"), F.col(f"no_think_{suffix}")
    routed = F.when(F.col("router_pick") == THINK, think).otherwise(no_think)
    averages = joined.agg(
        F.avg(no_think).alias(f"no_think_{what}"),
        F.avg(think).alias(f"think_{what}"),
        F.avg(routed).alias(f"router_{what}"),
    )
    router = F.col(f"router_{what}")
    return averages.withColumn("vs_no_think", router - F.col(f"no_think_{what}")).withColumn(
        "vs_think", router - F.col(f"think_{what}")
    )


def strategy_accuracy(joined: DataFrame) -> DataFrame:
    """Always no-think, always think and the router, compared by accuracy."""
    return _strategies(joined, "accuracy", "accuracy")


def strategy_reward(joined: DataFrame) -> DataFrame:
    """The same comparison over quality scores."""
    return _strategies(joined, "score", "reward")


def label_strategy_reward(predictions: DataFrame, threshold: float = HALF) -> DataFrame:
    """Rewards when the router picks at a threshold; rows without the chosen score are skipped."""
    return strategy_reward(
        predictions.withColumn("router_pick", pick(F.col("think_probability"), threshold))
    ).withColumn("router_reward", F.coalesce("router_reward", F.lit(0.0)))


def diff_stats(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg("diff_score").alias("avg_diff"),
        F.min("diff_score").alias("min_diff"),
        F.max("diff_score").alias("max_diff"),
    )
