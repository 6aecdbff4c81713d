"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.session import fresh_dir


def run_append(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write what a stateless stream has available to Parquet, then stop."""
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write every available micro-batch of an update stream to its own folder, then stop.

    The folder is named by the batch number, so a repeated batch replaces its first attempt.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def latest_updates(df: DataFrame, key: str) -> DataFrame:
    """Rows of the last batch that touched each key."""
    newest = Window.partitionBy(key).orderBy(F.col("batch").desc())
    return df.withColumn("_rank", F.rank().over(newest)).filter("_rank = 1").drop("_rank", "batch")


def replay_in_slices(
    df: DataFrame,
    order: str,
    build: Callable[[DataFrame], DataFrame],
    run: Callable[[DataFrame, str, str], None],
    label: str,
    slices: int = 3,
    feed: str = "forward",
) -> DataFrame:
    """Feed a stored table to a stream in slices of ``order`` and read what came out.

    ``feed`` is ``forward``, ``reverse`` (the last slice first) or ``interleaved`` (every slice takes
    each third value or so, the higher remainders first).
    After each slice the query runs to the end of its input and is restarted from its checkpoint,
    so state has to survive. Every row belongs to exactly one slice, written by as many tasks as
    hold its rows.
    """
    spark = df.sparkSession
    source, out, checkpoint = (fresh_dir(spark, f"{label}-{part}") for part in ("in", "out", "checkpoint"))
    key = F.col(order)
    if feed == "interleaved":
        parts = [df.filter(F.pmod(key, F.lit(slices)) == i) for i in reversed(range(slices))]
    else:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(df.agg(F.percentile_approx(key, shares).alias("c")).first().c or []))
        ranges = zip([None, *cuts], [*cuts, None])
        parts = [
            df.filter((F.lit(True) if low is None else key > low) & (F.lit(True) if high is None else key <= high))
            for low, high in ranges
        ]
        if feed == "reverse":
            parts.reverse()
    for part in parts:
        part.write.mode("append").parquet(source)
        run(build(spark.readStream.schema(df.schema).parquet(source)), out, checkpoint)
    return spark.read.parquet(out)
