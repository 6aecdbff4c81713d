"""Connected components of a link table, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.sources.store import materialize


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in ``links(a, b)``; the component is its smallest id.

    Each round takes the smallest label of the neighbours and then the label of that label, so a
    chain of n links takes about log n rounds. A round is written to the shared folder; the driver
    sees one count. Rows with a null end and loops are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "links")
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
        .select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        lowest = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("low"))
        )
        near = labels.join(lowest, "id").select("id", F.least("component", "low").alias("near"), "component")
        further = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        moved = near.join(further, "near").select(
            "id", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved"))
        stored = materialize(moved, "labels")
        labels = stored.select("id", "component")
        if not stored.where("moved").limit(1).count():
            return labels
