"""Hashed n-gram multinomials: counts over all rows of a table, and log probabilities from them.

Each task adds its texts to one table of counts per class and emits the filled places once, so
what is shuffled is bounded by tasks x classes x places and not by the length of the texts. The
finished table (classes x places) is the model; its size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import slices

BITS = 16

#: From texts to (text number, place) of each n-gram.
Grams = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _counter(grams: Grams, size: int):
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column("part").to_pylist()
                classes = sorted(set(names))
                number = {name: i for i, name in enumerate(classes)}
                of = np.array([number[name] for name in names])
                doc, place = grams(part.column("text"))
                found = np.bincount(of[doc] * size + place, minlength=len(classes) * size).reshape(len(classes), size)
                for name, row in zip(classes, found):
                    totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            place = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([name] * len(place), type=pa.string()), "place": pa.array(place, type=pa.int32()),
                "n": pa.array(row[place], type=pa.int64())})

    return count


def class_counts(rows: DataFrame, grams: Grams, bits: int = BITS) -> DataFrame:
    """``part, place, n`` over all texts of ``rows(part string, text string)``; rows without a part are left out."""
    emitted = rows.where("part is not null").select("part", "text").mapInArrow(
        _counter(grams, 1 << bits), "part string, place int, n long")
    return emitted.groupBy("part", "place").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame, bits: int = BITS) -> dict[str, np.ndarray]:
    """The table of counts by class, in the driver: classes x places numbers."""
    found = counts.toPandas()
    model = {}
    for name, group in found.groupby("part"):
        model[name] = np.zeros(1 << bits)
        model[name][group["place"].to_numpy()] = group["n"].to_numpy()
    return dict(sorted(model.items()))


def log_probabilities(counts: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """Log share of each place, every place having ``smoothing`` counts more."""
    return np.log((counts + smoothing) / (counts.sum() + smoothing * len(counts)))
