"""Reading again the texts of some ids, without shuffling the other texts.

A bitmap of fixed size holds the hashed ids. Texts outside it are dropped where they are read; the few
that share a bit with a wanted id go in the exact join that follows. With more ids than bits the
bitmap fills up and drops less; results do not change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap.
BITS = 1 << 23


def place(column: str = "id"):
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def id_bitmap(ids: DataFrame) -> np.ndarray:
    """The bitmap of column ``id``; the driver receives at most BITS / 8 bytes."""
    rows = (
        ids.select(place().alias("place")).groupBy(F.bitmap_bucket_number("place").alias("number"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    )
    bits = np.zeros((BITS // 32768 + 2, 4096), dtype=np.uint8)
    for row in rows:
        bits[row.number] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return bits


def with_place(rows: DataFrame) -> DataFrame:
    """``id, text`` and where the bitmap holds the id."""
    return rows.select("id", "text", F.bitmap_bucket_number(place()).alias("number"), F.bitmap_bit_position(place()).alias("position"))


def held(bits: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of a batch of :func:`with_place` whose id may be wanted."""
    number, position = np.asarray(batch.column("number")), np.asarray(batch.column("position"))
    return batch.filter(pa.array(((bits[number, position >> 3] >> (position & 7)) & 1).astype(bool)))


def read_again(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, text`` of the rows whose id may be in ``ids``; the caller joins exactly."""
    bits = id_bitmap(ids)

    def pick(batches):
        for batch in batches:
            yield held(bits, batch).select(["id", "text"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string"
    return with_place(rows.where("id is not null").select("id", "text")).mapInArrow(pick, schema)
