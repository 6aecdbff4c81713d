"""Access to the response array field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def response_fields(*names: str) -> Column:
    """The ``responses`` array reduced to some fields.

    Taking fields before any lambda or explode lets a columnar scan skip the others, above all
    the response texts; a lambda over whole structs would read them all.
    """
    return F.arrays_zip(*[F.col(f"responses.{name}") for name in names])


def correct_count() -> Column:
    flags = F.col("responses.is_correct")
    return F.size(F.filter(flags, lambda flag: F.coalesce(flag, F.lit(False))))


def graded_count() -> Column:
    return F.size(F.col("responses.is_correct"))
