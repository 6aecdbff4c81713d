"""Stored question banks with an optional limit."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from signalbox.operators.splits import first_rows

_log = logging.getLogger(__name__)


def read_bank(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def limit_questions(df: DataFrame, num_problems: int | str, order_col: str) -> DataFrame:
    """First ``num_problems`` questions in order, or all for ``"all"`` and non-positive numbers.

    See :func:`first_rows`: only questions up to a cut are shuffled and sorted, whatever the limit, and any
    type that Spark sorts will do. Questions without an order value come last.
    """
    if isinstance(num_problems, str) and num_problems.lower() == "all":
        return df
    if isinstance(num_problems, bool) or not isinstance(num_problems, int):
        raise ValueError(f"num_problems must be a positive integer or 'all', not {num_problems!r}")
    if num_problems <= 0:
        _log.warning("num_problems %s is not positive; taking all", num_problems)
        return df
    return first_rows(df, order_col, num_problems)
