"""Dense row numbers without a global window, and the deterministic split built on them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction
from itertools import accumulate
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.sources.store import materialize

TRAIN, VALIDATION, TEST = "train", "validation", "test"

#: First rows among which a float pattern has to recur.
_FLOAT_ROWS = 20_000
#: Earlier numbers of a row that are spelled out, and numbers of a block.
_UNROLLED, _BLOCK = 8, 1024
#: Keys in the sample that places a cut, about.
_SAMPLE = 50_000


def _sorted_parts(df: DataFrame, order_col: str, parts: int, name: str) -> DataFrame:
    """``df`` in ranges of the whole order value, written sorted; ``name`` holds range and place of a row.

    Rows without an order value come last; those, and rows of equal order values, go by a hash of their
    contents and may spread over several ranges too.
    """
    hashed = F.xxhash64(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])
    order = [F.col(order_col).asc_nulls_last(), F.col("_hash").asc()]
    ranged = df.withColumn("_hash", hashed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.drop("_hash").withColumn(name, F.monotonically_increasing_id()), "numbered", compression="zstd")


def dense_index(
    df: DataFrame, order_col: str, name: str = "idx", buckets: int | None = None
) -> DataFrame:
    """Number rows 0, 1, 2, ... by a unique order column of any type that Spark sorts.

    Rows without an order value come last, in a fixed order of their contents. Rows are spread by
    ranges of the whole order value, sampled by Spark, so keys with a common beginning spread like any
    others. The sorted ranges are written once, since a number must not change when a task is repeated;
    the driver sees one count per range, whose number is set by the shuffle partitions and not by the data.
    """
    spark = df.sparkSession
    parts = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = _sorted_parts(df, order_col, parts, "_at")
    part = F.shiftright("_at", 33)
    sizes = dict(placed.groupBy(part.alias("part")).count().collect())
    starts = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)), initial=0))
    start = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), part.cast("int"))
    return placed.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def first_rows(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """The ``n`` first rows by a unique order column; those without an order value come last.

    A sample of bounded size gives a cut with more than ``n`` rows up to it, which is counted, so only
    these are shuffled and sorted, whatever ``n``. A cut that the sample placed too low is raised.
    """
    keys = df.select(order_col)
    rows = keys.count()
    if n >= rows:
        return df
    share = min(1.0, _SAMPLE / rows)
    sample = keys.where(F.col(order_col).isNotNull()).sample(share, seed=7)
    wanted = int(n * share + 5 * (n * share) ** 0.5 + 10)
    while wanted < rows * share:
        cut = sample.orderBy(order_col).limit(wanted).agg(F.max(order_col).alias("cut"), F.count("*").alias("n")).first()
        if cut["n"] < wanted:
            break
        below = F.col(order_col) <= F.lit(cut["cut"])
        if keys.where(below).count() >= n:
            df = df.where(below)
            break
        wanted *= 2
    return dense_index(df, order_col, name="_row").where(F.col("_row") < n).drop("_row")


def batch_index(index: Column, batch_size: int) -> Column:
    """Batch number of a dense 0-based index."""
    return F.floor(index / F.lit(batch_size)).cast("long")


def _check(val_fraction: float, test_fraction: float) -> None:
    if not (0.0 <= val_fraction < 1.0 and 0.0 <= test_fraction < 1.0):
        raise ValueError("each fraction must lie in [0, 1)")
    if val_fraction + test_fraction >= 1.0:
        raise ValueError("the two fractions must add up to less than 1")


def _owed(number: Column, fraction: Fraction) -> Column:
    """Whole part of ``number * fraction``, in 64 bits where they do and else in 38 digits."""
    top, bottom = fraction.numerator, fraction.denominator
    if not top or fraction < Fraction(1, 10**19):
        return F.lit(0).cast("long")  # less than one row of as many as a 64-bit number counts
    if top < 1 << 24 and bottom < 1 << 62:
        return F.call_function("div", number * F.lit(top).cast("long"), F.lit(bottom).cast("long"))
    product = number.cast("decimal(20,0)") * F.lit(Decimal(top)).cast("decimal(18,0)")
    return F.call_function("div", product, F.lit(Decimal(bottom)).cast("decimal(38,0)"))


def _exact_split(df: DataFrame, index: str, val: Fraction, test: Fraction) -> DataFrame:
    """The split of each row number, from whole numbers alone.

    Row ``i`` (from 1) is validation when the validation rows owed up to it, ``floor(i * val)``, grow at
    ``i``. Let ``f(j)`` be the rows owed to both less ``j``. A row that is not validation is test when
    ``f(i)`` is not below every earlier ``f``, for then a test row is still owed. As ``f(j)`` lies within 2
    of ``j * (val + test - 1)``, only the last ``2 / (1 - val - test) + 1`` rows matter to the minimum.
    Few are read in the row itself; beyond that, minima over blocks of numbers are joined.
    """
    def f(j: Column) -> Column:
        return _owed(j, val) + _owed(j, test) - j

    def least(first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(2**62), lambda low, j: F.least(low, f(j)))

    i = F.col(index).cast("long") + 1
    reach = ceil(2 / (1 - val - test)) + 1
    if reach <= _UNROLLED:
        early = F.least(F.lit(0), *[f(F.greatest(i - k, F.lit(0))) for k in range(1, reach + 1)])
        numbered = df
    elif reach <= _BLOCK:
        early, numbered = least(F.greatest(i - reach, F.lit(0)), i - 1), df
    else:
        block = F.floor(i / _BLOCK).cast("long")
        numbered = df.withColumn("_block", block).join(_least_before(df, index, least), "_block", "left")
        # The first number of a block stands for none before it: its own minimum is that of earlier blocks.
        inside = F.when(i % _BLOCK > 0, least(F.col("_block") * _BLOCK, i - 1))
        early = F.least(F.coalesce("_least", F.lit(0)), F.coalesce(inside, F.lit(2**62)))
    validation = _owed(i, val) > _owed(i - 1, val)
    split = F.when(i.isNull(), None).when(validation, VALIDATION).when(f(i) >= early, TEST).otherwise(TRAIN)
    return numbered.withColumn("split", split).drop("_block", "_least")


def _least_before(df: DataFrame, index: str, least: Callable[[Column, Column], Column]) -> DataFrame:
    """``_block, _least``: the minimum over all numbers before each block, by two levels of blocks."""
    last = df.agg(F.max(index)).first()[0] or 0
    blocks = df.sparkSession.range((last + 1) // _BLOCK + 1).select(
        F.col("id").alias("_block"), F.floor(F.col("id") / _BLOCK).alias("_wide"),
        least(F.col("id") * _BLOCK, (F.col("id") + 1) * _BLOCK - 1).alias("_own"))
    earlier = Window.orderBy("_wide").rowsBetween(Window.unboundedPreceding, -1)
    wide = blocks.groupBy("_wide").agg(F.min("_own").alias("_own")).select("_wide", F.min("_own").over(earlier).alias("_outer"))
    within = Window.partitionBy("_wide").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_inner", F.min("_own").over(within)).join(wide, "_wide").select(
        "_block", F.least("_outer", "_inner").alias("_least"))


def _replay(val: float, test: float, state: tuple[float, float], rows: int):
    """Binary floating-point accumulators: yields each row's split and the state after it.

    The order of the additions and subtractions decides the last bit, so it is fixed.
    """
    owed_val, owed_test = state
    for _ in range(rows):
        owed_val, owed_test = owed_val + val, owed_test + test
        if owed_val >= 1.0:
            owed_val, split = owed_val - 1.0, VALIDATION
        elif owed_test >= 1.0:
            owed_test, split = owed_test - 1.0, TEST
        else:
            split = TRAIN
        yield split, (owed_val, owed_test)


def float_pattern(val: float, test: float) -> tuple[int, list[str]] | None:
    """Row from which binary accumulation repeats itself and the rows up to its first repeat.

    None when no state recurs among the first rows, as for 0.05.
    """
    seen, pattern, state = {(0.0, 0.0): 0}, [], (0.0, 0.0)
    for split, state in _replay(val, test, state, _FLOAT_ROWS):
        pattern.append(split)
        if state in seen:
            return seen[state], pattern
        seen[state] = len(pattern)
    return None


def _by_pattern(df: DataFrame, index: str, start: int, pattern: list[str]) -> DataFrame:
    """Assign splits from a pattern that repeats from row ``start`` on, one byte per row of it."""
    row, period = F.col(index), len(pattern) - start
    slot = F.when(row < start, row).otherwise(start + (row - start) % period)
    letters = {name: name[1].encode() for name in (TRAIN, VALIDATION, TEST)}
    table = F.lit(bytearray(b"".join(letters[name] for name in pattern)))
    letter = F.substring(table, (slot + 1).cast("int"), F.lit(1))
    split = F.coalesce(*[F.when(letter == F.lit(bytearray(code)), name) for name, code in letters.items()])
    return df.withColumn("split", split)


def deterministic_split(
    df: DataFrame,
    index: str = "idx",
    val_fraction: float = 0.10,
    test_fraction: float = 0.10,
    mode: str = "exact",
) -> DataFrame:
    """Add ``split`` by row number alone, ``index`` counting rows from 0; null where the number is.

    ``mode="exact"`` treats 0.1 as one tenth and takes any fractions, without a shuffle unless they leave
    less than one row in 500 to train. ``mode="float"`` repeats binary accumulation,
    where ten additions of 0.1 stay below 1, for parity with files split that way earlier. It takes
    fractions whose sums recur, as the defaults do after eleven rows, and names those that do not.
    """
    _check(val_fraction, test_fraction)
    if mode == "exact":
        val, test = Fraction(str(val_fraction)), Fraction(str(test_fraction))
        if val + test >= 1:
            raise ValueError("the two fractions must add up to less than 1")
        return _exact_split(df, index, val, test)
    if mode != "float":
        raise ValueError(f"unknown mode {mode!r}")
    found = float_pattern(val_fraction, test_fraction)
    if found is None:
        raise ValueError(f"binary sums of {val_fraction} and {test_fraction} do not recur; use mode='exact'")
    return _by_pattern(df, index, *found)


def split_counts(df: DataFrame) -> DataFrame:
    """Rows and share of every split name; rows without one are left out, an empty input gives no rows."""
    counts = df.filter(F.col("split").isNotNull()).groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count("split")).scalar()
    return counts.select("split", "n", (F.col("n") / total).alias("share"))
