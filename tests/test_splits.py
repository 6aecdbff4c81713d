from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from signalbox.operators import splits

PAIRS = [(0.1, 0.1), (0.33, 0.33), (0.25, 0.5), (0.0, 0.3), (0.3, 0.0), (0.05, 0.15), (0.123, 0.45), (0.5, 0.49)]


def replay(val, test, rows):
    """Row-by-row credits; exact with fractions, binary with floats."""
    out, v, t = [], val * 0, test * 0
    for _ in range(rows):
        v, t = v + val, t + test
        if v >= 1:
            out.append("validation")
            v -= 1
        elif t >= 1:
            out.append("test")
            t -= 1
        else:
            out.append("train")
    return out


def assigned(df):
    return [r.split for r in df.orderBy("idx").collect()]


@pytest.mark.parametrize(("val", "test"), PAIRS)
def test_exact_split(spark, val, test):
    got = assigned(splits.deterministic_split(spark.range(3000).withColumnRenamed("id", "idx"), "idx", val, test))
    assert got == replay(Fraction(str(val)), Fraction(str(test)), 3000)


@pytest.mark.parametrize(("val", "test"), [
    (0.123457, 0.1), (0.12347, 0.20001), (0.12345671, 0.1), (0.1234567890123457, 0.30000000000000004), (0.0001, 0.9998),
    (0.499999, 0.5), (1e-30, 0.1), (0.3333333333333, 0.6666666666665), (2.5e-17, 0.25), (0.0, 0.99999)])
def test_exact_split_of_any_fractions(spark, monkeypatch, val, test):
    # Blocks of 32 numbers, so that the last pairs go through several blocks of blocks.
    monkeypatch.setattr(splits, "_BLOCK", 32)
    df = spark.range(0, 6000, 1, 3).withColumnRenamed("id", "idx")
    assert assigned(splits.deterministic_split(df, "idx", val, test)) == replay(Fraction(str(val)), Fraction(str(test)), 6000)


def test_exact_split_far_from_the_start_and_without_a_number(spark):
    df = spark.createDataFrame([(i,) for i in range(9_000, 9_100)] + [(None,)], "idx long")
    for val, test in ((0.123457, 0.1), (0.5, 0.4999)):
        plain = replay(Fraction(str(val)), Fraction(str(test)), 9_100)[9_000:]
        found = {r.idx: r.split for r in splits.deterministic_split(df, "idx", val, test).collect()}
        assert found.pop(None) is None and [found[i] for i in range(9_000, 9_100)] == plain


def test_exact_split_needs_no_shuffle(spark):
    plan = splits.deterministic_split(spark.range(9).withColumnRenamed("id", "idx"), "idx", 0.123457, 0.1)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_fractions_that_do_not_recur_are_named(spark):
    df = spark.range(5).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError, match="0.05"):
        splits.deterministic_split(df, "idx", 0.1, 0.05, mode="float")


@pytest.mark.parametrize(("val", "test"), [(0.1, 0.1), (0.25, 0.5), (0.0, 0.0)])
def test_float_split_by_pattern(spark, val, test):
    assert splits.float_pattern(val, test) is not None
    df = spark.range(2000).withColumnRenamed("id", "idx")
    assert assigned(splits.deterministic_split(df, "idx", val, test, mode="float")) == replay(val, test, 2000)


def test_default_first_validation_row(spark):
    df = spark.range(30).withColumnRenamed("id", "idx")
    assert assigned(splits.deterministic_split(df)).index("validation") == 9


@pytest.mark.parametrize(("val", "test"), [(1.0, 0.0), (-0.1, 0.2), (0.5, 0.5)])
def test_bad_fractions(spark, val, test):
    with pytest.raises(ValueError):
        splits.deterministic_split(spark.range(1).withColumnRenamed("id", "idx"), "idx", val, test)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_dense_index_on_uneven_keys(spark, buckets):
    keys = [*range(0, 900), *range(10**12, 10**12 + 90, 3), -5, 10**15]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k long")
    rows = splits.dense_index(df, "k", buckets=buckets).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(keys)))
    assert [r.k for r in rows] == sorted(keys)


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "decimal(20,3)", "double"])
def test_dense_index_of_other_types_with_missing_values(spark, kind):
    value = f"date_add(date'2020-01-01', cast(id * 37 % 101 as int))" if kind in ("date", "timestamp") else "id * 37 % 101"
    df = spark.range(101).selectExpr("id", f"cast({value} as {kind}) as k").union(spark.range(200, 207).selectExpr("id", f"cast(null as {kind}) as k"))
    rows = splits.dense_index(df, "k", buckets=5).orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(108))
    assert [r.k for r in rows[:101]] == sorted(r.k for r in rows[:101]) and {r.id for r in rows[101:]} == set(range(200, 207))
    again = splits.dense_index(df.repartition(3), "k", buckets=5).orderBy("idx").collect()
    assert [r.id for r in again] == [r.id for r in rows]


def test_dense_index_spreads_keys_with_a_common_beginning(spark):
    df = spark.range(40_000).selectExpr("concat('question-00000000', lpad(id * 7919 % 40000, 6, '0')) as k", "id")
    placed = splits._sorted_parts(df, "k", 8, "at").selectExpr("shiftright(at, 33) as part", "k")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
    rows = splits.dense_index(df, "k", buckets=8).selectExpr("idx = cast(right(k, 6) as long) as same").groupBy("same").count().collect()
    assert [tuple(r) for r in rows] == [(True, 40_000)]


def test_dense_index_of_equal_and_missing_keys_spreads_them(spark):
    df = spark.range(20_000).selectExpr("cast(null as string) as k", "id").union(spark.range(20_000).selectExpr("'same' as k", "id + 20000"))
    placed = splits._sorted_parts(df, "k", 8, "at").selectExpr("shiftright(at, 33) as part")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("n", [1, 10, 999, 3000, 49_990, 50_000, 50_001])
def test_first_rows_sort_only_what_lies_below_a_cut(spark, monkeypatch, n):
    monkeypatch.setattr(splits, "_SAMPLE", 2_000)
    sorted_rows = []
    index = splits.dense_index
    monkeypatch.setattr(splits, "dense_index", lambda df, *a, **k: sorted_rows.append(df.count()) or index(df, *a, **k))
    df = spark.range(50_000).selectExpr("concat('question-', lpad(id * 7919 % 50000, 6, '0')) as k", "id")
    found = splits.first_rows(df, "k", n)
    assert sorted(r.k for r in found.select("k").collect()) == [f"question-{i:06d}" for i in range(min(n, 50_000))]
    if n < 4000:
        assert n <= sorted_rows[0] <= 2 * n + 1500


def test_first_rows_with_missing_keys_and_a_bad_sample(spark, monkeypatch):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, id) as k", "id")
    assert sorted(r.k for r in splits.first_rows(df, "k", 5).collect()) == [1, 2, 4, 5, 7]
    rows = splits.first_rows(df, "k", 250).collect()
    assert len(rows) == 250 and sum(r.k is not None for r in rows) == 200
    assert splits.first_rows(df.limit(0), "k", 5).count() == 0
    # A sample far too dense at the low end has its cut raised.
    monkeypatch.setattr(splits, "_SAMPLE", 150)
    skewed = spark.range(30_000).selectExpr("id div 2 as k")
    monkeypatch.setattr(type(df), "sample", lambda self, *a, **k: self.where("k < 200"))
    assert sorted(r.k for r in splits.first_rows(skewed, "k", 1000).collect()) == [i // 2 for i in range(1000)]


def test_dense_index_of_nothing(spark):
    assert splits.dense_index(spark.range(0), "id").count() == 0


def test_split_counts(spark):
    df = splits.deterministic_split(spark.range(100).withColumnRenamed("id", "idx"))
    counts = {r.split: (r.n, r.share) for r in splits.split_counts(df).collect()}
    assert counts == {"train": (81, 0.81), "validation": (10, 0.1), "test": (9, 0.09)}
    assert splits.split_counts(df.limit(0)).count() == 0
    own = spark.createDataFrame([("train",), ("val",), ("val",), (None,), ("dev",)], "split string")
    assert {(r.split, r.n, r.share) for r in splits.split_counts(own).collect()} == {("train", 1, 0.25), ("val", 2, 0.5), ("dev", 1, 0.25)}


def test_batch_index(spark):
    out = spark.range(7).select(splits.batch_index(F.col("id"), 3).alias("b")).collect()
    assert [r.b for r in out] == [0, 0, 0, 1, 1, 1, 2]
