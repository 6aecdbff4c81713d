from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalbox.functions.encoding import canonical_json, with_unique_id
from signalbox.operators import ingest
from signalbox.schemas import QUESTION
from signalbox.sources.banks import limit_questions

RECORD = st.fixed_dictionaries({
    "question": st.text(st.characters(blacklist_categories=["Cs"]), max_size=12),
    "category": st.one_of(st.none(), st.sampled_from(['a"b', "x\\y", "\\u000B", "\x0b\x1f\x00", "é/ "])),
    "choices": st.one_of(st.none(), st.lists(st.text(max_size=4).filter(lambda t: t.isprintable()), max_size=3)),
    "choice_index_correct": st.one_of(st.none(), st.integers(0, 9)),
    "explanation_correct": st.none(),
    "answer_correct": st.text(st.characters(max_codepoint=127), max_size=6),
})
FIELDS = QUESTION.fields[1:]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(RECORD, min_size=50, max_size=60))
def test_hash_equals_canonical_json_hash(spark, records):
    schema = type(QUESTION)(FIELDS)
    df = spark.createDataFrame([tuple(r[f.name] for f in FIELDS) for r in records], schema)
    rows = df.select(canonical_json(df).alias("j")).collect()
    expected = [json.dumps(r, sort_keys=True, ensure_ascii=False) for r in records]
    assert sorted(r.j for r in rows) == sorted(expected)
    ids = {r.unique_id for r in with_unique_id(df).collect()}
    assert ids == {hashlib.md5(e.encode()).hexdigest() for e in expected}


def test_hash_refuses_an_existing_id(spark):
    with pytest.raises(ValueError):
        with_unique_id(spark.createDataFrame([("a", "b")], "unique_id string, question string"))


def test_banks(spark):
    year = spark.createDataFrame(
        [(1, 1990, None, "q", 7), (2, 2001, "II", "r", 12)], "ID int, Year int, Part string, Question string, Answer int"
    )
    rows = ingest.from_year_part_bank(year).orderBy("question").collect()
    assert [(r.category, r.answer_correct, r.choices) for r in rows] == [
        ("AIME_1990", "7", None), ("AIME_2001_Part_II", "12", None),
    ]
    mcq = spark.createDataFrame([("q", "c", ["x", "y"], 1)], "question string, category string, options array<string>, answer_index int")
    assert ingest.from_choice_bank(mcq).first().answer_correct == "y"
    rl = spark.createDataFrame([("q", None, 3)], "problem string, source string, answer int")
    assert ingest.from_source_bank(rl).first().category == "Unknown"


def test_quality_gate(spark):
    df = spark.createDataFrame([("a", 1.0), ("", None)], "t string, v double")
    assert tuple(ingest.quality_check(df).first()) == (True, True)
    assert tuple(ingest.quality_check(df, ["v"]).first()) == (False, True)
    assert tuple(ingest.quality_check(df, ["v", "t"]).first()) == (False, False)
    assert tuple(ingest.quality_check(df.limit(0)).first()) == (False, False)
    with pytest.raises(ValueError):
        ingest.require_clean(df)
    nan = spark.createDataFrame([("a", float("nan"))], "t string, v double")
    assert ingest.quality_check(nan).first().has_missing


def test_combine_refuses_bad_ids(spark):
    def bank(*ids):
        return spark.createDataFrame([(i, "q") for i in ids], "unique_id string, question string")

    assert ingest.combine_banks([bank("a", "b"), bank("c")]).count() == 3
    with pytest.raises(ValueError):
        ingest.combine_banks([bank("a", "b"), bank("a")])
    with pytest.raises(KeyError):
        ingest.combine_banks([bank("a"), bank(None)])
    check = ingest.combine_check(ingest.union_banks([bank("a"), bank("a", "b")])).first()
    assert (check.records, check.unique_ids, check.consistent) == (3, 2, False)


def test_mcq_violations(spark):
    rows = [("q", "c", ["x", "y"], 1, None, "y"), ("r", "c", ["x"], 0, None, "z"), ("s", "c", ["x"], 5, None, "x"), ("t", "c", None, None, None, "n")]
    df = spark.createDataFrame(rows, type(QUESTION)(FIELDS))
    assert sorted(r.question for r in ingest.mcq_violations(df).collect()) == ["r", "s"]


def test_limit(spark):
    df = spark.range(50).select((F.lit(100) - F.col("id")).alias("n"))
    want = list(range(51, 61))
    assert sorted(r.n for r in limit_questions(df, 10, "n").collect()) == want
    texts = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "t string")
    assert sorted(r.t for r in limit_questions(texts, 3, "t").collect()) == ["a", "b", "c"]
    assert limit_questions(texts, 4, "t").count() == 4
    assert limit_questions(df, "ALL", "n").count() == limit_questions(df, -1, "n").count() == 50
    many = spark.range(250_000).selectExpr("if(id % 50000 = 7, null, id) as n")
    for limit in (99_999, 100_000, 100_001, 249_998):
        rows = limit_questions(many, limit, "n").selectExpr("count(*) as n", "count(n) as known", "max(n) as top").first()
        assert rows.n == limit and rows.known == min(limit, 249_995)
    with pytest.raises(ValueError):
        limit_questions(df, "ten", "n")
