"""Every registered query against its SQL, and checks on the plans."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as contract
from signalbox.plans import catalog, views
from signalbox.operators import grading, history, metrics, resume
from tests.compare import connect, differences

SF_DIR = os.environ.get("SIGNALBOX_TEST_SF", "/root/testdata/sf0.001")
QUERIES = {name: run for name, run in contract.queries().items() if name in catalog.QUERIES}
SQL = catalog.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


_BUILT: dict = {}


def built(spark, name):
    """Frame of a query; those that store data while being built do so once."""
    if name not in _BUILT:
        _BUILT[name] = QUERIES[name](spark, SF_DIR)
    return _BUILT[name]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = built(spark, name)
    if name in SQL:
        assert differences(df, duck, SQL[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module", autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df) -> str:
    """Physical plan as planned, also for a frame that has already run."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


# Stages in which user Python runs by design.
PYTHON_STAGES = {
    "grade_three_phase", "grade_with_fallback", "verify_algebra", "judge_stage", "generate_k", "drop_failed", "score_prompts_callable", "win_rate_scores",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_cross_join_and_no_row_python(spark, name):
    text = plan(built(spark, name))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    if name not in PYTHON_STAGES:
        assert "Python" not in text and "InPandas" not in text


def test_grading_by_category_shuffles_only_groups(spark):
    text = plan(built(spark, "accuracy_by_category"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert "text" not in schema.split(",")[0] and "text:" not in schema
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_graded_table_is_read_by_nested_field(spark):
    results = views.stored_results(spark, SF_DIR)
    text = plan(metrics.question_accuracy(results.select("unique_id", "responses"), "think"))
    assert "ReadSchema: struct<unique_id:string,responses:array<struct<is_correct:boolean>>>" in text
    assert "Exchange" not in text


def test_rank_filters_apply_before_the_shuffle(spark):
    rows = grading.explode_responses(views.stored_results(spark, SF_DIR), ["unique_id", "responses"])
    docs = views.table(spark, SF_DIR, "documents")
    recent = history.recent_pairs(history.turn_pairs(views.conversations(spark, SF_DIR)), 3)
    for df in (resume.topk_responses(rows, 2), resume.dedup_last(docs, "source", "doc_id")):
        text = plan(df)
        assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
    assert "WindowGroupLimit" in plan(recent)


def test_publishing_and_status_are_narrow(spark):
    assert "Exchange" not in plan(built(spark, "publish_wide"))
    assert "Exchange" not in plan(built(spark, "response_status"))


def test_three_phases_read_and_grade_once(spark):
    text = plan(built(spark, "grade_three_phase"))
    assert "Union" not in text and "Join" not in text and "Exchange" not in text
    assert len(re.findall(r"FileScan parquet", text)) == 1


def test_statistics_never_read_the_response_texts(spark):
    for name in ("average_accuracy", "method_counts", "weak_failures", "topk_responses", "accuracy_by_model", "judge_used"):
        schema = re.search(r"ReadSchema: (\S+)", plan(built(spark, name)))[1]
        assert "full_response" not in schema, name


def test_running_totals_never_gather_a_whole_key(spark):
    """Rows with text shuffle by key and block; only partial sums meet by key."""
    text = plan(history.turn_pairs(views.conversations(spark, SF_DIR)))
    window = text.index("Window [sum(_v_pair_id")
    exchange = text[window:].split("Exchange hashpartitioning(")[1].split(")")[0]
    assert "conv_id" in exchange and "_block" in exchange
