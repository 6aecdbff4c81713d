from __future__ import annotations

import random

from pyspark.sql import functions as F

from signalbox.operators import metrics, publish, resume

SCHEMA = "unique_id string, responses array<struct<full_response:string>>"
GRADED = "unique_id string, responses array<struct<full_response:string,extracted_answer:string,is_correct:boolean,extraction_method:string,judge_explanation:string>>"


def bad(text):
    return text.startswith("Error generating response:") or not text.strip()


def nested(spark, data):
    return spark.createDataFrame([(k, [(t,) for t in v]) for k, v in data.items()], SCHEMA)


def samples(seed, count=120):
    rng = random.Random(seed)
    texts = ["good", "fine", "", " \n", "Error generating response: x"]
    return {f"q{i}": [rng.choice(texts) + ("" if rng.random() < 0.9 else "!") for _ in range(rng.randint(0, 5))] for i in range(count)}


def plain_merge(old, new, k):
    good = [t for t in old if not bad(t)]
    if len(good) < k:
        return good + new
    fresh = iter(new)
    return [next(fresh, t) if bad(t) else t for t in old]


def test_merge(spark):
    old, new = samples(1), samples(2)
    new["extra"] = ["only new"]
    for k in (1, 2, 4):
        rows = resume.retry_merge(nested(spark, old), nested(spark, new), k).collect()
        got = {r.unique_id: [x.full_response for x in r.responses] for r in rows}
        want = {q: plain_merge(old[q], t, k) if q in old else t for q, t in new.items()}
        assert got == want


def test_status(spark):
    data = samples(3)
    data[""] = ["skipped"]
    got = {r.unique_id: (r.failed_slots, r.status) for r in resume.response_status(nested(spark, data)).collect()}
    for q, texts in data.items():
        if not q:
            assert q not in got
            continue
        slots = [i for i, t in enumerate(texts) if bad(t)]
        state = "fully_failed" if len(slots) == len(texts) else "partially_failed" if slots else "ok"
        assert got[q] == (slots, state)


def test_selective_status(spark):
    data = samples(4)
    rows = resume.response_status_selective(nested(spark, data), k=3).collect()
    for r in rows:
        texts = data[r.unique_id]
        slots = [i for i, t in enumerate(texts) if bad(t)] + list(range(len(texts), 3))
        assert r.failed_slots == slots
        assert r.status == ("fully_failed" if len(slots) == 3 else "partially_failed" if slots else "ok")


def test_plan_and_counters(spark):
    known = {"a": ["good"], "b": [""], "c": ["good", ""], "z": []}
    status = resume.response_status(nested(spark, known))
    dataset = resume.with_default_id(
        spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, None)], "idx long, unique_id string")
    )
    fresh = resume.resume_plan(dataset, status, retry_failed=False)
    assert {(r.unique_id, r.reason) for r in fresh.collect()} == {("d", "new"), ("q4", "new")}
    retry = {r.unique_id: (r.reason, r.retry_slots) for r in resume.resume_plan(dataset, status, True, k=2).collect()}
    assert retry == {
        "b": ("fully_failed", [0, 1]), "c": ("partially_failed", [1]), "d": ("new", [0, 1]), "q4": ("new", [0, 1]),
    }
    assert tuple(resume.resume_counters(status, k=2).first()) == (2, 2, 1, 5)
    assert resume.selective_resume(dataset, status, False).count() == 5
    assert {r.unique_id for r in resume.selective_resume(dataset, status, True).collect()} == {"b", "c"}


def graded(spark, data):
    rows = [(q, [("t", "a", ok, m, why) for ok, m, why in rs]) for q, rs in data.items()]
    return spark.createDataFrame(rows, GRADED)


def test_weak_failures_keep_correct_first(spark):
    no, yes = (False, "math_verify", None), (True, "math_verify", None)
    data = {"a": [no, no, yes], "b": [no, no], "c": [no, yes], "d": [], "": [no]}
    failed = {k: {r.unique_id: r.failure_rate for r in resume.weak_failures(graded(spark, data), 0.5, k).collect()} for k in (1, 3)}
    assert failed[1] == {"b": 1.0}
    assert set(failed[3]) == {"a", "b"}
    assert resume.weak_failures(graded(spark, data), 0.4, 2).count() == 3


def test_topk_and_dedup(spark):
    rows = [("q", i, ok) for i, ok in enumerate([False, True, False, True])]
    df = spark.createDataFrame(rows, "unique_id string, response_idx int, is_correct boolean")
    assert [r.response_idx for r in resume.topk_responses(df, 3).orderBy("rank").collect()] == [1, 3, 0]
    assert resume.dedup_last(df, "unique_id", "response_idx").first().response_idx == 3


def test_upsert(spark):
    old, new = nested(spark, {"a": ["1"], "b": ["2"]}), nested(spark, {"b": ["3"], "c": ["4"]})
    got = {r.unique_id: r.responses[0].full_response for r in resume.upsert(old, new).collect()}
    assert got == {"a": "1", "b": "3", "c": "4"}


def test_publish_pads_and_counts(spark):
    data = {
        "a": [(True, "math_verify", None), (False, "llm_judge", "why")],
        "b": [],
        "c": [(None, None, None), (True, "llm_judge", "x" * 300), (False, "llm_judge", "")],
    }
    base = graded(spark, data)
    for name, kind in (("problem", "string"), ("is_mcq", "boolean"), ("choices", "array<string>"), ("choice_index_correct", "int"),
                       ("explanation_correct", "string"), ("answer_correct", "string"), ("category", "string")):
        base = base.withColumn(name, F.lit(None).cast(kind))
    wide = {r.unique_id: r.asDict(recursive=True) for r in publish.publish_wide(base).collect()}
    assert publish.max_responses(base) == 3
    assert (wide["a"]["response_3"], wide["a"]["is_correct_3"], wide["a"]["extraction_method_3"]) == ("", False, "")
    assert wide["c"]["extraction_method_1"] == "unknown" and wide["c"]["is_correct_1"] is False
    assert wide["c"]["extraction_method_counts"] == {"unknown": 1, "llm_judge": 2}
    assert (wide["c"]["llm_judge_count"], wide["c"]["llm_judge_accuracy"], wide["c"]["accuracy"]) == (2, 0.5, 1 / 3)
    assert (wide["b"]["total_responses"], wide["b"]["accuracy"], wide["b"]["extraction_method_counts"]) == (0, 0.0, {})
    splits = publish.publish_splits({"train": base.filter("unique_id = 'a'"), "val": base.filter("unique_id <> 'a'")})
    assert {r.unique_id: r.split for r in splits.collect()} == {"a": "train", "b": "validation", "c": "validation"}
    assert "response_3" in splits.columns
    previews = publish.judge_used(base).collect()
    assert sorted(len(r.explanation) for r in previews) == [0, 3, 200]


def test_question_accuracy_without_responses(spark):
    row = metrics.question_accuracy(graded(spark, {"b": []}), "think").first()
    assert (row.think_correct_count, row.think_total_count, row.think_accuracy) == (0, 0, None)


def test_metrics_on_empty_input(spark):
    empty = spark.createDataFrame([], "category string, response_idx int, is_correct boolean, extraction_method string")
    assert tuple(metrics.overall_accuracy(empty).first()) == (0, 0, 0.0)
    lone = spark.createDataFrame([("c", None, None, None)], empty.schema)
    assert tuple(metrics.accuracy_by_category(lone).first()) == ("c", 1, 0, 0, 0.0)
    assert metrics.accuracy_by_method(lone).count() == 0


def test_upsert_joins_ids_alone_and_keeps_rows_that_share_a_bit(spark, tmp_path, monkeypatch):
    from signalbox.operators import resume
    from signalbox.sources import store as stores

    monkeypatch.setattr(resume, "_ID_BITS", 16)
    old = spark.createDataFrame([(f"q{i}", f"old {i}") for i in range(60)] + [("q7", "twice"), (None, "none")], "unique_id string, problem string")
    new = spark.createDataFrame([(f"q{i}", f"new {i}") for i in range(0, 40, 5)] + [(None, "fresh")], old.schema)
    stayed = [("new" if i < 40 and i % 5 == 0 else "old") + f" {i}" for i in range(60)] + ["twice", "none", "fresh"]
    anti = resume.untouched(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in anti and "problem" not in anti[anti.index("LeftAnti"):].split("\n", 2)[1]
    store = stores.ResultStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.parquet.compression.codec", "snappy")
    try:
        store.replace(old)
        monkeypatch.setattr(stores, "materialize", None)  # fresh rows are not written aside when their ids are stored
        found = store.upsert(new, new.select("unique_id")).collect()
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    assert sorted(r.problem for r in found) == sorted(stayed)
    assert {p.name.split(".", 1)[1] for p in (tmp_path / "store" / "data").rglob("part-*")} == {"c000.zstd.parquet"}


def test_questions_without_a_status_are_planned_without_a_join(spark, monkeypatch):
    from signalbox.operators import resume

    monkeypatch.setattr(resume, "_ID_BITS", 16)
    data = spark.createDataFrame([(f"q{i}", f"text {i}") for i in range(40)] + [("q3", "twice"), (None, "none")], "unique_id string, problem string")
    kinds = [resume.OK, resume.FULLY_FAILED, resume.PARTIALLY_FAILED]
    status = spark.createDataFrame([(f"q{i}", kinds[i % 3], [1] if i % 3 else []) for i in range(20)], "unique_id string, status string, failed_slots array<int>")
    for retry in (True, False):
        plan = resume.resume_plan(data, status, retry, 2)
        assert plan.columns == ["unique_id", "problem", "reason", "retry_slots"]
        found = sorted((r.problem, r.reason, r.retry_slots) for r in plan.collect())
        ids = [*range(40), 3]
        texts = [f"text {i}" for i in range(40)] + ["twice"]
        wanted = [(t, kinds[i % 3] if i < 20 else resume.NEW, [1] if i < 20 and i % 3 == 2 else [0, 1]) for i, t in zip(ids, texts) if i >= 20 or retry and i % 3]
        assert found == sorted([*wanted, ("none", resume.NEW, [0, 1])])
    monkeypatch.undo()
    tree = resume.resume_plan(data, status.limit(0), True, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert tree.startswith("Union")
