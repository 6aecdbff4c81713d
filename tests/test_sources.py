from __future__ import annotations

import base64
import json

import pytest
from pyspark.sql import functions as F

from signalbox.operators import evaluation
from signalbox.plans.jobs import grade_directory_job
from signalbox.schemas import PREDICTION_WITH_ID, PREDICTION_WITH_INDEX, QUESTION, RAW_RESULT
from signalbox.sources import images, jsonl, predictions
from signalbox.operators import resume
from signalbox.sources.store import BatchLog, ResultStore, matching_paths, materialize, write_result_layout

GOOD = {"unique_id": "a", "problem": "é?", "is_mcq": False, "category": "c", "responses": [{"full_response": "x"}]}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_strict_scan_skips_blank_and_stops_on_bad(spark, tmp_path):
    ok = lines(tmp_path / "ok.jsonl", GOOD, "", "   ", {**GOOD, "unique_id": "b"})
    rows = jsonl.read_strict(spark, ok, RAW_RESULT).orderBy("unique_id").collect()
    assert [r.unique_id for r in rows] == ["a", "b"] and rows[0].problem == "é?" and rows[0].choices is None
    bad = lines(tmp_path / "bad.jsonl", GOOD, "{broken")
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_strict(spark, bad, RAW_RESULT).collect()


def test_tolerant_scan_reports_bad_lines(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", GOOD, "{broken", "", {**GOOD, "unique_id": "b"})
    good, rejected = jsonl.read_tolerant(spark, path, RAW_RESULT)
    assert sorted(r.unique_id for r in good.collect()) == ["a", "b"]
    assert [r.line for r in rejected.collect()] == ["{broken"]


def test_directory_scan_takes_the_model_from_the_file_name(spark, tmp_path):
    for name in ("m1_train.jsonl", "m1_test.jsonl", "m2.jsonl", "notes.txt"):
        lines(tmp_path / name, GOOD)
    rows = jsonl.read_results_directory(spark, str(tmp_path), RAW_RESULT)
    assert sorted((r.model, r.file) for r in rows.collect()) == [
        ("m1", "m1_test.jsonl"), ("m1", "m1_train.jsonl"), ("m2.jsonl", "m2.jsonl"),
    ]
    assert [tuple(r) for r in jsonl.model_collisions(rows).collect()] == [("m1", 2)]


def test_directory_of_folders_files_and_odd_names(spark, tmp_path):
    lines(tmp_path / "a b+%41_x.jsonl", GOOD)
    rows = spark.createDataFrame([("a", "p", "m1"), ("b", "q", "m 2")], "unique_id string, problem string, model string")
    jsonl.write_results_directory(rows, str(tmp_path), "run")
    found = jsonl.read_results_directory(spark, str(tmp_path), RAW_RESULT)
    assert sorted((r.model, r.file, r.unique_id) for r in found.collect()) == [
        ("a b+%41", "a b+%41_x.jsonl", "a"), ("m 2", "m 2_run.jsonl", "b"), ("m1", "m1_run.jsonl", "a")]
    with pytest.raises(FileExistsError):
        jsonl.write_results_directory(rows, str(tmp_path), "run")
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        jsonl.read_results_directory(spark, str(tmp_path / "empty"), RAW_RESULT)


def test_grading_a_directory_reports_models_and_collisions(spark, tmp_path):
    def answered(answer, *texts):
        return {**GOOD, "answer_correct": answer, "responses": [{"full_response": f"<answer>{t}</answer>"} for t in texts]}

    lines(tmp_path / "m1_a.jsonl", answered("4", "4", "5"), {**answered("1"), "category": "d"})
    lines(tmp_path / "m1_b.jsonl", answered("2", "1 + 1"))
    lines(tmp_path / "m2_a.jsonl", answered("2", "3"))
    tables = grade_directory_job(spark, str(tmp_path), str(tmp_path / "graded"))
    assert {r.model: (r.correct_responses, r.total_responses) for r in tables["by_model"].collect()} == {"m1": (2, 3), "m2": (0, 1)}
    parts = {(r.model, r.category, r.extraction_method): r.total_responses for r in tables["by_model_parts"].collect()}
    assert parts[("m1", "c", None)] == 3 and parts[("m2", None, "math_verify")] == 1
    assert [tuple(r) for r in tables["collisions"].collect()] == [("m1", 2)]
    assert {r.category: r.total_questions for r in tables["by_category"].collect()} == {"c": 3, "d": 1}


def test_one_parse_gives_rows_and_rejects(spark, tmp_path):
    path = lines(tmp_path / "x.jsonl", GOOD, "{broken", "", {**GOOD, "unique_id": "b"})
    good, bad = jsonl.store_tolerant(spark, path, RAW_RESULT, str(tmp_path / "parsed"))
    plain_good, plain_bad = jsonl.read_tolerant(spark, path, RAW_RESULT)
    assert sorted(good.collect()) == sorted(plain_good.collect()) and good.schema == plain_good.schema
    assert bad.collect() == plain_bad.collect() and bad.columns == ["file", "line"]
    text = good._jdf.queryExecution().toString()
    assert text.count("FileScan parquet") == 1 and "FileScan text" not in text and "accepted" in text.split("PartitionFilters")[1].split("]")[0]
    empty = lines(tmp_path / "none.jsonl", "")
    good, bad = jsonl.store_tolerant(spark, empty, RAW_RESULT, str(tmp_path / "parsed-none"))
    assert good.count() == bad.count() == 0


def read_back(folder):
    return [line for p in sorted(folder.rglob("*.json")) for line in p.read_text(encoding="utf-8").splitlines()]


def test_sinks_keep_order_nulls_and_non_ascii(spark, tmp_path):
    df = spark.createDataFrame([("é", None, "a")], "question string, category string, unique_id string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    jsonl.append_jsonl(df, str(tmp_path / "out"))
    assert read_back(tmp_path / "out") == ['{"unique_id":"a","question":"é","category":null}'] * 2
    jsonl.write_splits(df.withColumn("split", F.lit("test")), str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "split=test").is_dir()


def test_threshold_report(spark, tmp_path):
    rows = spark.createDataFrame([(0.9, 0.1, "think"), (0.2, 0.8, "no_think"), (0.3, 0.7, None)],
                                 "think_probability double, no_think_probability double, label string")
    sweep = evaluation.threshold_sweep(rows)
    jsonl.write_threshold_report(sweep, str(tmp_path / "report"), evaluation.best_threshold(sweep))
    (line,) = read_back(tmp_path / "report")
    report = json.loads(line)
    assert len(report["threshold_results"]) == 17 and report["best_accuracy"] == 1.0
    assert report["best_threshold"] == 0.25


def test_store_versions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    assert store.read() is None
    old = spark.createDataFrame([("a", 1), ("b", 2)], "unique_id string, v int")
    store.upsert(old)
    store.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "unique_id string, v int"))
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 3), ("c", 4)]
    (tmp_path / "store" / "v=9").mkdir()
    assert store.version() == 2
    log = BatchLog(spark, str(tmp_path / "log"))
    assert log.read() is None
    log.commit(1, old)
    log.commit(0, old)
    assert log.done() == [0, 1] and log.read().count() == 4 and log.read().columns == ["unique_id", "v"]


def _folders(store):
    return {path.rsplit("=", 1)[1] for path in matching_paths(store.spark, f"{store.root}/data/v={store.version()}/id_bucket=*")}


def test_store_writes_only_touched_buckets_and_keeps_versions(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=50)
    rows = spark.range(3000).selectExpr("concat('q', id) as unique_id", "id as v").union(spark.createDataFrame([(None, -1)], "unique_id string, v long"))
    store.replace(rows)
    assert len(_folders(store)) == 50
    fresh = spark.createDataFrame([("q7", 70), ("q11", 110), ("new", 1)], "unique_id string, v long")
    found = {r.unique_id: r.v for r in ResultStore(spark, store.root).upsert(fresh).collect()}
    assert found == {**{f"q{i}": i for i in range(3000)}, None: -1, "q7": 70, "q11": 110, "new": 1}
    assert 1 <= len(_folders(store)) <= 3 and store.touched(fresh, 2) == {int(b) for b in _folders(store)}
    assert {r.unique_id: r.v for r in store.read(1).collect()} == {**{f"q{i}": i for i in range(3000)}, None: -1}
    some = {r.unique_id for r in store.read(buckets=store.touched(fresh, 2)).collect()}
    assert {"q7", "q11", "new"} <= some and len(some) < 400
    store.replace(rows.limit(1))
    assert store.read().count() == 1


def test_store_of_nothing_and_an_unfinished_version(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "unique_id string, v int, responses array<struct<full_response:string>>")
    assert store.replace(empty).schema == empty.schema and store.read().count() == 0
    store.upsert(spark.createDataFrame([("a", 1, [("x",)])], empty.schema))
    assert store.upsert(empty).count() == 1
    (tmp_path / "store" / "v=9").mkdir()
    assert store.version() == 3


def test_stored_texts_are_not_shuffled_for_a_few_ids(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    store.replace(spark.range(20_000).selectExpr("concat('q', id) as unique_id", "repeat('x', 50) as t"))
    fresh = materialize(spark.createDataFrame([("q1", "new"), ("q2", "new")], "unique_id string, t string"), "fresh")
    kept = resume.untouched(store.read(), fresh)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        listed = resume.with_membership(store.read(), fresh.select("unique_id"))
        plan = listed.where("not _listed")._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert listed.where("_listed").count() <= 4 and {"q1", "q2"} <= {r.unique_id for r in listed.where("_listed").collect()}
        assert kept.count() == 19_998
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)



def test_result_layout(spark, tmp_path):
    df = spark.createDataFrame([("org/set", "team/router", 1)], "dataset string, router string, v int")
    write_result_layout(df, str(tmp_path / "results"))
    assert (tmp_path / "results" / "dataset=set" / "router=router").is_dir()


def test_prediction_layouts(spark, tmp_path):
    first = lines(tmp_path / "1.jsonl", {"problem": "p", "answer": 70, "id": 0, "think_probability": 0.5, "no_think_probability": 0.5})
    second = lines(tmp_path / "2.jsonl", {"problem": "p", "answer": "70", "id": "0", "no_think_score": 0.3, "think_score": 0.7})
    third = lines(tmp_path / "3.jsonl", {"problem_idx": 1, "problem": "p", "answer": "2", "problem_type": ["G"], "think_probability": 0.6, "no_think_probability": 0.4})
    frames = [jsonl.read_strict(spark, p, s) for p, s in ((first, PREDICTION_WITH_ID), (second, PREDICTION_WITH_ID), (third, PREDICTION_WITH_INDEX))]
    rows = [tuple(r) for r in predictions.union_predictions(frames).orderBy("row_id", "think_probability").collect()]
    assert rows == [("0", "p", "70", None, 0.5, 0.5), ("0", "p", "70", None, 0.7, 0.3), ("1", "p", "2", ["G"], 0.6, 0.4)]


def test_images(spark, tmp_path):
    data = bytes(range(256)) * 2
    (tmp_path / "a.PNG").write_bytes(data)
    row = images.read_images(spark, str(tmp_path)).first()
    assert row.image_url == "data:image/png;base64," + base64.b64encode(data).decode()
    refs = spark.createDataFrame([("http://h/x.png",), (row.path,)], "image string")
    got = {r.image: r.image_url for r in images.resolve_images(refs, images.read_images(spark, str(tmp_path))).collect()}
    assert got == {"http://h/x.png": "http://h/x.png", row.path: row.image_url}


def test_question_schema_round_trip(spark, tmp_path):
    path = lines(tmp_path / "q.jsonl", {"unique_id": "u", "question": "q", "category": "c", "choices": ["a"], "choice_index_correct": 0, "explanation_correct": None, "answer_correct": "a"})
    assert jsonl.read_strict(spark, path, QUESTION).first().choices == ["a"]


def test_split_folder(spark, tmp_path):
    lines(tmp_path / "train.jsonl", GOOD, "{broken")
    lines(tmp_path / "bank_val.jsonl", {"unique_id": "z", "problem": "p"})
    splits = jsonl.read_split_folder(spark, str(tmp_path), RAW_RESULT)
    assert set(splits) == {"train", "validation"} and splits["train"].count() == 1
    row = splits["validation"].first()
    assert (row.is_mcq, row.category, row.responses) == (False, "", [])
    rejects = jsonl.split_folder_rejects(spark, str(tmp_path), RAW_RESULT)
    assert [r.split for r in rejects.collect()] == ["train"]
    stored, bad = jsonl.store_split_folder(spark, str(tmp_path), RAW_RESULT, str(tmp_path / "parsed"))
    assert {name: rows.collect() for name, rows in stored.items()} == {name: rows.collect() for name, rows in splits.items()}
    assert [(r.split, r.line) for r in bad.collect()] == [("train", "{broken")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        jsonl.read_split_folder(spark, str(tmp_path / "empty"), RAW_RESULT)
    with pytest.raises(ValueError):
        jsonl.store_split_folder(spark, str(tmp_path / "empty"), RAW_RESULT, str(tmp_path / "parsed-none"))
