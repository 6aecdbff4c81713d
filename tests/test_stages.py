"""Judge, generator and scorer stages, and the jobs built on them."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from signalbox.operators import grading, stages
from signalbox.plans import jobs
from signalbox.schemas import RAW_RESULT
from signalbox.sources.store import ResultStore


def results(spark, rows):
    """(id, answer, [texts]) as raw results."""
    data = [(q, f"problem {q}", False, None, None, None, a, "c", [(t,) for t in texts]) for q, a, texts in rows]
    return spark.createDataFrame(data, RAW_RESULT)


ROWS = [
    ("a", "1", ["<answer>1</answer>", "it is one", "boom"]),
    ("b", "2", ["<answer>3</answer>", "   "]),
    ("c", "3", []),
]


def judge(task):
    if task["full_response"] == "boom":
        raise RuntimeError("down")
    if not task["full_response"].strip():
        return None
    return "judged", task["full_response"] == "it is one", "because" if task["is_mcq"] is False else ""


def by_key(df):
    return {(r.unique_id, r.response_idx): (r.extracted_answer, r.is_correct, r.extraction_method, r.judge_explanation) for r in df.collect()}


def test_three_phases(spark):
    got = by_key(grading.grade_three_phase(results(spark, ROWS), judge))
    assert got == {
        ("a", 0): ("1", True, "math_verify", None),
        ("a", 1): ("judged", True, "llm_judge", "because"),
        ("a", 2): ("Extraction failed", False, "regex_fallback", "LLM judge failed: down"),
        ("b", 0): ("judged", False, "llm_judge", "because"),
        ("b", 1): ("Extraction failed", False, "regex_fallback", "LLM judge returned None"),
    }


def test_judge_can_get_its_prompt(spark):
    def read_prompt(task):
        return task["judge_prompt"].split("Correct Answer: ")[1], True, ""

    got = by_key(grading.grade_three_phase(results(spark, ROWS), read_prompt, with_prompt=True))
    assert got[("b", 0)] == ("2", True, "llm_judge", None)


def test_judge_errors_in_compat_mode(spark):
    checked = grading.grade_math_only(grading.explode_responses(results(spark, ROWS)))
    tasks = checked.filter("needs_judge").withColumn("correct_answer", grading.row_gold())
    got = by_key(stages.judge_stage(tasks, judge, compat=True))
    assert got[("a", 2)] == ("Judge error", False, "llm_judge", "Error during LLM judgment: down")
    assert got[("b", 1)][:3] == ("Judge not available", False, "llm_judge")


def test_fallback_variant_tags_regex(spark):
    assert by_key(grading.grade_with_fallback(results(spark, ROWS), judge))[("a", 0)][2] == "regex"


def test_grade_in_place_equals_rows_and_nesting(spark):
    raw = results(spark, ROWS)
    nested = {r.unique_id: [(x.extracted_answer, x.is_correct) for x in r.responses] for r in grading.grade_in_place(raw).collect()}
    assert nested["a"][0] == ("1", True) and nested["b"][1] == ("No answer found in formatted output", False) and nested["c"] == []
    rows = grading.grade_rows(grading.explode_responses(raw)).withColumn("judge_explanation", F.lit(None).cast("string"))
    regrouped = grading.nest_responses(rows, raw)
    assert {r.unique_id: [(x.extracted_answer, x.is_correct) for x in r.responses] for r in regrouped.collect()} == nested


def test_custom_verifier(spark):
    always = lambda expected, given: F.lit(True)
    assert all(x.is_correct for r in grading.grade_in_place(results(spark, ROWS), always).collect() for x in r.responses)


def test_grade_job(spark, tmp_path):
    tables = jobs.grade_job(results(spark, ROWS), str(tmp_path / "graded"), judge)
    assert tuple(tables["overall"].first()) == (2, 5, 0.4)
    assert tuple(tables["by_category"].first()) == ("c", 3, 5, 2, 0.4)
    assert {r.extraction_method: r.total_responses for r in tables["by_method"].collect()} == {
        "llm_judge": 2, "regex_fallback": 2, "math_verify": 1,
    }


def generator(request):
    if request["unique_id"].startswith("bad"):
        raise TimeoutError("slow")
    return f" {request['unique_id']}/{request['response_idx']} \n"


def test_generation(spark):
    prompts = spark.createDataFrame([("x", "p"), ("bad", "p")], "unique_id string, prompt string")
    rows = {r.unique_id: r for r in stages.generate_nested(prompts, generator, 3).collect()}
    assert [x.full_response for x in rows["x"].responses] == ["x/0", "x/1", "x/2"] and rows["x"].success
    assert [x.full_response for x in rows["bad"].responses] == ["Error generating response: slow"] * 3
    assert [r.unique_id for r in stages.drop_failed(stages.generate_nested(prompts, generator, 1)).collect()] == ["x"]
    flat = stages.generate_samples(prompts, generator, 2).collect()
    assert sorted((r.unique_id, r.response_idx) for r in flat) == [("bad", 0), ("bad", 1), ("x", 0), ("x", 1)]


def dataset(spark, *ids):
    rows = [(i, q, f"what is {q}?", None, "a", "c") for i, q in enumerate(ids)]
    return spark.createDataFrame(rows, "idx long, unique_id string, problem string, choices array<string>, answer_correct string, category string")


def stored(df):
    return {r.unique_id: [x.full_response for x in r.responses] for r in df.collect()}


def flaky(request):
    """Fails one sample of q1 and all of q2."""
    if request["unique_id"] == "q2" or (request["unique_id"] == "q1" and request["response_idx"] == 0):
        raise TimeoutError("slow")
    return f"first {request['response_idx']}"


def steady(request):
    return f"again {request['response_idx']}"


def test_collect_resumes_and_retries(spark, tmp_path):
    path = str(tmp_path / "store")
    data = dataset(spark, "q0", "q1", "q2")
    error = "Error generating response: slow"
    first = stored(jobs.collect_job(data, path, flaky, k=2, batch_size=2, on_all_failed="continue"))
    assert first == {"q0": ["first 0", "first 1"], "q1": [error, "first 1"], "q2": [error, error]}
    unchanged = stored(jobs.collect_job(dataset(spark, "q0", "q1", "q2", "q3"), path, steady, k=2))
    assert unchanged == {**first, "q3": ["again 0", "again 1"]}
    retried = stored(jobs.collect_job(data, path, steady, k=2, retry_failed=True))
    assert retried == {
        "q0": ["first 0", "first 1"],
        "q1": ["first 1", "again 0", "again 1"],
        "q2": ["again 0", "again 1"],
        "q3": ["again 0", "again 1"],
    }


def test_collect_stops_when_a_whole_batch_fails_and_continues_the_run(spark, tmp_path):
    path, run = str(tmp_path / "store"), str(tmp_path / "run")
    data = dataset(spark, "bad0", "bad1", "q0", "q1")
    stopped = stored(jobs.collect_job(data, path, generator, batch_size=2, run_path=run))
    assert set(stopped) == {"bad0", "bad1"}
    resumed = stored(jobs.collect_job(data, path, generator, batch_size=2, run_path=run))
    assert resumed["q1"] == ["q1/0"] and len(resumed) == 4


@pytest.mark.parametrize("stop", ["stop", "continue"])
def test_a_repeated_run_changes_nothing(spark, tmp_path, stop):
    path, run = str(tmp_path / "store"), str(tmp_path / "run")

    def half(request):
        if request["unique_id"].startswith("bad") or request["unique_id"] == "q0" and request["response_idx"] == 1:
            raise RuntimeError("down")
        return f"{request['unique_id']}/{request['response_idx']}"

    data = dataset(spark, "q0", "bad0", "bad1", "q1")
    for size in (1, 2):
        seen = [stored(jobs.collect_job(data, f"{path}{size}", half, k=2, batch_size=size, run_path=f"{run}{size}", on_all_failed=stop)) for _ in range(5)]
        assert seen[-1] == seen[-2] and len(seen[-1]) == 4 and all(len(v) == 2 for v in seen[-1].values())
        again = [stored(jobs.collect_job(
            data, f"{path}{size}", steady, k=2, retry_failed=True, batch_size=size, run_path=f"{run}{size}-retry", on_all_failed=stop)) for _ in range(3)]
        assert again[0] == again[1] == again[2]


def test_collect_with_nothing_to_do(spark, tmp_path):
    path = str(tmp_path / "store")
    nothing = jobs.collect_job(dataset(spark, "x").limit(0), str(tmp_path / "none"), steady, k=2)
    assert nothing.count() == 0 and {"unique_id", "responses"} <= {*nothing.columns}
    data = dataset(spark, "q0", "q1")
    first = stored(jobs.collect_job(data, path, flaky, k=2))
    calls = tmp_path / "calls"

    def counted(request):
        calls.write_text("called")
        return steady(request)

    done = stored(jobs.collect_job(dataset(spark, "q0"), path, counted, k=2, retry_failed=True))
    assert stored(jobs.collect_job(data, path, counted, k=2)) == done == first and not calls.exists()
    assert stored(jobs.collect_job(data.limit(0), path, counted, k=2, run_path=str(tmp_path / "run"))) == first
    assert stored(jobs.collect_job(data.limit(0), path, counted, k=2, run_path=str(tmp_path / "run"))) == first
    assert ResultStore(spark, path).version() == 1 and not calls.exists()
    weak = grading.grade_in_place(results(spark, ROWS)).withColumn("idx", F.lit(1).cast("long")).limit(0)
    assert stored(jobs.cascade_job(weak, path, counted, str(tmp_path / "failed"), k=2)) == first
    assert stored(jobs.cascade_job(weak, str(tmp_path / "empty"), counted, str(tmp_path / "failed2"), k=2)) == {}


def test_python_stages_keep_values_exact(spark):
    big = 9007199254740993
    rows = spark.createDataFrame([("a", big, 1), ("b", None, None)], "unique_id string, big long, choice int")
    seen = stages.generate_samples(rows, lambda r: f"{r['big']} {r['choice']}", k=1).collect()
    assert {(r.unique_id, r.big, r.choice, r.full_response) for r in seen} == {("a", big, 1, f"{big} 1"), ("b", None, None, "None None")}
    tasks = rows.selectExpr("*", "'x' as extracted_answer", "cast(null as array<string>) as choices")
    judged = stages.judge_stage(tasks, lambda r: (str(r["big"]), r["choice"] == 1, "why"), max_workers=2).collect()
    assert {(r.unique_id, r.big, r.extracted_answer, r.is_correct) for r in judged} == {("a", big, str(big), True), ("b", None, "None", False)}
    scored = stages.win_rate_scores(rows, "unique_id", lambda texts: [0.25 for _ in texts], batched=True).collect()
    assert {(r.big, r.confidence) for r in scored} == {(big, 0.25), (None, 0.25)}


def test_cascade_runs_only_on_weak_failures(spark, tmp_path):
    weak = grading.grade_in_place(results(spark, ROWS)).withColumn("idx", F.ascii("unique_id").cast("long"))
    out = jobs.cascade_job(weak, str(tmp_path / "store"), steady, str(tmp_path / "failed"), k=2)
    assert stored(out) == {"b": ["again 0", "again 1"]}
    assert spark.read.parquet(str(tmp_path / "failed")).first().failure_rate == 1.0
    assert ResultStore(spark, str(tmp_path / "store")).version() == 1


def test_publish_job(spark, tmp_path):
    nested = grading.grade_in_place(results(spark, ROWS))
    out = jobs.publish_job({"train": nested, "test": nested.limit(1)}, str(tmp_path / "published"))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 3, "test": 1}
    with pytest.raises(ValueError):
        jobs.publish_job({}, str(tmp_path / "none"))


def test_scorers(spark):
    texts = spark.createDataFrame([("long text",), ("",)], "text string")

    def scorer(batch):
        return pd.DataFrame({"a": batch.str.len() / 10, "b": 1 - batch.str.len() / 10})

    rows = stages.score_with(texts, "text", scorer, ["think", "no_think"]).collect()
    assert {(r.text, r.think_probability) for r in rows} == {("long text", 0.9), ("", 0.0)}

    def fragile(text):
        return 1 / len(text)

    assert {r.confidence for r in stages.win_rate_scores(texts, "text", fragile).collect()} == {1 / 9, 0.5}


def _calls_at_a_time(folder, wait=0.02):
    """A generator that notes in a shared folder how many calls run beside each of its own."""
    def call(request):
        import os
        import time
        import uuid

        mark = os.path.join(folder, "running", uuid.uuid4().hex)
        open(mark, "w").close()
        seen = len(os.listdir(os.path.join(folder, "running")))
        time.sleep(wait)
        with open(os.path.join(folder, "seen", uuid.uuid4().hex), "w") as out:
            out.write(str(seen))
        os.remove(mark)
        return "done"

    return call


@pytest.mark.parametrize("in_flight, max_workers", [(6, 2), (3, 30), (5, 2)])
def test_calls_in_flight_are_bounded_over_all_tasks(spark, tmp_path, in_flight, max_workers):
    for name in ("running", "seen"):
        (tmp_path / name).mkdir()
    prompts = spark.range(0, 60, 1, 8).selectExpr("cast(id as string) as unique_id")
    made = stages.generate_nested(prompts, _calls_at_a_time(str(tmp_path)), 2, max_workers, in_flight)
    assert made.where("success").count() == 60
    seen = [int(p.read_text()) for p in (tmp_path / "seen").iterdir()]
    assert len(seen) == 120 and 1 < max(seen) <= in_flight
    with pytest.raises(ValueError):
        stages.generate_samples(prompts, lambda r: "", in_flight=0)


def _logged_judge(folder, broken=()):
    def judge(task):
        import os
        import uuid

        with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
            out.write(task["full_response"])
        if task["full_response"] in broken:
            raise RuntimeError("down")
        return "x", task["full_response"] == "b", "why"

    return judge


def test_verdict_log_asks_each_task_once_and_survives_a_stop(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    schema = "unique_id string, response_idx int, problem string, full_response string, correct_answer string, is_mcq boolean, choices array<string>, extracted_answer string"
    rows = [(f"q{i}", i % 3, "p", "abcd"[i % 4], "x", False, None, None) for i in range(40)]
    tasks, log = spark.createDataFrame(rows, schema), str(tmp_path / "log")

    def asked():
        return sorted(p.read_text() for p in calls.iterdir())

    commit, done = jobs.BatchLog.commit, []

    def stops(self, number, df):
        if done:
            raise KeyboardInterrupt
        done.append(number)
        return commit(self, number, df)

    monkeypatch.setattr(jobs.BatchLog, "commit", stops)
    with pytest.raises(KeyboardInterrupt):
        jobs.judge_job(tasks, log, _logged_judge(str(calls)), batches=8)
    monkeypatch.setattr(jobs.BatchLog, "commit", commit)
    first = asked()
    assert 1 <= len(first) < 4
    found = jobs.judge_job(tasks, log, _logged_judge(str(calls), broken=("c", "d")), batches=8).collect()
    assert asked() == list("abcd") and len(found) == 40
    methods = {r[3]: f.extraction_method for r in rows for f in found if f.unique_id == r[0]}
    failed = sorted(set("cd") - set(first))
    assert all(methods[t] == ("regex_fallback" if t in failed else "llm_judge") for t in "abcd")
    jobs.judge_job(tasks, log, _logged_judge(str(calls)))
    assert asked() == list("abcd")
    again = jobs.judge_job(tasks, log, _logged_judge(str(calls)), retry_failed=True).collect()
    assert asked() == sorted([*"abcd", *failed]) and {r.extraction_method for r in again} == {"llm_judge"}
    assert {r.unique_id for r in again if r.is_correct} == {r[0] for r in rows if r[3] == "b"}
    assert jobs.judge_job(tasks.limit(0), str(tmp_path / "none"), _logged_judge(str(calls))).count() == 0


def test_a_large_batch_is_asked_in_pieces(monkeypatch):
    import pyarrow as pa

    held, at_once = [0], [0]
    texts = pa.array([str(i) * 1000 for i in range(10)] * 300)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), texts], names=["n", "text"])

    def rows(piece):
        held[0] += piece.num_rows
        at_once[0] = max(at_once[0], held[0])
        return piece.to_pylist()

    found = []
    for piece, answers in stages._in_pieces(iter([batch, batch.slice(0, 0), batch]), 4, lambda row: row["n"], rows):
        held[0] -= piece.num_rows
        assert answers == piece.column("n").to_pylist()
        found += answers
    assert found == [*range(3000)] * 2 and at_once[0] * 1000 <= 2.1 * stages.PIECE_BYTES
