from __future__ import annotations

import math

import pytest
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from signalbox.functions.scores import argmax, sigmoid, softmax
from signalbox.functions.terms import term_counts
from signalbox.operators import evaluation, prompts, routing
from signalbox.operators.scorers import fit_count_heads, fit_text_heads, with_word_counts
from signalbox.plans import router_queries
from signalbox.plans.jobs import evaluate_job


def test_two_head_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([(0.4, 0.5), (0.4, 0.4), (0.3, 0.5), (0.3, 0.1), (math.nan, None)], "reasoning_score double, difficulty_score double")
    models = [r.selected_model for r in routing.route_two_head(df).collect()]
    assert models == [routing.DECISION_TABLE[k] for k in ((True, True), (True, False), (False, True), (False, False), (False, False))]


def test_class_route_refuses_unknown_labels(spark):
    df = spark.createDataFrame([([0.9, 0.1],)], "p array<double>")
    assert routing.route_class(df, F.col("p"), ["large_llm", "small_llm"]).first().selected_model == routing.CLASS_MODELS["large_llm"]
    with pytest.raises(Exception, match="Invalid model type"):
        routing.route_class(df, F.col("p"), ["medium", "small_llm"]).collect()


def test_catalog(spark):
    assert routing.available_models(spark).count() == 7
    assert routing.reasoning_models(spark).count() == 5
    assert routing.routable_models(spark).count() == 4
    df = spark.createDataFrame([("qwen/qwen3-14b",), ("nope",), (None,)], "model_key string")
    rows = {r.model_key: (r.display_name, r.provider, r.supports_reasoning) for r in routing.model_lookup(df).collect()}
    assert rows["qwen/qwen3-14b"] == ("Qwen 3 14B", "openrouter", True)
    assert rows["nope"] == rows[None] == ("Unknown Model", "openrouter", False)


def test_select_model(spark):
    rows = [("automatic", 0.5, 0.4, None), ("Gemini 2.0 Flash", 0.0, 0.0, True), ("Qwen 3 14B", 0.0, 0.0, False), ("what", 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "model_selection string, reasoning_score double, difficulty_score double, enable_reasoning boolean")
    got = [(r.model_key, r.error, r.use_reasoning) for r in routing.select_model(df).collect()]
    assert got == [
        ("qwen/qwen3-14b", None, True), ("google/gemini-2.0-flash-001", None, False),
        ("qwen/qwen3-14b", None, False), (None, "Error: Model not found", False),
    ]


def test_score_helpers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, -1000.0],)], "l array<double>")
    rows = df.select(softmax(F.col("l")).alias("p"), argmax(F.col("l")).alias("a"), sigmoid(F.col("l")[0]).alias("s")).collect()
    weights = [math.exp(x - 3) for x in (1, 3, 3)]
    assert rows[0].p == pytest.approx([w / sum(weights) for w in weights]) and rows[0].a == 1
    assert rows[1].p == pytest.approx([1, 0, 0]) and rows[1].s == 1.0
    assert rows[0].s == pytest.approx(1 / (1 + math.exp(-1)))


def scored(spark, rows):
    return spark.createDataFrame(rows, "think_probability double, no_think_probability double, label string")


def test_sweep_counts_every_threshold(spark):
    rows = [(i / 40, 1 - i / 40, [None, "think", "no_think", "odd"][i % 4]) for i in range(41)] + [(math.nan, math.nan, "think")]
    got = {r.threshold: r for r in evaluation.threshold_sweep(scored(spark, rows)).collect()}
    assert sorted(got) == list(evaluation.THRESHOLDS)
    for t, r in got.items():
        think = sum(p >= t for p, _, _ in rows)
        hits = sum(label == ("think" if p >= t else "no_think") for p, _, label in rows)
        labelled = sum(label is not None for _, _, label in rows)
        assert (r.think_count, r.no_think_count) == (think, len(rows) - think)
        assert r.accuracy == pytest.approx(hits / labelled)
        assert r.think_percentage + r.no_think_percentage == pytest.approx(100)


def test_best_threshold_ties_and_zero(spark):
    tied = evaluation.threshold_sweep(scored(spark, [(0.95, 0.05, "think"), (0.05, 0.95, "no_think")]))
    assert tuple(evaluation.best_threshold(tied).first()) == (0.1, 1.0)
    none = evaluation.threshold_sweep(scored(spark, [(0.95, 0.05, None)]))
    assert tuple(evaluation.best_threshold(none).first()) == (None, 0.0)


def test_half_ties_differ_by_report(spark):
    df = scored(spark, [(0.5, 0.5, "think"), (0.6, 0.4, "no_think")])
    row = evaluation.classify_half(df).first()
    assert (row.think_count, row.no_think_count) == (1, 0)
    assert tuple(evaluation.label_accuracy(df).first()) == (1, 2, 0.5)


def test_missing_predictions_fall_to_no_think(spark):
    measured = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 0.0), ("c", 1.0, 0.5)], "unique_id string, think_accuracy double, no_think_accuracy double")
    scores = spark.createDataFrame([("a", 0.5, 0.5), ("b", math.nan, 0.2), ("x", 0.9, 0.1)], "unique_id string, think_probability double, no_think_probability double")
    reports = evaluate_job(scores, measured)
    assert {r.router_pick: r.n for r in reports["pick_value_counts"].collect()} == {"think": 1, "no_think": 2}
    assert tuple(reports["strategy_accuracy"].first()) == pytest.approx((1 / 6, 1.0, 0.5, 1 / 3, -0.5))


def test_evaluate_job_reports_depend_on_the_schema(spark):
    labelled = scored(spark, [(0.7, 0.3, "think")])
    assert "best_threshold" in evaluate_job(labelled) and "accuracy" not in evaluate_job(labelled.drop("label"))["threshold_sweep"].columns


def test_text_heads_learn_separable_words(spark):
    rows = [("prove the lemma now", 1, 0), ("hello my friend", 0, 0), ("prove the theorem", 1, 1), ("hello there", 0, 1)] * 5
    df = spark.createDataFrame(rows, "text string, deep int, hard int")
    heads = fit_text_heads(df, {"reasoning": "deep", "difficulty": "hard"}, buckets=256)
    out = {r.text: r.reasoning_score for r in heads.score(df.select("text").distinct()).collect()}
    assert min(out["prove the lemma now"], out["prove the theorem"]) > 0.5 > max(out["hello my friend"], out["hello there"])
    both = heads.classify(df.select("text").limit(1), ("no_think", "think"), "reasoning").first()
    assert both.think_probability + both.no_think_probability == pytest.approx(1)


ODD_TEXTS = [
    "", " ", "a", "Ab_1 ab_1, AB!", "\u0130stanbul \u212a123 \u017f \u00c9t\u00e9", "\x00a\x00b", "\U0001f600a\U0001f600 \u65e5\u672c\u8a9eabc",
    "x" * 100_003, "y" * 7 + " " + "z" * 65, "word " * 300_000, *[f"{'w' * i} {'v' * 2 * i}" for i in range(1, 70)],
]


@pytest.mark.parametrize("buckets", [4096, 1000])
def test_term_counts_are_those_of_spark_ml(spark, buckets):
    df = spark.createDataFrame([(t,) for t in ODD_TEXTS], "text string").repartition(2)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+", minTokenLength=1).transform(df)
    both = HashingTF(inputCol="words", outputCol="known", numFeatures=buckets).transform(words)
    rows = both.select("known", term_counts(F.col("text"), buckets).alias("found")).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(r.known == r.found and list(r.known.indices) == list(r.found.indices) for r in rows)


def test_text_heads_score_stored_counts_and_null_texts(spark):
    rows = [("prove the lemma now", 1), ("hello my friend", 0), ("", 0), (None, None)] * 5
    df = spark.createDataFrame(rows, "text string, deep int")
    heads = fit_text_heads(df, {"reasoning": "deep"}, buckets=256)
    again = fit_text_heads(with_word_counts(df, buckets=256).drop("text"), {"reasoning": "deep"}, buckets=256)
    for fitted in (heads, again):
        scores = {r.text: r.reasoning_score for r in fitted.score(df).collect()}
        assert scores["prove the lemma now"] > 0.5 > scores["hello my friend"] and scores[None] == scores[""]
        counted = fitted.score(with_word_counts(df, buckets=256)).collect()
        assert {r.text: r.reasoning_score for r in counted} == scores


def test_prompt_checks_split_each_text_once(spark, tmp_path):
    docs = [(i, f"{'prove the lemma' if i % 2 else 'hello my friend'} {i}") for i in range(40)] + [(40, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, i % 3 % 2) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    checks = router_queries.score_prompts_checks(spark, str(tmp_path))
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "Python" not in plan
    assert tuple(checks.first()) == (41, 41, 41, True)
    for query in (router_queries.score_prompts, router_queries.score_two_head, router_queries.score_two_head_checks):
        found = query(spark, str(tmp_path))
        assert "text" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.first()) == (41, 41, 41, True, True)
    assert router_queries.score_prompts(spark, str(tmp_path)).columns == ["doc_id", "no_think_probability", "think_probability"]


CHOICE_TAIL = "User: Q?\nOptions:\n\nA. x\n\nB. y\n\nAssistant:"


def test_prompt_layout(spark):
    df = spark.createDataFrame([("Q?", ["x", "y"]), ("Q?", None), ("Q?", [])], "problem string, choices array<string>")
    out = prompts.with_prompts(df).collect()
    assert [r.is_mcq for r in out] == [True, False, True]
    assert out[0].prompt.endswith(CHOICE_TAIL)
    assert out[1].prompt == out[2].prompt and out[1].prompt.endswith("\nUser: Q?\nAssistant:")
    opened = prompts.with_prompts(df, open_ended=True).collect()
    assert opened[1].prompt.endswith("\nQuestion: Q?")


def test_own_template_is_rendered_byte_for_byte(spark):
    df = spark.createDataFrame([("a {b}", ["x"])], "problem string, choices array<string>")
    out = prompts.with_prompts(df, choice_template="\n{{question}}|{{ options }}|\n").first()
    assert out.prompt == "\na {b}|\nA. x\n|"


def test_judge_prompt_lettering(spark):
    df = spark.createDataFrame([(["x", "y"], True), (None, False)], "c array<string>, m boolean")
    args = (F.lit("Q"), F.lit("A"), F.lit("G"), F.col("c"), F.col("m"))
    once = [r.p for r in df.select(prompts.judge_prompt(*args).alias("p")).collect()]
    twice = [r.p for r in df.select(prompts.judge_prompt(*args, compat=True).alias("p")).collect()]
    tail = "Question: Q\nChoices:\n\nA: {0}x\n\nB: {1}y\n\nAnswer: A\nCorrect Answer: G"
    assert once[0].endswith(tail.format("", "")) and twice[0].endswith(tail.format("A. ", "B. "))
    assert once[1] == twice[1] and once[1].endswith("Question: Q\nAnswer: A\nCorrect Answer: G")


def test_too_many_choices(spark):
    fits, exceeds = (spark.createDataFrame([([str(i) for i in range(n)],)], "c array<string>") for n in (26, 27))
    assert fits.select(prompts.format_choices(F.col("c")).alias("c")).first().c[25] == "Z. 25"
    with pytest.raises(Exception, match="more than 26"):
        exceeds.select(prompts.format_choices(F.col("c"))).collect()


def test_count_heads_learn_and_take_odd_texts(spark):
    rows = [(f"good fine {i} words", 1, None) for i in range(20)] + [(f"bad poor {i} words", 0, 1) for i in range(20)] + [(None, 1, 0), ("", 0, 0)]
    train = spark.createDataFrame(rows, "text string, a int, b int")
    heads = fit_count_heads(train, {"x": "a", "y": "b"})
    probes = spark.createDataFrame([(1, "good fine"), (2, "bad poor " * 5000), (3, None), (4, " \n "), (5, "bad poor")], "id int, text string")
    found = {r.id: r for r in heads.score(probes).collect()}
    assert found[1].x_score > 0.9 and found[2].x_score < 0.1 and found[3].x_score == found[4].x_score == 0.5
    assert abs(found[2].x_score - found[5].x_score) < 1e-9
    classified = heads.classify(probes, ("no", "yes"), "x")
    assert classified.columns == ["id", "text", "no_probability", "yes_probability"]
    assert "Exchange" not in classified._jdf.queryExecution().toString()
    nothing = fit_count_heads(train.limit(0), {"x": "a"})
    assert {r.x_score for r in nothing.score(probes).collect()} == {0.5}
