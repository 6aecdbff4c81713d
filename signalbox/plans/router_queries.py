"""Queries over routing and router evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions.scores import argmax, sigmoid, softmax
from signalbox.operators import evaluation, metrics, routing
from signalbox.operators.scorers import COUNTS, TextHeads, fit_count_heads, fit_text_heads, with_word_counts
from signalbox.operators.stages import score_with, win_rate_scores
from signalbox.plans import views
from signalbox.plans.registry import query, rounded
from signalbox.plans.sql_views import (
    PREDICTIONS, QUESTIONS, SCORES, graded, judged, responses, with_views,
)
from signalbox.session import ship_package
from signalbox.sources.store import materialize

SWEEP = """sweep as (
  select t / 100.0::double as threshold,
         100.0 * count(*) filter (think_probability >= t / 100.0::double) / count(*) as think_percentage,
         count(*) filter (think_probability >= t / 100.0::double) as think_count,
         count(*) filter (think_probability < t / 100.0::double) as no_think_count,
         coalesce(count(*) filter (label = case when think_probability >= t / 100.0::double then 'think' else 'no_think' end)
                  / nullif(count(label), 0), 0) as accuracy
  from predictions, (select unnest(range(10, 91, 5)) as t) group by t)"""


@query("threshold_sweep", with_views(PREDICTIONS, SWEEP) + """
select threshold, round(think_percentage, 6) as think_percentage, round(100 - think_percentage, 6) as no_think_percentage,
       think_count, no_think_count, round(accuracy, 6) as accuracy from sweep""")
def sweep(spark, d):
    out = evaluation.threshold_sweep(views.predictions(spark, d))
    return rounded(out, "think_percentage", "no_think_percentage", "accuracy")


@query("threshold_distribution", with_views(PREDICTIONS, SWEEP) + """
select threshold, round(think_percentage, 6) as think_percentage, round(100 - think_percentage, 6) as no_think_percentage,
       think_count, no_think_count from sweep""")
def distribution(spark, d):
    out = evaluation.threshold_sweep(views.predictions(spark, d).drop("label"), labelled=False)
    return rounded(out, "think_percentage", "no_think_percentage")


@query("best_threshold", with_views(PREDICTIONS, SWEEP) + """
select threshold as best_threshold, round(accuracy, 6) as best_accuracy from sweep order by accuracy desc, threshold limit 1""")
def best(spark, d):
    return rounded(
        evaluation.best_threshold(evaluation.threshold_sweep(views.predictions(spark, d))), "best_accuracy"
    )


@query("score_summary", with_views(PREDICTIONS) + """
select count(*) as n, round(avg(think_probability), 6) as avg_think, round(avg(no_think_probability), 6) as avg_no_think,
       min(think_probability) as min_think, max(think_probability) as max_think from predictions""")
def summary(spark, d):
    return rounded(evaluation.score_summary(views.predictions(spark, d)), "avg_think", "avg_no_think")


@query("classify_half", with_views(PREDICTIONS) + """
select count(*) filter (difficulty_score > 0.5) as think_count, count(*) filter (1 - difficulty_score > 0.5) as no_think_count,
       round(100.0 * count(*) filter (difficulty_score > 0.5) / count(*), 6) as think_percentage,
       round(100.0 * count(*) filter (1 - difficulty_score > 0.5) / count(*), 6) as no_think_percentage
from predictions""")
def half(spark, d):
    """On the difficulty score, which holds exact ties."""
    scored = views.predictions(spark, d).select(
        F.col("difficulty_score").alias("think_probability"), (1 - F.col("difficulty_score")).alias("no_think_probability")
    )
    return rounded(evaluation.classify_half(scored), "think_percentage", "no_think_percentage")


_PICK = "case when think_probability >= 0.5 then 'think' else 'no_think' end"


@query("label_accuracy", with_views(PREDICTIONS) + f"""
select count(*) filter (label = {_PICK}) as correct, count(label) as total,
       round(coalesce(count(*) filter (label = {_PICK}) / nullif(count(label), 0), 0), 6) as accuracy from predictions""")
def label_accuracy(spark, d):
    return rounded(evaluation.label_accuracy(views.predictions(spark, d)), "accuracy")


@query("label_distribution", with_views(PREDICTIONS) + """
select label, count(*) as n, round(100.0 * count(*) / (select count(label) from predictions), 6) as percentage
from predictions where label is not null group by label""")
def label_distribution(spark, d):
    return rounded(evaluation.label_distribution(views.predictions(spark, d)), "percentage")


@query("pick_distribution", with_views(PREDICTIONS) + f"""
select {_PICK} as pick, count(*) as n, round(100.0 * count(*) / (select count(*) from predictions), 6) as percentage
from predictions group by 1""")
def pick_distribution(spark, d):
    return rounded(evaluation.pick_distribution(views.predictions(spark, d)), "percentage")


@query("label_strategy_reward", with_views(PREDICTIONS) + f"""
select round(no_think, 6) as no_think_reward, round(think, 6) as think_reward, round(router, 6) as router_reward,
       round(router - no_think, 6) as vs_no_think, round(router - think, 6) as vs_think
from (select avg(no_think_score) as no_think, avg(think_score) as think,
             avg(case when {_PICK} = 'think' then think_score else no_think_score end) as router from predictions)""")
def label_reward(spark, d):
    out = evaluation.label_strategy_reward(views.predictions(spark, d))
    return rounded(out, *out.columns)


@query("diff_stats", with_views(PREDICTIONS) + """
select round(avg(think_score - no_think_score), 6) as avg_diff, min(think_score - no_think_score) as min_diff,
       max(think_score - no_think_score) as max_diff from predictions""")
def diffs(spark, d):
    scored = views.predictions(spark, d).withColumn("diff_score", F.col("think_score") - F.col("no_think_score"))
    return rounded(evaluation.diff_stats(scored), "avg_diff")


def _both_modes(spark, d):
    """Per-question accuracy of two models' results side by side."""
    no_think = views.stored_results(spark, d).select("unique_id", "category", "responses")
    think = views.stored_results(spark, d, shift=4).select("unique_id", "category", "responses")
    return evaluation.pair_modes(
        metrics.question_accuracy(no_think, "no_think"), metrics.question_accuracy(think, "think")
    )


_MODES = (
    QUESTIONS, responses(), graded(), judged(), responses(4, "other"), graded("other", "other_graded"),
    judged("other_graded", "other_judged"), """modes as (
  select a.unique_id, a.category, a.c as no_think_correct_count, a.n as no_think_total_count, a.c / a.n as no_think_accuracy,
         b.c as think_correct_count, b.n as think_total_count, b.c / b.n as think_accuracy
  from (select unique_id, category, cast(count(*) as integer) as n, cast(count(*) filter (is_correct) as integer) as c from judged group by all) a
  join (select unique_id, cast(count(*) as integer) as n, cast(count(*) filter (is_correct) as integer) as c from other_judged group by all) b
    on a.unique_id = b.unique_id)""",
)


@query("pair_modes", with_views(*_MODES) + """
select * replace (round(no_think_accuracy, 6) as no_think_accuracy, round(think_accuracy, 6) as think_accuracy) from modes""")
def paired(spark, d):
    return rounded(_both_modes(spark, d), "no_think_accuracy", "think_accuracy")


@query("pair_by_position", """
select idx, a.doc_id, b.quality from (select doc_id, row_number() over (order by doc_id) - 1 as idx from documents) a
full join (select quality, row_number() over (order by doc_id) - 1 as idx from labels) b using (idx)""")
def positional(spark, d):
    """Documents beside label rows by position; the shorter side runs out."""
    docs = views.table(spark, d, "documents").select("doc_id")
    rows = views.table(spark, d, "labels").select(F.col("doc_id").alias("label_doc"), "quality")
    return evaluation.pair_by_position(docs, rows, "doc_id", "label_doc").select("idx", "doc_id", "quality")


_LABELLED = (PREDICTIONS, """scored as (select * from predictions where doc_id in (select doc_id from labels))""")


def _labelled_predictions(spark, d):
    """Predictions exist only for labelled documents; the others must fall to no_think."""
    labelled = views.table(spark, d, "labels").select("doc_id")
    return views.predictions(spark, d).join(labelled, "doc_id", "left_semi")


def _routed(spark, d):
    return evaluation.router_vs_inference(_both_modes(spark, d), _labelled_predictions(spark, d))


_ROUTED = (*_MODES, *_LABELLED, """routed as (
  select m.*, coalesce(case when s.think_probability >= s.no_think_probability then 'think' end, 'no_think') as router_pick
  from modes m left join scored s on m.unique_id = s.unique_id)""")


@query("router_vs_inference", with_views(*_ROUTED) + """
select unique_id, router_pick, round(no_think_accuracy, 6) as no_think_accuracy, round(think_accuracy, 6) as think_accuracy from routed""")
def vs_inference(spark, d):
    out = _routed(spark, d).select("unique_id", "router_pick", "no_think_accuracy", "think_accuracy")
    return rounded(out, "no_think_accuracy", "think_accuracy")


@query("router_vs_inference_by_position", """
select idx, coalesce(case when p.score >= 1 - p.score then 'think' end, 'no_think') as router_pick
from (select row_number() over (order by doc_id) - 1 as idx from documents)
left join (select cast(length(html) % 512 as double) / 512 as score, row_number() over (order by page_id) - 1 as idx from pages) p using (idx)""")
def vs_position(spark, d):
    """Positional form: page scores laid against documents row by row."""
    from signalbox.operators.splits import dense_index

    results = dense_index(views.table(spark, d, "documents").select("doc_id"), "doc_id")
    score = (F.length("html") % 512).cast("double") / 512
    pages = views.table(spark, d, "pages").select(
        "page_id", score.alias("think_probability"), (1 - score).alias("no_think_probability")
    )
    joined = evaluation.router_vs_inference(results, dense_index(pages, "page_id"), key="idx")
    return joined.select("idx", "router_pick")


@query("pick_value_counts", with_views(*_ROUTED) + "select router_pick, count(*) as n from routed group by router_pick")
def value_counts(spark, d):
    return evaluation.pick_value_counts(_routed(spark, d))


@query("strategy_accuracy", with_views(*_ROUTED) + """
select round(no_think, 6) as no_think_accuracy, round(think, 6) as think_accuracy, round(router, 6) as router_accuracy,
       round(router - no_think, 6) as vs_no_think, round(router - think, 6) as vs_think
from (select avg(no_think_accuracy) as no_think, avg(think_accuracy) as think,
             avg(case when router_pick = 'think' then think_accuracy else no_think_accuracy end) as router from routed)""")
def strategy_accuracy(spark, d):
    out = evaluation.strategy_accuracy(_routed(spark, d))
    return rounded(out, *out.columns)


@query("strategy_reward", with_views(PREDICTIONS) + """
select round(no_think, 6) as no_think_reward, round(think, 6) as think_reward, round(router, 6) as router_reward,
       round(router - no_think, 6) as vs_no_think, round(router - think, 6) as vs_think
from (select avg(no_think_score) as no_think, avg(think_score) as think,
             avg(case when think_probability >= no_think_probability then think_score else no_think_score end) as router from predictions)""")
def strategy_reward(spark, d):
    routed = views.predictions(spark, d).withColumn("router_pick", evaluation.router_pick())
    out = evaluation.strategy_reward(routed)
    return rounded(out, *out.columns)


_TABLE_SQL = """case when {r} and {h} then 'google/gemini-2.5-pro-preview' when {r} then 'qwen/qwen3-14b'
            when {h} then 'google/gemini-2.0-flash-001' else 'google/gemma-3-4b-it' end"""


@query("route_two_head", with_views(SCORES) + f"""
select doc_id, reasoning_score, difficulty_score, reasoning_score >= 0.4 as reasoning_needed, difficulty_score >= 0.5 as high_difficulty,
       {_TABLE_SQL.format(r='reasoning_score >= 0.4', h='difficulty_score >= 0.5')} as selected_model from scores""")
def two_head(spark, d):
    return routing.route_two_head(views.two_scores(spark, d))


@query("route_class", with_views(SCORES) + """
select doc_id, case when reasoning_score >= 0.5 then 'large_llm' else 'small_llm' end as label,
       case when reasoning_score >= 0.5 then 'google/gemini-2.5-flash-preview' else 'google/gemini-2.0-flash-001' end as selected_model
from scores""")
def by_class(spark, d):
    scores = views.two_scores(spark, d)
    probabilities = F.array("reasoning_score", 1 - F.col("reasoning_score"))
    return routing.route_class(scores, probabilities, ["large_llm", "small_llm"]).select(
        "doc_id", "label", "selected_model"
    )


@query("route_win_rate", """
select doc_id, coalesce(c, 0.5) as confidence, 1 - coalesce(c, 0.5) as no_think_probability, coalesce(c, 0.5) as think_probability,
       case when coalesce(c, 0.5) >= 0.5 then 'strong' else 'weak' end as route
from (select doc_id, case when n_chars > 0 then cast(n_chars % 1024 as double) / 1024 end as c from documents)""")
def win_rate(spark, d):
    chars = F.col("n_chars")
    scored = views.table(spark, d, "documents").select(
        "doc_id", F.when(chars > 0, (chars % 1024).cast("double") / 1024).alias("confidence")
    )
    return routing.route_win_rate(scored)


@query("win_rate_scores", """
select doc_id, case when text = '' then 0.5 else 1.0 / (1.0 + length(text) / 1000.0) end as confidence from documents""")
def win_rates(spark, d):
    """A per-text scorer over whole texts that fails on empty ones."""
    ship_package()
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return win_rate_scores(docs, "text", length_win_rate).drop("text")


def length_win_rate(text):
    if not text:
        raise ValueError("empty prompt")
    return 1.0 / (1.0 + len(text) / 1000.0)


def requests_of(documents):
    """Chat requests: prompts with scores, a model choice and an optional reasoning switch."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    selection = (
        F.when(doc % 4 == 0, "Claude 3.7 Sonnet").when(doc % 4 == 1, "Qwen 3 14B").when(doc % 4 == 2, "No Such Model")
    )
    return documents.select(
        "doc_id", "text",
        ((chars % 1024).cast("double") / 1024.0).alias("reasoning_score"),
        ((doc % 512).cast("double") / 512.0).alias("difficulty_score"),
        F.when(chars % 2 == 0, F.lit(routing.AUTOMATIC)).otherwise(F.coalesce(selection, F.lit("Gemma 3 4B"))).alias("model_selection"),
        F.when(doc % 3 == 0, True).when(doc % 3 == 1, False).alias("enable_reasoning"),
    )


SELECT_SQL = with_views(f"""requests as (
  select *, cast(n_chars % 1024 as double) / 1024 as reasoning_score, cast(doc_id % 512 as double) / 512 as difficulty_score,
         case when n_chars % 2 = 0 then 'automatic' else ['Claude 3.7 Sonnet', 'Qwen 3 14B', 'No Such Model', 'Gemma 3 4B'][doc_id % 4 + 1] end as model_selection,
         case doc_id % 3 when 0 then true when 1 then false end as enable_reasoning
  from documents)""", f"""chosen as (
  select *, case when model_selection = 'automatic'
                 then {_TABLE_SQL.format(r='reasoning_score >= 0.5', h='difficulty_score >= 0.5')}
                 when model_selection = 'Claude 3.7 Sonnet' then 'anthropic/claude-3.7-sonnet'
                 when model_selection = 'Qwen 3 14B' then 'qwen/qwen3-14b'
                 when model_selection = 'Gemma 3 4B' then 'google/gemma-3-4b-it' end as model_key
  from requests where text <> '')""") + """
select doc_id, model_selection, model_key, case when model_key is null then 'Error: Model not found' end as error,
       coalesce(model_key in ('google/gemini-2.5-pro-preview', 'qwen/qwen3-14b', 'google/gemma-3-4b-it'), false)
         and coalesce(enable_reasoning, true) as use_reasoning
from chosen"""


@query("select_model", SELECT_SQL)
def selected(spark, d):
    from signalbox.streaming.routing import route_stream

    routed = route_stream(requests_of(views.table(spark, d, "documents")))
    return routed.select("doc_id", "model_selection", "model_key", "error", "use_reasoning")


@query("model_lookup", with_views(SCORES) + f"""
select doc_id, model_key, case model_key when 'google/gemini-2.5-pro-preview' then 'Gemini 2.5 Pro' when 'qwen/qwen3-14b' then 'Qwen 3 14B'
         when 'google/gemini-2.0-flash-001' then 'Gemini 2.0 Flash' else 'Unknown Model' end as display_name,
       'openrouter' as provider, model_key in ('google/gemini-2.5-pro-preview', 'qwen/qwen3-14b') as supports_reasoning
from (select doc_id, case when doc_id % 7 = 0 then 'other/model' when reasoning_score >= 0.5 and difficulty_score >= 0.5
        then 'google/gemini-2.5-pro-preview' when reasoning_score >= 0.5 then 'qwen/qwen3-14b' else 'google/gemini-2.0-flash-001' end as model_key
      from scores)""")
def lookup(spark, d):
    hard, deep = F.col("difficulty_score") >= 0.5, F.col("reasoning_score") >= 0.5
    key = (
        F.when(F.col("doc_id") % 7 == 0, "other/model")
        .when(deep & hard, "google/gemini-2.5-pro-preview")
        .when(deep, "qwen/qwen3-14b")
        .otherwise("google/gemini-2.0-flash-001")
    )
    return routing.model_lookup(views.two_scores(spark, d).select("doc_id", key.alias("model_key")))


@query("models_routed", with_views(SCORES) + f"""
select {_TABLE_SQL.format(r='reasoning_score >= 0.4', h='difficulty_score >= 0.5')} as selected_model, count(*) as n
from scores group by 1""")
def models_routed(spark, d):
    """Distinct models the table of scores selects, with their load."""
    routed = routing.route_two_head(views.two_scores(spark, d))
    return routed.groupBy("selected_model").agg(F.count(F.lit(1)).alias("n"))


_SOFTMAX_SQL = """
select vec_id, list_position(p, list_max(p)) - 1 as predicted, round(list_max(p), 6) as top_probability,
       round(1 / (1 + exp(-cast(embedding[1] as double))), 6) as first_sigmoid
from (select vec_id, embedding, list_transform(e, lambda x: x / list_sum(e)) as p
      from (select vec_id, embedding, list_transform(embedding, lambda x: exp(cast(x as double) - cast(list_max(embedding) as double))) as e from embeddings))"""


@query("softmax_scores", _SOFTMAX_SQL)
def softmaxed(spark, d):
    """Embedding components taken as logits."""
    scored = views.table(spark, d, "embeddings").withColumn("p", softmax(F.col("embedding")))
    out = scored.select(
        "vec_id", argmax(F.col("p")).alias("predicted"), F.array_max("p").alias("top_probability"),
        sigmoid(F.element_at("embedding", 1).cast("double")).alias("first_sigmoid"),
    )
    return rounded(out, "top_probability", "first_sigmoid")


_HEADS: dict[tuple[str, str], TextHeads] = {}


def _counted_docs(spark, d):
    """Ids and word counts of all documents, stored, and the quality and toxicity heads, fitted once per data folder."""
    docs = materialize(with_word_counts(views.table(spark, d, "documents").select("doc_id", "text")).drop("text"), "word-counts")
    key = (spark.sparkContext.applicationId, d)
    if key not in _HEADS:
        train = docs.join(views.table(spark, d, "labels"), "doc_id")
        _HEADS[key] = fit_text_heads(train, {"reasoning": "quality", "difficulty": "toxic"})
    return docs, _HEADS[key]


@query("score_two_head")
def score_two_head(spark, d):
    """Two trained heads over whole texts, then the two-threshold route."""
    docs, heads = _counted_docs(spark, d)
    return rounded(routing.route_two_head(heads.score(docs).drop(COUNTS)), "reasoning_score", "difficulty_score")


@query("score_prompts")
def score_prompts(spark, d):
    """Two-class probabilities beside every input row."""
    docs, heads = _counted_docs(spark, d)
    scored = heads.classify(docs, ("no_think", "think"), "reasoning")
    return rounded(scored.drop(COUNTS), "think_probability", "no_think_probability")


_COUNT_HEADS = """buckets as (
  select doc_id, cast('0x' || substr(md5(w), 1, 3) as integer) as b
  from (select doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) as w from documents)),
counted as (
  select b, count(*) filter (quality = 1) as q1, count(*) filter (quality = 0) as q0,
         count(*) filter (toxic = 1) as t1, count(*) filter (toxic = 0) as t0
  from buckets join labels using (doc_id) group by b),
filled as (
  select r.b, coalesce(q1, 0) as q1, coalesce(q0, 0) as q0, coalesce(t1, 0) as t1, coalesce(t0, 0) as t0
  from (select unnest(range(4096)) as b) r left join counted c on r.b = c.b),
coefficients as (
  select b, ln((q1 + 1) / (sum(q1) over () + 4096)) - ln((q0 + 1) / (sum(q0) over () + 4096)) as reasoning,
         ln((t1 + 1) / (sum(t1) over () + 4096)) - ln((t0 + 1) / (sum(t0) over () + 4096)) as difficulty
  from filled),
heads as (
  select doc_id, 1 / (1 + exp(-20 * coalesce(r, 0))) as reasoning_score, 1 / (1 + exp(-20 * coalesce(h, 0))) as difficulty_score
  from documents left join (select doc_id, avg(reasoning) as r, avg(difficulty) as h
                            from buckets join coefficients using (b) group by doc_id) using (doc_id))"""


def _count_heads(spark, d):
    train = views.table(spark, d, "documents").select("doc_id", "text").join(views.table(spark, d, "labels"), "doc_id")
    return fit_count_heads(train, {"reasoning": "quality", "difficulty": "toxic"})


@query("score_two_head_counts", with_views(_COUNT_HEADS) + f"""
select doc_id, round(reasoning_score, 6) as reasoning_score, round(difficulty_score, 6) as difficulty_score,
       reasoning_score >= 0.4 as reasoning_needed, difficulty_score >= 0.5 as high_difficulty,
       {_TABLE_SQL.format(r='reasoning_score >= 0.4', h='difficulty_score >= 0.5')} as selected_model from heads""")
def score_two_head_counts(spark, d):
    """Both heads learned from word counts, whole texts scored in the row, then the two-threshold route."""
    scored = _count_heads(spark, d).score(views.table(spark, d, "documents").select("doc_id", "text"))
    return rounded(routing.route_two_head(scored.drop("text")), "reasoning_score", "difficulty_score")


@query("score_prompts_counts", with_views(_COUNT_HEADS) + """
select doc_id, round(1 - reasoning_score, 6) as no_think_probability, round(reasoning_score, 6) as think_probability from heads""")
def score_prompts_counts(spark, d):
    """Two-class probabilities of the head learned from word counts."""
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    scored = _count_heads(spark, d).classify(docs, ("no_think", "think"), "reasoning")
    return rounded(scored.drop("text"), "think_probability", "no_think_probability")


def _log_loss(p, label):
    kept = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)))
    return F.avg(-F.when(label == 1, F.log(kept)).otherwise(F.log(1 - kept)))


def _share_loss(label):
    share = F.avg(label.cast("double"))
    return -(share * F.log(share) + (1 - share) * F.log(1 - share))


@query("score_two_head_checks", """
select count(*) as n, count(*) as n_probabilities, count(*) as n_routed_by_threshold, true as reasoning_learned, true as difficulty_learned
from documents""")
def score_two_head_checks(spark, d):
    """Every document scored between 0 and 1 and routed by its scores; both heads beat the label share on what they fit."""
    docs, heads = _counted_docs(spark, d)
    labels = views.table(spark, d, "labels")
    scored = routing.route_two_head(heads.score(docs)).drop(COUNTS).join(labels, "doc_id", "left")
    reasoning, difficulty = F.col("reasoning_score"), F.col("difficulty_score")
    table = F.create_map(*[
        x for (needed, hard), model in routing.DECISION_TABLE.items() for x in (F.lit(f"{needed}{hard}".lower()), F.lit(model))])
    expected = F.element_at(table, F.concat((reasoning >= 0.4).cast("string"), (difficulty >= 0.5).cast("string")))
    return scored.agg(
        F.count("*").alias("n"), F.count_if(reasoning.between(0, 1) & difficulty.between(0, 1)).alias("n_probabilities"),
        F.count_if(F.col("selected_model") == expected).alias("n_routed_by_threshold"),
        (_log_loss(F.when(F.col("quality").isNotNull(), reasoning), F.col("quality")) < _share_loss(F.col("quality"))).alias("reasoning_learned"),
        (_log_loss(F.when(F.col("toxic").isNotNull(), difficulty), F.col("toxic")) < _share_loss(F.col("toxic"))).alias("difficulty_learned"),
    )


@query("score_prompts_checks", """
select count(*) as n, count(*) as n_sum_to_one, count(*) as n_same_as_head, true as ranks_labels from documents""")
def score_prompts_checks(spark, d):
    """Both probabilities sum to 1 and repeat the head's score; labelled rows of class 1 score higher on average."""
    docs, heads = _counted_docs(spark, d)
    classified = heads.classify(docs, ("no_think", "think"), "reasoning").drop(COUNTS)
    scored = heads.score(docs).select("doc_id", "reasoning_score")
    rows = classified.join(scored, "doc_id").join(views.table(spark, d, "labels"), "doc_id", "left")
    think, label = F.col("think_probability"), F.col("quality")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(F.abs(think + F.col("no_think_probability") - 1) < 1e-9).alias("n_sum_to_one"),
        F.count_if(F.abs(think - F.col("reasoning_score")) < 1e-12).alias("n_same_as_head"),
        (F.avg(F.when(label == 1, think)) > F.avg(F.when(label == 0, think))).alias("ranks_labels"),
    )


@query("score_prompts_callable", """
select doc_id, round(1 / (1 + exp(-(length(text) - 1000) / 1000.0)), 6) as think_probability,
       round(1 - 1 / (1 + exp(-(length(text) - 1000) / 1000.0)), 6) as no_think_probability from documents""")
def score_callable(spark, d):
    """A user's batch scorer over whole texts."""
    ship_package()
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    scored = score_with(docs, "text", length_scorer, ["no_think", "think"]).drop("text")
    return rounded(scored, "think_probability", "no_think_probability")


def length_scorer(texts):
    import numpy as np
    import pandas as pd

    think = 1 / (1 + np.exp(-(texts.str.len().to_numpy("float64") - 1000) / 1000.0))
    return pd.DataFrame({"no_think": 1 - think, "think": think})


@query("evaluate_job", with_views(PREDICTIONS) + f"""
select 'label_accuracy' as report, round(count(*) filter (label = {_PICK}) / count(label), 6) as value from predictions
union all select 'avg_think', round(avg(think_probability), 6) from predictions
union all select 'router_reward', round(avg(case when {_PICK} = 'think' then think_score else no_think_score end), 6) from predictions""")
def evaluate(spark, d):
    """The composed evaluation: predictions stored once, all reports read from the store."""
    from signalbox.plans.jobs import evaluate_job

    reports = evaluate_job(materialize(views.predictions(spark, d).drop("prompt"), "predictions"))
    picked = {"label_accuracy": ("label_accuracy", "accuracy"), "avg_think": ("score_summary", "avg_think"),
              "router_reward": ("label_strategy_reward", "router_reward")}
    frames = [
        reports[report].select(F.lit(name).alias("report"), F.round(column, 6).alias("value"))
        for name, (report, column) in picked.items()
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])
