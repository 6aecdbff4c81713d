"""Queries over extraction, grading and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions.answers import EXTRACTION_FAILED, answers_match, extract_answer
from signalbox.operators import grading, metrics, publish, resume
from signalbox.operators.stages import judge_stage
from signalbox.plans import views
from signalbox.plans.registry import query, rounded
from signalbox.plans.sql_views import (
    GRADED, JUDGED, RAW, STATISTICS, extracted, with_views,
)
from signalbox.schemas import RAW_RESULT
from signalbox.session import fresh_dir, ship_package
from signalbox.sources import jsonl
from signalbox.sources.store import BatchLog

_RATIO = "round(coalesce(count(*) filter (is_correct) / nullif(count(*), 0), 0), 6) as accuracy"


def _rows(spark, d, *keep, shift=0):
    """Judged responses, one row each, without the response text."""
    return grading.explode_responses(
        views.stored_results(spark, d, shift), ["unique_id", *keep], True, ["is_correct", "extraction_method"]
    )


@query("scan_results", with_views(*RAW) + """
select unique_id, cast(length(problem) as bigint) as problem_chars, count(*) as responses,
       sum(cast(length(full_response) as bigint))::bigint as response_chars
from responses group by unique_id, problem""")
def scan_results(spark, d):
    """Store raw results as JSON lines, then read them back strictly."""
    path = fresh_dir(spark, "raw-results")
    jsonl.write_jsonl(views.raw_results(spark, d).drop("doc_id", "source"), path)
    stored = jsonl.read_strict(spark, path, RAW_RESULT)
    chars = F.aggregate("responses", F.lit(0).cast("long"), lambda n, r: n + F.length(r["full_response"]))
    return stored.select(
        "unique_id",
        F.length("problem").cast("long").alias("problem_chars"),
        F.size("responses").cast("long").alias("responses"),
        chars.alias("response_chars"),
    )


@query("extract_answer", with_views(*RAW, extracted()) + """
select unique_id, response_idx, extracted_answer from extracted""")
def extract(spark, d):
    rows = grading.explode_responses(views.raw_results(spark, d), ["unique_id"])
    return rows.select(
        "unique_id", "response_idx", extract_answer(F.col("full_response")).alias("extracted_answer")
    )


@query("extract_answer_documents", """
with scoped as (select doc_id, replace(replace(text, ' ', ' $'), 'e', '\\boxed{e}') as t from documents)
select doc_id, coalesce(list_extract(regexp_extract_all(t, '\\\\boxed\\{(?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*\\}'), -1),
       list_extract(regexp_extract_all(t, '[$][^\\n]*?[$]'), -1), 'No answer found in formatted output') as answer
from scoped""")
def extract_documents(spark, d):
    """Extraction over whole, markup-heavy document texts."""
    marked = F.replace(F.replace("text", F.lit(" "), F.lit(" $")), F.lit("e"), F.lit("\\boxed{e}"))
    return views.table(spark, d, "documents").select("doc_id", extract_answer(marked).alias("answer"))


@query("verify_answer", with_views(*GRADED) + """
select unique_id, response_idx, gold, extracted_answer, is_correct from graded""")
def verify(spark, d):
    rows = grading.grade_rows(grading.explode_responses(views.raw_results(spark, d)))
    return rows.select(
        "unique_id", "response_idx", grading.row_gold().alias("gold"), "extracted_answer", "is_correct"
    )


@query("verify_algebra", """
with numbers as (
  select l_orderkey, l_linenumber, cast(l_quantity as bigint) as q, l_partkey % 97 + 1 as p, l_suppkey % 13 + 1 as s,
         case when l_orderkey % 3 = 0 then 1 else 0 end as d, l_orderkey % 4 as kind from lineitem)
select l_orderkey, l_linenumber, d = 0 as is_correct,
       case kind when 0 then concat(q, ' + ', p, ' * (', s, ' - 3)')
                 when 1 then concat('\\frac{', q, '}{', s, '} + \\frac{', p, '}{', s, '}')
                 when 2 then concat('x + y = ', q + p, chr(10), 'x - y = ', q - p)
                 else concat(q, '^2 - ', p) end as expected,
       case kind when 0 then concat('\\boxed{', q + p * (s - 3) + d, '}')
                 when 1 then concat('(', q + p + d, ') / ', s)
                 when 2 then concat('x = ', q + d, chr(10), 'y = ', p)
                 else concat(q * q - p + d) end as given
from numbers""")
def verify_algebra(spark, d):
    """Arithmetic, fractions, systems and powers with the numbers of order lines; every third order is off by one."""
    wrong, kind = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0), F.col("l_orderkey") % 4
    numbers = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % 97 + 1).alias("p"),
        (F.col("l_suppkey") % 13 + 1).alias("s"), wrong.alias("d"), kind.alias("kind"))
    q, p, s, d = (F.col(c) for c in "qpsd")

    def text(*parts):
        return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))

    def of_kind(*texts):
        return F.coalesce(*(F.when(F.col("kind") == k, t) for k, t in enumerate(texts)))

    expected = of_kind(
        text(q, " + ", p, " * (", s, " - 3)"), text("\\frac{", q, "}{", s, "} + \\frac{", p, "}{", s, "}"),
        text("x + y = ", q + p, "\n", "x - y = ", q - p), text(q, "^2 - ", p))
    given = of_kind(
        text("\\boxed{", q + p * (s - 3) + d, "}"), text("(", q + p + d, ") / ", s), text("x = ", q + d, "\ny = ", p), text(q * q - p + d))
    texts = numbers.select("l_orderkey", "l_linenumber", expected.alias("expected"), given.alias("given"))
    return texts.withColumn("is_correct", answers_match(F.col("expected"), F.col("given")))


@query("grade_math_only", with_views(*GRADED) + f"""
select unique_id, response_idx,
       case when extracted_answer in ('', 'No answer found in formatted output') then '{EXTRACTION_FAILED}'
            else extracted_answer end as extracted_answer,
       is_correct, not is_correct as needs_judge from graded""")
def math_only(spark, d):
    rows = grading.grade_math_only(grading.explode_responses(views.raw_results(spark, d)))
    return rows.select("unique_id", "response_idx", "extracted_answer", "is_correct", "needs_judge")


@query("grade_no_judge", with_views(*GRADED) + """
select unique_id, response_idx, extracted_answer, is_correct, 'math_verify' as extraction_method from graded""")
def no_judge(spark, d):
    rows = grading.explode_responses(views.graded_results(spark, d), ["unique_id"])
    return rows.select("unique_id", "response_idx", "extracted_answer", "is_correct", "extraction_method")


def containment_judge(task):
    """A deterministic judge for checks: accepts a response that contains the plain answer."""
    text, expected = task["full_response"], task["correct_answer"]
    if text.startswith("Error generating response:"):
        raise RuntimeError("nothing to judge")
    if not text.strip():
        return None
    plain = expected.removeprefix("\\boxed{").removesuffix("}")
    found = plain in text
    return (plain if found else "none"), found, ("contains the answer" if found else "")


_JUDGE_SQL = """
select unique_id, response_idx,
       case when is_correct then extracted_answer
            when h in (8, 9) then case when h = 9 or extracted_answer in ('', 'No answer found in formatted output')
                                       then 'Extraction failed' else extracted_answer end
            when contains(full_response, plain_gold) then plain_gold else 'none' end as extracted_answer,
       is_correct or (h not in (8, 9) and contains(full_response, plain_gold)) as is_correct,
       case when is_correct then 'math_verify' when h in (8, 9) then 'regex_fallback' else 'llm_judge' end as extraction_method,
       case when is_correct then null when h = 8 then 'LLM judge failed: nothing to judge' when h = 9 then 'LLM judge returned None'
            when contains(full_response, plain_gold) then 'contains the answer' end as judge_explanation
from graded"""


@query("grade_three_phase", with_views(*GRADED) + _JUDGE_SQL)
def three_phase(spark, d):
    ship_package()
    graded_rows = grading.grade_three_phase(views.raw_results(spark, d), containment_judge)
    return graded_rows.drop("full_response")


@query("grade_with_fallback", with_views(*GRADED)
       + f"select * replace (case extraction_method when 'math_verify' then 'regex' else extraction_method end as extraction_method) from ({_JUDGE_SQL})")
def with_fallback(spark, d):
    """The variant for single responses, whose resolved rows have a tag of their own."""
    ship_package()
    return grading.grade_with_fallback(views.raw_results(spark, d), containment_judge).drop("full_response")


@query("judge_stage", with_views(*GRADED) + f"select * from ({_JUDGE_SQL}) where extraction_method <> 'math_verify'")
def judged_only(spark, d):
    """The judge over the unresolved rows alone."""
    ship_package()
    checked = grading.grade_math_only(grading.explode_responses(views.raw_results(spark, d)))
    tasks = checked.filter("needs_judge").withColumn("correct_answer", grading.row_gold())
    out = judge_stage(tasks, containment_judge)
    return out.select(
        "unique_id", "response_idx", "extracted_answer", "is_correct", "extraction_method", "judge_explanation"
    )


def _judge_tasks(spark, d):
    checked = grading.grade_math_only(grading.explode_responses(views.raw_results(spark, d)))
    return checked.filter("needs_judge").withColumn("correct_answer", grading.row_gold())


@query("judge_job", with_views(*GRADED) + f"select * from ({_JUDGE_SQL}) where extraction_method <> 'math_verify'")
def judged_from_log(spark, d):
    """Verdicts of a run that finds part of its tasks answered by an earlier one."""
    from signalbox.plans.jobs import judge_job

    ship_package()
    tasks, log = _judge_tasks(spark, d), fresh_dir(spark, "verdicts")
    judge_job(tasks.filter("is_mcq"), log, containment_judge, batches=2, max_workers=4)
    return judge_job(tasks, log, containment_judge, batches=2, max_workers=4)


@query("judge_job_calls", with_views(*GRADED) + """
select is_mcq, count(distinct (problem, full_response, gold, choices, extracted_answer)) as calls
from graded where not is_correct group by is_mcq""")
def judge_calls(spark, d):
    """Calls of three runs over the same tasks: one for each distinct task, none by the last run."""
    from signalbox.plans.jobs import judge_job

    ship_package()
    tasks, log = _judge_tasks(spark, d), fresh_dir(spark, "verdicts")
    made = []
    for part in ("is_mcq", "true", "true"):
        judge_job(tasks.filter(part), log, containment_judge, batches=2, max_workers=4)
        made.append(0 if BatchLog(spark, log).read() is None else BatchLog(spark, log).read().count())
    first, both, again = made
    calls = spark.createDataFrame([(True, first), (False, again - first)], "is_mcq boolean, calls long")
    return calls.where(F.lit(again == both) & (F.col("calls") > 0))


@query("overall_accuracy", with_views(*JUDGED) + f"""
select count(*) filter (is_correct) as correct_responses, count(*) as total_responses, {_RATIO} from judged""")
def overall(spark, d):
    return rounded(metrics.overall_accuracy(_rows(spark, d)), "accuracy")


@query("accuracy_by_category", with_views(*GRADED) + f"""
select category, count(distinct unique_id) as total_questions, count(*) as total_responses,
       count(*) filter (is_correct) as correct_responses, {_RATIO}
from graded group by category""")
def by_category(spark, d):
    """Flagship: extract, verify and aggregate every response in one narrow pass and one small shuffle."""
    rows = grading.explode_responses(
        views.raw_results(spark, d),
        ["category", "is_mcq", "choice_index_correct", "answer_correct"], outer=True,
    )
    return rounded(metrics.accuracy_by_category(grading.grade_rows(rows)), "accuracy")


@query("accuracy_by_method", with_views(*JUDGED) + f"""
select extraction_method, count(*) as total_responses, count(*) filter (is_correct) as correct_responses, {_RATIO}
from judged group by extraction_method""")
def by_method(spark, d):
    return rounded(metrics.accuracy_by_method(_rows(spark, d)), "accuracy")


def _model_rows(spark, d):
    """Judged rows with the model taken from a result file name per source and language."""
    file = F.concat_ws("_", "source", "category", F.lit("results.jsonl"))
    results = views.stored_results(spark, d).withColumn("model", jsonl.model_of_file(file))
    return grading.explode_responses(
        results, ["model", "category"], fields=["is_correct", "extraction_method"]
    )


@query("accuracy_by_model", with_views(*JUDGED) + f"""
select source as model, count(*) filter (is_correct) as correct_responses, count(*) as total_responses, {_RATIO}
from judged group by source""")
def by_model(spark, d):
    return rounded(metrics.accuracy_by_model(_model_rows(spark, d)), "accuracy")


@query("accuracy_grouping_sets", with_views(*JUDGED) + f"""
select source as model, category, extraction_method, count(*) filter (is_correct) as correct_responses,
       count(*) as total_responses,
       case grouping(source, category, extraction_method) when 1 then 'category' when 2 then 'method' else 'model' end as level,
       {_RATIO}
from judged group by grouping sets ((source), (source, category), (source, extraction_method))""")
def grouping_sets(spark, d):
    out = metrics.accuracy_grouping_sets(_model_rows(spark, d))
    return rounded(
        out.withColumn("correct_responses", F.col("correct_responses").cast("long")), "accuracy"
    )


@query("directory_results", with_views(*JUDGED) + """
select source as model, count(distinct unique_id) as questions, count(*) as responses from judged group by source""")
def directory(spark, d):
    """Result files in one folder, model from the file name; several files per model are all kept."""
    path = fresh_dir(spark, "result-folder")
    jsonl.write_results_directory(views.raw_results(spark, d).withColumnRenamed("source", "model").drop("doc_id"), path)
    stored = jsonl.read_results_directory(spark, path, RAW_RESULT)
    return stored.groupBy("model").agg(
        F.count(F.lit(1)).alias("questions"), F.sum(F.size("responses")).alias("responses")
    )


@query("grade_directory_job", with_views(*GRADED) + f"""
select source as model, category, extraction_method, count(*) filter (is_correct) as correct_responses,
       count(*) as total_responses,
       case grouping(source, category, extraction_method) when 1 then 'category' when 2 then 'method' else 'model' end as level,
       {_RATIO}
from (select *, 'math_verify' as extraction_method from graded)
group by grouping sets ((source), (source, category), (source, extraction_method))""")
def grade_directory(spark, d):
    """A folder of raw result files, graded once, to tables per model, category and method."""
    from signalbox.plans.jobs import grade_directory_job

    path = fresh_dir(spark, "result-folder")
    jsonl.write_results_directory(views.raw_results(spark, d).withColumnRenamed("source", "model").drop("doc_id"), path)
    out = grade_directory_job(spark, path, fresh_dir(spark, "graded"))["by_model_parts"]
    return rounded(out.withColumn("correct_responses", F.col("correct_responses").cast("long")), "accuracy")


@query("question_accuracy", with_views(*JUDGED) + """
select unique_id, cast(count(*) filter (is_correct) as integer) as no_think_correct_count,
       cast(count(*) as integer) as no_think_total_count,
       round(count(*) filter (is_correct) / count(*), 6) as no_think_accuracy
from judged group by unique_id""")
def question_accuracy(spark, d):
    results = views.stored_results(spark, d).select("unique_id", "responses")
    return rounded(metrics.question_accuracy(results, "no_think"), "no_think_accuracy")


@query("weak_failures", with_views(*JUDGED) + """
select unique_id, problem, category, round(1 - c / n, 6) as failure_rate
from (select unique_id, problem, category, least(count(*), 3) as n, least(count(*) filter (is_correct), 3) as c
      from judged group by unique_id, problem, category)
where 1 - c / n > 0.5""")
def weak(spark, d):
    failed = resume.weak_failures(views.stored_results(spark, d), failure_threshold=0.5, k=3)
    return rounded(failed.select("unique_id", "problem", "category", "failure_rate"), "failure_rate")


@query("topk_responses", with_views(*JUDGED) + """
select * from (
  select unique_id, response_idx, is_correct,
         cast(row_number() over (partition by unique_id order by is_correct desc, response_idx) as integer) as rank
  from judged) where rank <= 2""")
def topk(spark, d):
    return resume.topk_nested(views.stored_results(spark, d), 2)


_WIDE_SQL = ",\n       ".join(
    f"coalesce(max(full_response) filter (response_idx = {i}), '') as response_{i + 1}, "
    f"coalesce(max(extracted_answer) filter (response_idx = {i}), '') as extracted_answer_{i + 1}, "
    f"coalesce(bool_or(is_correct) filter (response_idx = {i}), false) as is_correct_{i + 1}, "
    f"coalesce(max(extraction_method) filter (response_idx = {i}), '') as extraction_method_{i + 1}, "
    f"coalesce(max(judge_explanation) filter (response_idx = {i}), '') as judge_explanation_{i + 1}"
    for i in range(4)
)
_WIDE_STATS = """s.total_responses, s.correct_responses, round(s.accuracy, 6) as accuracy,
       s.math_verify_count, round(s.math_verify_accuracy, 6) as math_verify_accuracy,
       s.llm_judge_count, round(s.llm_judge_accuracy, 6) as llm_judge_accuracy,
       s.regex_fallback_count, round(s.regex_fallback_accuracy, 6) as regex_fallback_accuracy"""
_WIDE_ROWS = f"""wide as (
  select unique_id, doc_id, {_WIDE_SQL} from judged group by unique_id, doc_id)"""


def _flat(wide):
    """Nested columns as text, ratios rounded, for comparison across engines."""
    flat = wide.drop("extraction_method_counts").withColumn("choices", F.array_join("choices", "|"))
    return rounded(flat, "accuracy", "math_verify_accuracy", "llm_judge_accuracy", "regex_fallback_accuracy")


_WIDE_SELECT = f"""select {{lead}}q.unique_id, q.problem, q.is_mcq, array_to_string(q.choices, '|') as choices, q.choice_index_correct,
       coalesce(q.explanation_correct, '') as explanation_correct, q.answer_correct, q.category,
       w.* exclude (unique_id, doc_id), {_WIDE_STATS}
from questions q join wide w on q.unique_id = w.unique_id join statistics s on q.unique_id = s.unique_id"""


@query("publish_wide", with_views(*JUDGED, STATISTICS, _WIDE_ROWS) + _WIDE_SELECT.format(lead=""))
def wide(spark, d):
    return _flat(publish.publish_wide(views.stored_results(spark, d)))


@query("publish_all_splits", with_views(*JUDGED, STATISTICS, _WIDE_ROWS)
       + _WIDE_SELECT.format(lead="case q.doc_id % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split, "))
def all_splits(spark, d):
    """A folder of three split files in, one padded schema out."""
    from signalbox.plans.jobs import publish_folder_job

    path = fresh_dir(spark, "split-folder")
    results = views.stored_results(spark, d)
    for rest, stem in enumerate(("train", "bank_val", "test")):
        jsonl.write_jsonl(results.filter(F.col("doc_id") % 3 == rest).drop("doc_id", "source"), f"{path}/{stem}.jsonl")
    return _flat(publish_folder_job(spark, path, fresh_dir(spark, "published"))[0])


@query("max_responses", with_views(*RAW) + """
select cast(max(n) as integer) as max_responses from (select count(*) as n from responses group by unique_id)""")
def most_responses(spark, d):
    largest = publish.max_responses(views.stored_results(spark, d))
    return spark.range(1).select(F.lit(largest).cast("int").alias("max_responses"))


@query("method_counts", with_views(*JUDGED) + """
select unique_id, extraction_method, count(*) as n from judged group by unique_id, extraction_method""")
def method_counts(spark, d):
    return publish.method_counts(views.stored_results(spark, d).select("unique_id", "responses"))


def _statistics(spark, d):
    return publish.question_statistics(views.stored_results(spark, d))


@query("perfect_questions", with_views(*JUDGED, STATISTICS) + """
select unique_id, total_responses from statistics where accuracy = 1""")
def perfect(spark, d):
    return publish.perfect_questions(_statistics(spark, d)).select("unique_id", "total_responses")


@query("failed_questions", with_views(*JUDGED, STATISTICS) + """
select unique_id, total_responses from statistics where accuracy = 0""")
def failed(spark, d):
    return publish.failed_questions(_statistics(spark, d)).select("unique_id", "total_responses")


@query("average_accuracy", with_views(*JUDGED, STATISTICS) + """
select round(avg(accuracy), 6) as average_accuracy from statistics""")
def average(spark, d):
    return rounded(publish.average_accuracy(_statistics(spark, d)), "average_accuracy")


@query("method_weighted_accuracy", with_views(*JUDGED, STATISTICS) + " union all ".join(
    f"""select '{m}' as extraction_method, sum({m}_count)::bigint as total_responses,
        round(coalesce(sum({m}_accuracy * {m}_count) / nullif(sum({m}_count), 0), 0), 6) as accuracy from statistics"""
    for m in ("math_verify", "llm_judge", "regex_fallback")))
def weighted(spark, d):
    return rounded(publish.method_weighted_accuracy(_statistics(spark, d)), "accuracy")


@query("judge_used", with_views(*JUDGED) + """
select unique_id, response_idx + 1 as response_number, left(coalesce(judge_explanation, ''), 200) as explanation
from judged where extraction_method = 'llm_judge'""")
def judge_used(spark, d):
    return publish.judge_used(views.stored_results(spark, d).select("unique_id", "responses"))


@query("grade_job", with_views(*GRADED) + f"""
select category, count(distinct unique_id) as total_questions, count(*) as total_responses,
       count(*) filter (is_correct) as correct_responses, {_RATIO}
from graded group by category""")
def grade_job_query(spark, d):
    """The composed job without a judge: store the graded rows, report from the store."""
    from signalbox.plans.jobs import grade_job

    tables = grade_job(views.raw_results(spark, d), fresh_dir(spark, "graded"))
    return rounded(tables["by_category"], "accuracy")
