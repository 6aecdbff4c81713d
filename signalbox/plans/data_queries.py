"""Queries over ingest, hashing, splits, resuming and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions.encoding import with_unique_id
from signalbox.operators import grading, ingest, resume, splits
from signalbox.operators.stages import drop_failed as drop_failed_prompts
from signalbox.operators.stages import generate_nested
from signalbox.plans import views
from signalbox.plans.registry import query, rounded
from signalbox.plans.sql_views import GRADED, QUESTIONS, RAW, responses, with_views
from signalbox.sources import banks, predictions
from signalbox.session import fresh_dir, ship_package
from signalbox.sources.store import ResultStore, materialize


def _documents(spark, d):
    return views.table(spark, d, "documents")


def _flat(df):
    return df.withColumn("choices", F.array_join("choices", "|"))


_CANONICAL = """cast(null as varchar) as choices, cast(null as integer) as choice_index_correct"""


def _solution(spark, d):
    docs = _documents(spark, d)
    return docs.select(
        F.col("text").alias("problem"), F.col("lang").alias("subject"), F.col("source").alias("solution"),
        F.col("n_chars").cast("string").alias("answer"),
    )


def _year_part(spark, d):
    docs = _documents(spark, d)
    return docs.select(
        F.col("doc_id").alias("ID"),
        (1983 + F.col("doc_id") % 42).alias("Year"),
        F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 3 == 1, "I").otherwise("II")).alias("Part"),
        F.col("text").alias("Question"),
        (F.col("n_chars") % 1000).alias("Answer"),
    )


def _choice(spark, d):
    docs = _documents(spark, d)
    return docs.select(
        F.col("text").alias("question"), F.col("lang").alias("category"),
        F.array("source", "lang", F.col("n_chars").cast("string"), F.lit("none")).alias("options"),
        (F.col("doc_id") % 4).alias("answer_index"),
    )


def _source(spark, d):
    docs = _documents(spark, d)
    return docs.select(
        F.col("text").alias("problem"), F.when(F.col("doc_id") % 10 > 0, F.col("source")).alias("source"),
        F.col("n_chars").alias("answer"), (F.col("n_chars") % 100 / 100).alias("solve_rate"),
    )


_CHOICE_SQL = """choice as (
  select text as question, lang as category, list_value(source, lang, cast(n_chars as varchar), 'none') as choices,
         cast(doc_id % 4 as integer) as choice_index_correct
  from documents)"""


@query("ingest_solution", f"""
select text as question, lang as category, {_CANONICAL}, source as explanation_correct,
       cast(n_chars as varchar) as answer_correct from documents""")
def ingest_solution(spark, d):
    return _flat(ingest.from_solution_bank(_solution(spark, d)))


@query("ingest_year_part", f"""
select text as question,
       concat('AIME_', cast(1983 + doc_id % 42 as varchar), case doc_id % 3 when 1 then '_Part_I' when 2 then '_Part_II' else '' end) as category,
       {_CANONICAL}, cast(null as varchar) as explanation_correct, cast(n_chars % 1000 as varchar) as answer_correct
from documents""")
def ingest_year_part(spark, d):
    return _flat(ingest.from_year_part_bank(_year_part(spark, d)))


@query("ingest_mcq", with_views(_CHOICE_SQL) + """
select question, category, array_to_string(choices, '|') as choices, choice_index_correct,
       cast(null as varchar) as explanation_correct, choices[choice_index_correct + 1] as answer_correct from choice""")
def ingest_mcq(spark, d):
    """Choice bank stored as Parquet, read back, normalized."""
    path = fresh_dir(spark, "choice-bank")
    _choice(spark, d).write.parquet(path)
    return _flat(ingest.from_choice_bank(banks.read_bank(spark, path)))


@query("ingest_source", f"""
select text as question, case when doc_id % 10 > 0 then source else 'Unknown' end as category, {_CANONICAL},
       cast(null as varchar) as explanation_correct, cast(n_chars as varchar) as answer_correct from documents""")
def ingest_source(spark, d):
    return _flat(ingest.from_source_bank(_source(spark, d)))


def _json_sql(expr: str) -> str:
    out = f"replace(replace({expr}, '\\', '\\\\'), '\"', '\\\"')"
    for code, mark in ((10, "n"), (13, "r"), (9, "t"), (8, "b"), (12, "f")):
        out = f"replace({out}, chr({code}), '\\{mark}')"
    for code in [*range(1, 8), 11, *range(14, 32)]:
        out = f"replace({out}, chr({code}), '\\u{code:04x}')"
    return f"concat('\"', {out}, '\"')"


_UNIQUE_SQL = with_views(_CHOICE_SQL) + f"""
select md5(concat('{{"answer_correct": ', {_json_sql('choices[choice_index_correct + 1]')}, ', "category": ', {_json_sql('category')},
  ', "choice_index_correct": ', cast(choice_index_correct as varchar),
  ', "choices": [', array_to_string(list_transform(choices, lambda c: {_json_sql('c')}), ', '), ']',
  ', "explanation_correct": null, "question": ', {_json_sql('question')}, '}}')) as unique_id, category, choice_index_correct
from choice"""


@query("unique_id", _UNIQUE_SQL)
def unique_id(spark, d):
    """Content hash over whole records, every text character included."""
    hashed = with_unique_id(ingest.from_choice_bank(_choice(spark, d)))
    return hashed.select("unique_id", "category", "choice_index_correct")


@query("quality_check", """
select count(*) filter (doc_id % 10 = 0) > 0 as has_missing, count(*) filter (text = '' or source = '') > 0 as has_empty
from documents""")
def quality(spark, d):
    return ingest.quality_check(_source(spark, d), ignore=["solve_rate"])


@query("quality_check_ignoring", """
select false as has_missing, coalesce(bool_or(text = ''), false) as has_empty from documents""")
def quality_ignoring(spark, d):
    return ingest.quality_check(_year_part(spark, d), ignore=["ID", "Part"])


@query("mcq_violations", with_views(QUESTIONS) + """
select unique_id, answer_correct, choices[choice_index_correct + 1] as named
from questions where is_mcq and answer_correct is distinct from choices[choice_index_correct + 1]""")
def violations(spark, d):
    bad = ingest.mcq_violations(views.questions(spark, d))
    return bad.select("unique_id", "answer_correct", F.get("choices", "choice_index_correct").alias("named"))


def _two_banks(spark, d):
    """Documents and benchmark items as two banks with content ids."""
    docs = _documents(spark, d).select(F.md5(F.col("doc_id").cast("string")).alias("unique_id"), F.col("text").alias("question"))
    items = views.table(spark, d, "benchmark").select(
        F.md5(F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("unique_id"), F.col("text").alias("question")
    )
    return [docs, items]


_BANKS_SQL = """banks as (
  select md5(cast(doc_id as varchar)) as unique_id, text as question, 0 as bank from documents
  union all select md5(concat('b', cast(item_id as varchar))), text, 1 from benchmark)"""


@query("combine_banks", with_views(_BANKS_SQL) + "select unique_id, question, bank from banks")
def combine(spark, d):
    return ingest.combine_banks(_two_banks(spark, d))


@query("combine_check", with_views(_BANKS_SQL) + """
select count(*) as records, count(distinct unique_id) as unique_ids, count(*) = count(distinct unique_id) as consistent
from banks""")
def combine_check(spark, d):
    return ingest.combine_check(ingest.union_banks(_two_banks(spark, d)))


@query("id_violations", """
select md5(text) as unique_id, count(*) as copies from documents group by text having count(*) > 1""")
def repeated_ids(spark, d):
    """Ids by text, so that copied documents collide."""
    return ingest.id_violations(_documents(spark, d).select(F.md5("text").alias("unique_id")))


@query("limit_questions", with_views(QUESTIONS) + """
select unique_id, category from questions order by doc_id limit 250""")
def limited(spark, d):
    """The first 250 questions in order, which is what the operator is for."""
    return banks.limit_questions(views.questions(spark, d), 250, "doc_id").select("unique_id", "category")


_INDEXED = """indexed as (
  select doc_id, row_number() over (order by doc_id) - 1 as idx from documents)"""


@query("dense_index", with_views(_INDEXED) + "select doc_id, idx from indexed")
def indexed(spark, d):
    return splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")


@query("dense_index_text", """
select doc_id, row_number() over (order by concat('document-00000000', doc_id)) - 1 as idx from documents""")
def indexed_by_text(spark, d):
    """Text keys that all begin alike."""
    keyed = _documents(spark, d).select("doc_id", F.concat(F.lit("document-00000000"), F.col("doc_id")).alias("key"))
    return splits.dense_index(keyed, "key").drop("key")


@query("batch_index", with_views(_INDEXED) + "select doc_id, cast(idx // 30 as bigint) as batch from indexed")
def batches(spark, d):
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return numbered.select("doc_id", splits.batch_index(F.col("idx"), 30).alias("batch"))


def _split_sql(val_num: int, test_num: int, den: int) -> str:
    """Splits by running minima over the exact integer debts."""
    return with_views(_INDEXED, f"""debts as (
  select doc_id, i, i * {test_num} // {den} as a, i * {val_num} // {den} as sv, (i - 1) * {val_num} // {den} as sv_before
  from (select doc_id, idx + 1 as i from indexed))""", """dealt as (
  select *, (i - sv) + least(0, min(a - (i - sv)) over (order by i)) as d from debts)""", """assigned as (
  select doc_id, i - 1 as idx, case when sv > sv_before then 'validation'
         when d > coalesce(lag(d) over (order by i), 0) then 'test' else 'train' end as split from dealt)""")


@query("deterministic_split", _split_sql(10, 10, 100) + "select doc_id, idx, split from assigned")
def split(spark, d):
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return splits.deterministic_split(numbered)


@query("deterministic_split_thirds", _split_sql(33, 33, 100) + "select doc_id, idx, split from assigned")
def split_thirds(spark, d):
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return splits.deterministic_split(numbered, val_fraction=0.33, test_fraction=0.33)


@query("deterministic_split_fine", _split_sql(123457, 100000, 1000000) + "select doc_id, idx, split from assigned")
def split_fine(spark, d):
    """Fractions that repeat only after a million rows."""
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return splits.deterministic_split(numbered, val_fraction=0.123457, test_fraction=0.1)


@query("deterministic_split_narrow", _split_sql(4999, 5000, 10000) + "select doc_id, idx, split from assigned")
def split_narrow(spark, d):
    """Fractions that leave one row in ten thousand to train: minima over blocks of numbers."""
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return splits.deterministic_split(numbered, val_fraction=0.4999, test_fraction=0.5)


_FLOAT_SQL = """with recursive """ + _INDEXED + """,
steps(idx, v, t, split) as (
  select cast(-1 as bigint), cast(0 as double), cast(0 as double), ''
  union all
  select s.idx + 1, s.v + 0.1::double - case when s.v + 0.1::double >= 1 then 1 else 0 end,
         s.t + 0.1::double - case when s.v + 0.1::double < 1 and s.t + 0.1::double >= 1 then 1 else 0 end,
         case when s.v + 0.1::double >= 1 then 'validation' when s.t + 0.1::double >= 1 then 'test' else 'train' end
  from steps s where s.idx + 1 < (select count(*) from documents))
select i.doc_id, i.idx, s.split from indexed i join steps s on i.idx = s.idx"""


@query("deterministic_split_float", _FLOAT_SQL)
def split_float(spark, d):
    """Parity mode with binary accumulators, as against row-by-row recursion in SQL."""
    numbered = splits.dense_index(_documents(spark, d).select("doc_id"), "doc_id")
    return splits.deterministic_split(numbered, mode="float")


@query("split_counts", _split_sql(10, 10, 100) + """
select split, count(*) as n, round(count(*) / (select count(*) from assigned), 6) as share from assigned group by split""")
def split_counts(spark, d):
    return rounded(splits.split_counts(split(spark, d)), "share")


_STATUS = """marked as (
  select unique_id, response_idx, starts_with(full_response, 'Error generating response:') or trim(full_response) = '' as failed
  from responses)""", """status as (
  select unique_id, cast(count(*) as integer) as n_responses,
         coalesce(string_agg(case when failed then cast(response_idx as varchar) end, ',' order by response_idx), '') as failed_slots,
         count(*) filter (failed) as n_failed,
         case when count(*) filter (failed) = count(*) then 'fully_failed'
              when count(*) filter (failed) > 0 then 'partially_failed' else 'ok' end as status
  from marked group by unique_id)"""


@query("response_validity", with_views(*RAW, _STATUS[0]) + "select unique_id, response_idx, failed from marked")
def validity(spark, d):
    from signalbox.functions.text import is_failed_response

    rows = grading.explode_responses(views.raw_results(spark, d), ["unique_id", "responses"])
    return rows.select("unique_id", "response_idx", is_failed_response(F.col("full_response")).alias("failed"))


@query("response_status", with_views(*RAW, *_STATUS) + "select unique_id, n_responses, failed_slots, status from status")
def status(spark, d):
    found = resume.response_status(views.raw_results(spark, d))
    return found.withColumn("failed_slots", F.array_join(F.col("failed_slots").cast("array<string>"), ","))


@query("response_status_selective", with_views(*RAW, *_STATUS) + """
select unique_id, n_responses,
       array_to_string(list_filter([failed_slots, array_to_string(range(n_responses, 3), ',')], lambda x: x <> ''), ',') as failed_slots,
       case when n_failed + greatest(3 - n_responses, 0) = 3 then 'fully_failed'
            when n_failed + greatest(3 - n_responses, 0) > 0 then 'partially_failed' else 'ok' end as status
from status""")
def status_selective(spark, d):
    found = resume.response_status_selective(views.raw_results(spark, d), k=3)
    return found.withColumn("failed_slots", F.array_join(F.col("failed_slots").cast("array<string>"), ","))


@query("resume_counters", with_views(*RAW, *_STATUS) + """
select count(*) filter (status <> 'fully_failed') as successful, count(*) filter (status = 'fully_failed') as fully_failed,
       count(*) filter (status = 'partially_failed') as partially_failed,
       cast(count(*) filter (status = 'fully_failed') * 2 + coalesce(sum(n_failed) filter (status = 'partially_failed'), 0) as bigint)
         as responses_to_retry
from status""")
def counters(spark, d):
    return resume.resume_counters(resume.response_status(views.raw_results(spark, d)), k=2)


def _existing(spark, d, shift=0):
    """Stored results: the questions whose documents have a label."""
    labelled = views.table(spark, d, "labels").select("doc_id")
    return views.raw_results(spark, d, shift).join(labelled, "doc_id", "left_semi")


_EXISTING = (*_STATUS, """existing as (
  select * from status where unique_id in (select md5(cast(doc_id as varchar)) from labels))""")


@query("resume_plan", with_views(*RAW, *_EXISTING) + """
select q.unique_id, coalesce(e.status, 'new') as reason,
       case when e.status = 'partially_failed' then e.failed_slots else '0,1' end as retry_slots
from questions q left join existing e on q.unique_id = e.unique_id
where e.status is null or e.status <> 'ok'""")
def plan(spark, d):
    known = resume.response_status(_existing(spark, d))
    planned = resume.resume_plan(views.questions(spark, d).select("unique_id"), known, retry_failed=True, k=2)
    return planned.withColumn("retry_slots", F.array_join(F.col("retry_slots").cast("array<string>"), ","))


@query("resume_plan_new_only", with_views(*RAW, *_EXISTING) + """
select unique_id, 'new' as reason from questions where unique_id not in (select unique_id from existing)""")
def plan_new(spark, d):
    known = resume.response_status(_existing(spark, d))
    planned = resume.resume_plan(views.questions(spark, d).select("unique_id"), known, retry_failed=False)
    return planned.select("unique_id", "reason")


@query("selective_resume", with_views(*RAW, *_EXISTING) + """
select q.unique_id from questions q join existing e on q.unique_id = e.unique_id where e.status <> 'ok'""")
def selective(spark, d):
    known = resume.response_status(_existing(spark, d))
    return resume.selective_resume(views.questions(spark, d).select("unique_id"), known, retry_failed=True)


def _joined_responses(df):
    return df.select(
        "unique_id", F.array_join(F.transform("responses", lambda r: r["full_response"]), "|").alias("responses")
    )


_MERGE_SQL = with_views(QUESTIONS, responses(), responses(4, "fresh"), """old as (
  select unique_id, response_idx, full_response, starts_with(full_response, 'Error generating response:') or trim(full_response) = '' as failed,
         count(*) filter (starts_with(full_response, 'Error generating response:') or trim(full_response) = '')
           over (partition by unique_id order by response_idx) as failed_rank
  from responses)""", """good as (
  select unique_id, count(*) filter (not failed) as n_good, count(*) as n_old from old group by unique_id)""", """slots as (
  select o.unique_id, o.response_idx as pos, case when o.failed and f.full_response is not null then f.full_response else o.full_response end as t
  from old o join good g on o.unique_id = g.unique_id and g.n_good >= 2
  left join fresh f on f.unique_id = o.unique_id and o.failed and f.response_idx = o.failed_rank - 1
  union all
  select o.unique_id, o.response_idx, o.full_response from old o join good g on o.unique_id = g.unique_id and g.n_good < 2 where not o.failed
  union all
  select f.unique_id, 1000 + f.response_idx, f.full_response from fresh f join good g on f.unique_id = g.unique_id and g.n_good < 2)""") + """
select unique_id, string_agg(t, '|' order by pos) as responses from slots group by unique_id"""


@query("retry_merge", _MERGE_SQL)
def merge(spark, d):
    stored, fresh = views.raw_results(spark, d), views.raw_results(spark, d, shift=4)
    return _joined_responses(resume.retry_merge(stored, fresh, k=2))


@query("upsert_results", with_views(QUESTIONS, responses(), responses(4, "fresh")) + """
select unique_id, string_agg(full_response, '|' order by response_idx) as responses
from (select * from responses where doc_id not in (select doc_id from labels)
      union all select * from fresh where doc_id in (select doc_id from labels))
group by unique_id""")
def upserted(spark, d):
    """Write a first version of the store, replace the labelled questions, read the current one."""
    store = ResultStore(spark, fresh_dir(spark, "results"))
    store.replace(views.raw_results(spark, d))
    return _joined_responses(store.upsert(_existing(spark, d, shift=4)))


@query("dedup_last", """
select source, doc_id, n_chars from (
  select *, row_number() over (partition by source order by doc_id desc) as r from documents) where r = 1""")
def last_wins(spark, d):
    docs = _documents(spark, d).select("source", "doc_id", "n_chars")
    return resume.dedup_last(docs, "source", "doc_id")


_UNIFIED_SQL = """
select cast(doc_id as varchar) as row_id, text as problem, cast(n_chars as varchar) as answer, cast(null as varchar) as problem_type,
       cast(n_chars % 1024 as double) / 1024 as think_probability, 1 - cast(n_chars % 1024 as double) / 1024 as no_think_probability
from documents
union all
select cast(page_id as varchar), url, 'n/a', null, cast(length(html) % 512 as double) / 512, 1 - cast(length(html) % 512 as double) / 512 from pages
union all
select cast(item_id as varchar), text, cast(length(text) as varchar), 'benchmark|text', cast(length(text) % 256 as double) / 256,
       1 - cast(length(text) % 256 as double) / 256 from benchmark"""


@query("predictions_unified", _UNIFIED_SQL)
def unified(spark, d):
    """Three layouts of stored predictions, brought to one schema."""

    def score(text, base):
        return (F.length(text) % base).cast("double") / base

    docs = _documents(spark, d)
    think = (F.col("n_chars") % 1024).cast("double") / 1024
    first = docs.select(
        F.col("text").alias("problem"), F.col("n_chars").alias("answer"), F.col("doc_id").alias("id"),
        think.alias("think_probability"), (1 - think).alias("no_think_probability"),
    )
    second = views.table(spark, d, "pages").select(
        F.col("url").alias("problem"), F.lit("n/a").alias("answer"), F.col("page_id").cast("string").alias("id"),
        (1 - score("html", 512)).alias("no_think_score"), score("html", 512).alias("think_score"),
    )
    third = views.table(spark, d, "benchmark").select(
        F.col("item_id").alias("problem_idx"), F.col("text").alias("problem"),
        F.length("text").cast("string").alias("answer"), F.array(F.lit("benchmark"), F.lit("text")).alias("problem_type"),
        score("text", 256).alias("think_probability"), (1 - score("text", 256)).alias("no_think_probability"),
    )
    merged = predictions.union_predictions([first, second, third])
    return merged.withColumn("problem_type", F.array_join("problem_type", "|"))


@query("gold_answer", with_views(QUESTIONS) + """
select unique_id, case when is_mcq then concat('\\boxed{', chr(65 + choice_index_correct), '}') else answer_correct end as gold
from questions""")
def gold(spark, d):
    return views.questions(spark, d).select("unique_id", grading.row_gold().alias("gold"))


def echo_generator(request):
    """A deterministic stand-in for a model: fails, stays blank or answers by row and sample."""
    kind = (request["doc_id"] + request["response_idx"]) % 5
    if kind == 0:
        raise TimeoutError("timeout")
    if kind == 1:
        return "  "
    return f"  <answer>\\boxed{{{kind}}}</answer>\n"


_GENERATED = """generated as (
  select doc_id, md5(cast(doc_id as varchar)) as unique_id, i, (doc_id + i) % 5 as kind,
         case (doc_id + i) % 5 when 0 then 'Error generating response: timeout' when 1 then ''
              else concat('<answer>\\boxed{', cast((doc_id + i) % 5 as varchar), '}</answer>') end as t
  from documents, (values (0), (1)) v(i))"""


def _prompts(spark, d):
    return views.questions(spark, d).select("unique_id", "doc_id", "problem", "choices")


@query("generate_k", with_views(_GENERATED) + """
select unique_id, string_agg(t, '|' order by i) as responses, bool_or(kind <> 0) as success from generated group by unique_id""")
def generated(spark, d):
    ship_package()
    made = generate_nested(_prompts(spark, d), echo_generator, k=2, max_workers=4)
    return _joined_responses(made.withColumn("unique_id", F.struct("unique_id", "success"))).select(
        "unique_id.*", "responses"
    )


@query("drop_failed", """
select md5(cast(doc_id as varchar)) as unique_id from documents where doc_id % 5 <> 0""")
def dropped(spark, d):
    ship_package()
    made = generate_nested(_prompts(spark, d), echo_generator, k=1, max_workers=4)
    return drop_failed_prompts(made).select("unique_id")


@query("collect_job", with_views(_GENERATED) + """
select unique_id, string_agg(t, '|' order by i) as responses from generated group by unique_id""")
def collected(spark, d):
    """The composed collection job on an empty store, in three committed batches."""
    from signalbox.plans.jobs import collect_job

    ship_package()
    dataset = views.questions(spark, d)
    size = -(-dataset.count() // 3)
    made = collect_job(
        dataset, fresh_dir(spark, "collected"), echo_generator,
        k=2, batch_size=max(size, 1), order_col="doc_id", max_workers=4,
    )
    return _joined_responses(made)


@query("collect_job_resumed", with_views(_GENERATED) + """
select unique_id, string_agg(t, '|' order by i) as responses from generated group by unique_id""")
def collected_again(spark, d):
    """A store that holds part of the questions; the run collects the rest, and one more run finds nothing left."""
    from signalbox.plans.jobs import collect_job

    ship_package()
    dataset, path = views.questions(spark, d), fresh_dir(spark, "collected")
    options = {"k": 2, "order_col": "doc_id", "max_workers": 4}
    for part in (dataset.where("is_mcq"), dataset, dataset):
        made = collect_job(part, path, echo_generator, **options)
    return _joined_responses(made)


def again_generator(request):
    """A stand-in for a model that is up again."""
    return f"again {request['response_idx']}"


@query("collect_job_retry", with_views(_GENERATED) + """
select unique_id, concat_ws('|', string_agg(case when bad = 0 or kind > 1 then t end, '|' order by i), case when bad > 0 then 'again 0|again 1' end) as responses
from (select *, count(*) filter (kind < 2) over (partition by unique_id) as bad from generated) group by unique_id, bad""")
def collected_retry(spark, d):
    """Failed samples are collected again and merged into the stored ones."""
    from signalbox.plans.jobs import collect_job

    ship_package()
    dataset, path = views.questions(spark, d), fresh_dir(spark, "collected")
    options = {"k": 2, "order_col": "doc_id", "max_workers": 4}
    collect_job(dataset, path, echo_generator, **options)
    return _joined_responses(collect_job(dataset, path, again_generator, retry_failed=True, **options))


def down_generator(request):
    """A stand-in for a model that does not answer."""
    raise TimeoutError("timeout")


_DOWN = """
select md5(cast(doc_id as varchar)) as unique_id, 'Error generating response: timeout' as responses
from (select doc_id, row_number() over (order by doc_id) as n, count(*) over () as total from documents)"""


def _collect_down(spark, d, on_all_failed):
    from signalbox.plans.jobs import collect_job

    ship_package()
    dataset = views.questions(spark, d)
    size = max(-(-dataset.count() // 3), 1)
    made = collect_job(
        dataset, fresh_dir(spark, "collected"), down_generator,
        batch_size=size, order_col="doc_id", max_workers=4, on_all_failed=on_all_failed,
    )
    return _joined_responses(made)


@query("collect_job_stopped", _DOWN + " where n <= (total + 2) // 3")
def collected_until_down(spark, d):
    """A batch without any answer ends the run; what is committed stays."""
    return _collect_down(spark, d, "stop")


@query("collect_job_continued", _DOWN)
def collected_while_down(spark, d):
    """Told to go on, the run stores the failures of all batches, for a later retry."""
    return _collect_down(spark, d, "continue")


@query("cascade_job", with_views(*GRADED, _GENERATED) + """
select unique_id, string_agg(t, '|' order by i) as responses from generated
where unique_id in (select unique_id from graded group by unique_id
                    having 1 - least(count(*) filter (is_correct), 2) / least(count(*), 2) > 0.5)
group by unique_id""")
def cascaded(spark, d):
    """The strong model runs only on what the weak results fail."""
    from signalbox.plans.jobs import cascade_job

    ship_package()
    weak = materialize(views.graded_results(spark, d), "weak")
    made = cascade_job(
        weak, fresh_dir(spark, "cascade"), echo_generator, fresh_dir(spark, "failed"),
        k=2, order_col="doc_id", max_workers=4,
    )
    return _joined_responses(made)
