"""Queries over prompts, messages, history, chunk assembly and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalbox.functions import text as T
from signalbox.operators import history, messages, prompts
from signalbox.operators.grading import row_gold
from signalbox.plans import views
from signalbox.plans.registry import query
from signalbox.plans.router_queries import SELECT_SQL, requests_of
from signalbox.plans.sql_views import CHUNKS, QUESTIONS, RAW, TURN_PAIRS, with_views
from signalbox.session import ship_package
from signalbox.streaming.assembly import assemble_stream
from signalbox.streaming.history import history_stream
from signalbox.streaming.routing import route_stream
from signalbox.streaming.sinks import latest_updates, replay_in_slices, run_append, run_updates


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rendered(template: str, **slots: str) -> str:
    """SQL text of a template: a concat of its pieces, written out by splitting on the slots."""
    body = template.removesuffix("\n")
    for name, expr in slots.items():
        body = body.replace("{{ " + name + " }}", f"\0{expr}\0")
    pieces = body.split("\0")
    return "concat(" + ", ".join(_literal(p) if i % 2 == 0 else p for i, p in enumerate(pieces)) + ")"


_LETTERED = "list_transform(choices, lambda c, i: concat(chr(cast(64 + i as integer)), '. ', c))"
_OPTIONS = "array_to_string(list_transform({lines}, lambda l: concat(chr(10), l, chr(10))), '')"
_MCQ_PROMPT = _rendered(prompts.CHOICE_TEMPLATE, question="problem", options=_OPTIONS.format(lines=_LETTERED))


@query("prompt_render", with_views(QUESTIONS) + f"""
select unique_id, is_mcq, case when is_mcq then {_MCQ_PROMPT} else {_rendered(prompts.MATH_TEMPLATE, question='problem')} end as prompt
from questions""")
def rendered(spark, d):
    out = prompts.with_prompts(views.questions(spark, d).drop("is_mcq"))
    return out.select("unique_id", "is_mcq", "prompt")


@query("prompt_render_open_ended", with_views(QUESTIONS) + f"""
select unique_id, case when is_mcq then {_MCQ_PROMPT} else {_rendered(prompts.OPEN_ENDED_TEMPLATE, question='problem')} end as prompt
from questions""")
def rendered_open(spark, d):
    out = prompts.with_prompts(views.questions(spark, d).drop("is_mcq"), open_ended=True)
    return out.select("unique_id", "prompt")


@query("prompt_render_subjective", with_views(QUESTIONS) + f"""
select unique_id, {_rendered(prompts.SUBJECTIVE_TEMPLATE, question='problem')} as prompt from questions""")
def rendered_subjective(spark, d):
    return views.questions(spark, d).select(
        "unique_id", prompts.subjective_prompt(F.col("problem")).alias("prompt")
    )


@query("format_choices", with_views(QUESTIONS) + f"""
select unique_id, array_to_string({_LETTERED}, '|') as choices from questions where choices is not null""")
def lettered(spark, d):
    mcq = views.questions(spark, d).filter(F.col("choices").isNotNull())
    return mcq.select(
        "unique_id", F.array_join(prompts.format_choices(F.col("choices")), "|").alias("choices")
    )


def _judge_sql(lines: str) -> str:
    listed = _OPTIONS.format(lines=f"list_transform({lines}, lambda c, i: concat(chr(cast(64 + i as integer)), ': ', c))")
    slots = {"question": "problem", "answer": "full_response", "correct_answer": "gold"}
    return with_views(*RAW) + f"""
select unique_id, response_idx, case when is_mcq then {_rendered(prompts.CHOICE_JUDGE_TEMPLATE, options=listed, **slots)}
       else {_rendered(prompts.JUDGE_TEMPLATE, **slots)} end as prompt
from responses"""


def _judge_prompts(spark, d, compat):
    from signalbox.operators.grading import explode_responses

    rows = explode_responses(views.raw_results(spark, d))
    prompt = prompts.judge_prompt(
        F.col("problem"), F.col("full_response"), row_gold(), F.col("choices"), F.col("is_mcq"), compat
    )
    return rows.select("unique_id", "response_idx", prompt.alias("prompt"))


@query("judge_prompt", _judge_sql("choices"))
def judge_prompt(spark, d):
    return _judge_prompts(spark, d, compat=False)


@query("judge_prompt_compat", _judge_sql(_LETTERED))
def judge_prompt_compat(spark, d):
    return _judge_prompts(spark, d, compat=True)


@query("build_messages", with_views(QUESTIONS) + f"""
select unique_id, case when is_mcq then concat('system:', '{messages.DEFAULT_SYSTEM_PROMPT}', '|user:', problem)
                       else concat('user:', problem) end as messages from questions""")
def built_messages(spark, d):
    """Half of the requests ask for the default system message."""
    system = F.when(F.col("is_mcq"), messages.system_or_default(F.lit("")))
    built = messages.build_messages(F.col("problem"), system)
    flat = F.array_join(F.transform(built, lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return views.questions(spark, d).select("unique_id", flat.alias("messages"))


@query("message_content", """
select page_id, concat('text:', html, '|image_url:', url) as content from pages""")
def contents(spark, d):
    items = messages.message_content(F.col("html"), F.array("url"))
    flat = F.transform(items, lambda i: F.concat_ws(":", i["type"], F.coalesce(i["text"], i["image_url"]["url"])))
    return views.table(spark, d, "pages").select("page_id", F.array_join(flat, "|").alias("content"))


@query("is_url", """
select page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') as address_is_url,
       regexp_matches(html, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') as content_is_url from pages""")
def urls(spark, d):
    return views.table(spark, d, "pages").select(
        "page_id", T.is_url(F.col("url")).alias("address_is_url"), T.is_url(F.col("html")).alias("content_is_url")
    )


_EXTENSIONS = "['.jpg', '.JPEG', '.png', '.webp', '.Gif', '.bmp', '.tiff', '']"


@query("mime_type", f"""
select doc_id, path, case lower({_EXTENSIONS}[doc_id % 8 + 1]) when '.png' then 'image/png' when '.webp' then 'image/webp'
       when '.gif' then 'image/gif' when '.bmp' then 'image/bmp' else 'image/jpeg' end as mime
from (select doc_id, concat('/images/', source, '/', cast(doc_id as varchar), {_EXTENSIONS}[doc_id % 8 + 1]) as path from documents)""")
def mimes(spark, d):
    endings = F.array(*[F.lit(e) for e in (".jpg", ".JPEG", ".png", ".webp", ".Gif", ".bmp", ".tiff", "")])
    path = F.concat(
        F.lit("/images/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 8).cast("int"))
    )
    docs = views.table(spark, d, "documents").select("doc_id", path.alias("path"))
    return docs.withColumn("mime", T.mime_type(F.col("path")))


@query("html_error", f"""
select 'page' as kind, page_id as id, '{T.UNAVAILABLE_REPLY}' as reply from pages
union all select 'page error', page_id, '{T.UNAVAILABLE_REPLY}' from pages
union all select 'document', doc_id, text from documents
union all select 'document error', doc_id, concat('{T.ERROR_REPLY_PREFIX}', text) from documents""")
def html_errors(spark, d):
    """Pages are error pages as content and inside an error text; plain documents are neither."""

    def replies(df, key, column, kind):
        text, none = F.col(column), F.lit(None).cast("string")
        padded = F.concat(F.lit("\n  "), text) if kind == "page" else text
        as_content = df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), T.reply_content(padded, none).alias("reply"))
        in_error = F.concat(F.lit("503: "), text) if kind == "page" else text
        as_error = df.select(
            F.lit(f"{kind} error").alias("kind"), F.col(key).alias("id"), T.reply_content(none, in_error).alias("reply")
        )
        return as_content.unionByName(as_error)

    pages = replies(views.table(spark, d, "pages"), "page_id", "html", "page")
    return pages.unionByName(replies(views.table(spark, d, "documents"), "doc_id", "text", "document"))


@query("name_tail", "select page_id, list_extract(string_split(url, '/'), -1) as tail from pages")
def tails(spark, d):
    return views.table(spark, d, "pages").select("page_id", T.name_tail(F.col("url")).alias("tail"))


@query("slug", """
select doc_id, concat(upper(left(source, 1)), substring(source, 2), ' Lang-', upper(left(lang, 1)), substring(lang, 2), ' 2Nd') as display_name,
       concat(source, '-lang-', lang, '-2nd') as slug from documents""")
def slugs(spark, d):
    folder = F.concat("source", F.lit("_lang-"), "lang", F.lit("_2nd"))
    named = views.table(spark, d, "documents").select("doc_id", T.display_name_of_folder(folder).alias("display_name"))
    return named.withColumn("slug", T.repository_slug(F.col("display_name")))


@query("turn_pairs", with_views(TURN_PAIRS) + """
select conv_id, cast(pair_id as bigint) as pair_id, user_text as "user", assistant_text as assistant from pairs""")
def pairs(spark, d):
    return history.turn_pairs(views.conversations(spark, d)).withColumn("pair_id", F.col("pair_id").cast("long"))


def _history_sql(last: int) -> str:
    return with_views(TURN_PAIRS, """aged as (
  select *, row_number() over (partition by conv_id order by pair_id desc) as age from pairs)""", f"""items as (
  select conv_id, age, 0 as part, 'user' as role, user_text as content from aged where age <= {last + 1}
  union all select conv_id, age, 1, 'assistant', assistant_text from aged where age between 2 and {last + 1})""") + """
select conv_id, cast(row_number() over (partition by conv_id order by age desc, part) as integer) as position, role, content from items"""


@query("recent_history", _history_sql(10))
def recent(spark, d):
    return history.recent_history(views.conversations(spark, d), last=10)


@query("recent_history_two", _history_sql(2))
def recent_two(spark, d):
    """Two pairs, fewer than most conversations hold, with blocks of three turns."""
    return history.recent_history(views.conversations(spark, d), last=2, block=3)


_FINAL_SQL = """final as (
  select request_id, coalesce(string_agg(content, '' order by seq), '') as content,
         coalesce(string_agg(reasoning, '' order by seq), '') as reasoning from chunks group by request_id)"""
_RUNNING_SQL = """running as (
  select request_id, seq, coalesce(string_agg(content, '') over w, '') as content, coalesce(string_agg(reasoning, '') over w, '') as reasoning
  from chunks where content is not null or reasoning is not null
  window w as (partition by request_id order by seq rows between unbounded preceding and current row))"""


@query("assemble_offsets", with_views(CHUNKS, _RUNNING_SQL) + """
select request_id, seq, cast(length(content) as bigint) as content_length, cast(length(reasoning) as bigint) as reasoning_length,
       reasoning <> '' as has_reasoning from running""")
def offsets(spark, d):
    return history.assemble_offsets(views.chunks(spark, d))


@query("assemble_final", with_views(CHUNKS, _FINAL_SQL) + """
select request_id, content, reasoning, reasoning <> '' as has_reasoning from final""")
def assembled(spark, d):
    return history.assemble_final(views.chunks(spark, d))


@query("assemble_running", with_views(CHUNKS, _FINAL_SQL, _RUNNING_SQL) + """
select request_id, seq, false as is_final, content, nullif(reasoning, '') as reasoning, reasoning <> '' as has_reasoning from running
union all select request_id, null, true, content, nullif(reasoning, ''), reasoning <> '' from final""")
def running(spark, d):
    return history.assemble_running(views.chunks(spark, d))


@query("stream_route", SELECT_SQL)
def stream_route(spark, d):
    """The selector over a stream of stored requests; the rows of the batch query."""
    docs = views.table(spark, d, "documents")
    routed = replay_in_slices(docs, "doc_id", lambda rows: route_stream(requests_of(rows)), run_append, "routed")
    return routed.select("doc_id", "model_selection", "model_key", "error", "use_reasoning")


_STREAM_ASSEMBLE_SQL = with_views(CHUNKS, _FINAL_SQL) + """
select f.request_id, c.last_seq, content, reasoning, reasoning <> '' as has_reasoning
from final f join (select request_id, max(seq) as last_seq from chunks group by request_id) c on f.request_id = c.request_id"""


def _assembled(spark, d, feed):
    ship_package()
    events = views.table(spark, d, "events").select("event_id", "user_id", "event_type")
    updates = replay_in_slices(
        events, "event_id", lambda rows: assemble_stream(views.chunks_of(rows)), run_updates, "assembled", feed=feed
    )
    return latest_updates(updates, "request_id")


@query("stream_assemble", _STREAM_ASSEMBLE_SQL)
def stream_assemble(spark, d):
    """Chunks in three runs; the last update of each request is its final text."""
    return _assembled(spark, d, "forward")


@query("stream_assemble_reverse", _STREAM_ASSEMBLE_SQL)
def stream_assemble_reverse(spark, d):
    """The last chunks arrive first."""
    return _assembled(spark, d, "reverse")


@query("stream_assemble_interleaved", _STREAM_ASSEMBLE_SQL)
def stream_assemble_interleaved(spark, d):
    """Neighbouring chunks arrive in different runs."""
    return _assembled(spark, d, "interleaved")


def _recent(spark, d, feed):
    ship_package()
    rows = views.conversations(spark, d)
    updates = replay_in_slices(rows, "turn", lambda turns: history_stream(turns, last=2), run_updates, "recent", feed=feed)
    return latest_updates(updates, "conv_id")


@query("stream_history", _history_sql(2))
def stream_history(spark, d):
    """Conversations cut by turn into three runs, so every state is carried over."""
    return _recent(spark, d, "forward")


@query("stream_history_reverse", _history_sql(2))
def stream_history_reverse(spark, d):
    """The last turns arrive first."""
    return _recent(spark, d, "reverse")


@query("stream_history_interleaved", _history_sql(2))
def stream_history_interleaved(spark, d):
    """Neighbouring turns arrive in different runs."""
    return _recent(spark, d, "interleaved")
