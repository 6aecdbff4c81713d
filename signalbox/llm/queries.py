"""Queries ``opN_<name>``: each operator over its whole table, reduced to the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import (
    decontaminate, language_mixture, lexical_search, license_scan, mixing, ngram_join, periodic_runs, quality_rules,
    secret_scan, token_counts, toxicity, url_filters, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a function under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels.where("quality = 1").select("doc_id"))


def held_out(column: str, folds: int, fold: int):
    """True for rows of the fold that learning never sees."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == fold


@query
def op4_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_mixture.identify(docs, docs.where(~held_out("doc_id", 4, 2)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "mixture")


@query
def op7_secret_scan(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def counted(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    base = F.filter("findings", lambda f: f["kind"] != "literal")
    return found.select(
        "doc_id", counted("assign"), counted("access"), counted("hex"),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"), counted("literal"))


@query
def op6_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["template"] < len(license_scan.PHRASES))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


@query
def op10_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, docs, labels.where(~held_out("doc_id", 5, 0)))
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


#: Shares of tokens that the mixture should have, by the domains of the labelled table.
MIX_TARGETS = {"quality1_toxic0": 0.85, "quality1_toxic1": 0.05, "quality0_toxic0": 0.09, "quality0_toxic1": 0.01}


def labelled_domains(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null and toxic is not null").select(
        "doc_id", F.concat(F.lit("quality"), "quality", F.lit("_toxic"), "toxic").alias("domain"))


@query
def op3_soft_mixing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mixing_rates(docs, labelled_domains(labels), MIX_TARGETS)


@query
def op9_warc_transactions(spark, sf_dir):
    found = warc.archived(table(spark, sf_dir, "pages"))
    found = found.where("main is not null").select(
        "capture_id", "main.*", F.size("requests").alias("n_requests"),
        F.element_at(F.try_element_at("metadata", F.lit(1))["fields"], "page-id").try_cast("long").alias("page_id"))
    response = found.where("type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("response_page"))
    return found.join(response, "refers_to", "left").select(
        "page_id", "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("response_page").alias("refers_to"), F.col("uri").alias("url"), "n_requests")


#: Time of a page and a number of a text, in words both engines know: pages have no fetch time, lists no table.
_FETCHED = "cast(page_id * 7919 % 730 as bigint)"
_NUMBER = "(length({0}) * 31 + ascii(substr({0}, 3, 1)) * 7 + ascii(substr({0}, 5, 1)))"
_ENTRIES = """
select 'hosts' as list_name, host as pattern, 'add' as action, n % 200 as on_day from (select distinct host, {host_n} as n from hosts) h where n % 2 = 0
union all select 'hosts', host, 'remove', n % 200 + 90 + n % 150 from (select distinct host, {host_n} as n from hosts) h where n % 2 = 0
union all select 'hosts', host, 'add', 450 + n % 40 from (select distinct host, {host_n} as n from hosts) h where n % 4 = 0
union all select 'domains', domain, 'add', n % 300 from (select distinct domain, {domain_n} as n from hosts) h where n % 3 = 0
union all select 'domains', domain, 'add', n % 300 + 20 from (select distinct domain, {domain_n} as n from hosts) h where n % 3 = 0
union all select 'domains', domain, 'remove', n % 300 + 60 from (select distinct domain, {domain_n} as n from hosts) h where n % 3 = 0
union all select 'sections', section, 'add', n % 500 from (select distinct section, {section_n} as n from hosts) h where n % 3 = 1
""".format(host_n=_NUMBER.format("host"), domain_n=_NUMBER.format("domain"), section_n=_NUMBER.format("section"))


def listed_entries(pages: DataFrame) -> DataFrame:
    """A dated log of list entries derived from the hosts, domains and sections of ``pages``."""
    host, parts = url_filters.url_host(F.col("url")), F.filter(F.split(F.regexp_extract("url", "^[a-z]+://[^/?#]*/([^?#]*)", 1), "/"), lambda p: p != "")
    hosts = pages.select(
        host.alias("host"), F.regexp_replace(host, r"^[^.]*\.(?=.*\.)", "").alias("domain"),
        F.concat(host, F.lit("/"), F.lower(F.element_at(F.concat(parts, F.array(F.lit(""))), 1))).alias("section")).where("host is not null")
    return hosts.sparkSession.sql(_ENTRIES.replace("from hosts", "from {hosts}"), hosts=hosts.distinct()).withColumnRenamed("on_day", "at")


@query
def op2_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched"))
    intervals = url_filters.validity_intervals(listed_entries(pages))
    return url_filters.judged(pages, intervals)


SQL["op2_url_filters"] = f"""
with pages_at as (select page_id, url, {_FETCHED} as fetched, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host,
                         list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*/([^?#]*)', 1), '/'), lambda p: p <> '') as parts from pages),
hosts as (select distinct host, case when length(host) - length(replace(host, '.', '')) > 1 then substr(host, strpos(host, '.') + 1) else host end as domain,
                 host || '/' || lower(coalesce(parts[1], '')) as section from pages_at),
entries as ({_ENTRIES}),
log as (select list_name, pattern, cast(on_day as bigint) as on_day, max(cast(action = 'add' as int)) as listed from entries group by all),
changes as (select * from (select *, coalesce(lag(listed) over (partition by list_name, pattern order by on_day), 0) as before from log) where listed <> before),
intervals as (select * from (select list_name, pattern, on_day as valid_from, listed, lead(on_day) over (partition by list_name, pattern order by on_day) as valid_to from changes) where listed = 1),
probes as (select page_id, fetched, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || lower(array_to_string(parts[1:i], '/')))))) as pattern from pages_at),
matches as (select page_id, p.pattern, list_name, valid_from from probes p join intervals i on p.pattern = i.pattern
    where valid_from <= fetched and (valid_to is null or fetched < valid_to)),
ranked as (select *, count(*) over (partition by page_id) as n,
    row_number() over (partition by page_id order by length(pattern) desc, pattern, list_name) as r from matches)
select a.page_id, a.url, a.fetched, n is not null as blocked, coalesce(n, 0) as n_matches, list_name, pattern, valid_from
from pages_at a left join ranked r on a.page_id = r.page_id and r.r = 1
"""


@query
def op11_lexical_search(spark, sf_dir):
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op11_lexical_search"] = r"""
with words as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
item_terms as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
total as (select count(*) as documents, cast(sum(len(terms)) as bigint) as length from words where len(terms) > 0),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from words)
             where term in (select term from item_terms) group by all),
weights as (select term, cast(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) as bigint) as weight
            from (select term, count(*) as df from postings group by term), total),
norms as (select doc_id, 10 + (90 * len(terms) * documents) // length as m from words, total where len(terms) > 0),
impacts as (select doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) as part
            from postings join weights using (term) join norms using (doc_id)),
scores as (select item_id, doc_id, cast(sum(part) as bigint) as score from item_terms join impacts using (term) group by all),
ranks as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranks where rank <= 10
"""


@query
def op12_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Words of a text as the run detection sees them, and those of every tenth document made periodic from a place on.
_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: documents chosen by their id repeat their words from a place on, with a period."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    listed = hashed.withColumn("words", F.expr(f"case when h % 10 = 0 then {_WORDS} end"))
    placed = listed.withColumn("n", F.size("words")).withColumn("a", F.expr("case when n > 0 then cast((h div 10) % n as int) end"))
    cycled = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    planted = F.expr(
        "array_join(concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)), ' ')")
    return cycled.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # Runs come by start and period, so the first of the greatest length / period is the one to name.
    best = F.expr(
        "reduce(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
