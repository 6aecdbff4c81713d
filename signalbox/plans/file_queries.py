"""Queries over readers and sinks: what is written comes back, and what is damaged is accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.text import MIME_TYPES
from signalbox.operators import evaluation
from signalbox.plans import views
from signalbox.plans.registry import query, rounded
from signalbox.plans.router_queries import SWEEP
from signalbox.plans.sql_views import PREDICTIONS, with_views
from signalbox.session import fresh_dir
from signalbox.sources import images, jsonl

_ROW = T.StructType([
    T.StructField("unique_id", T.StringType()), T.StructField("problem", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def _question(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", F.md5(F.col("doc_id").cast("string")).alias("unique_id"), F.col("text").alias("problem"),
        F.col("n_chars").cast("long").alias("n_chars"),
    )


def _lines(rows):
    """JSON lines of which every seventh breaks off, and every seventh has an empty line before it."""
    whole = F.to_json(F.struct(*_ROW.names))
    broken = F.concat(F.lit('{"unique_id": "'), "unique_id")
    line = F.when(F.col("doc_id") % 7 == 0, broken).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("  \n"), whole)).otherwise(whole)
    return rows.select("doc_id", line.alias("value"))


_LINES = """lines as (
  select md5(cast(doc_id as varchar)) as unique_id, doc_id % 7 <> 0 as accepted, doc_id % 3 as part,
         case when doc_id % 7 <> 0 then cast(length(text) as bigint) end as problem_chars,
         case when doc_id % 7 = 0 then concat('{"unique_id": "', md5(cast(doc_id as varchar))) end as line
  from documents)"""


def _accounted(good, bad, *keep):
    accepted = good.select(*keep, F.length("problem").cast("long").alias("problem_chars"), "unique_id", F.lit(None).cast("string").alias("line"))
    missing = F.lit(None).cast("long").alias("problem_chars"), F.lit(None).cast("string").alias("unique_id")
    return accepted.unionByName(bad.select(*keep, *missing, "line"))


@query("read_tolerant_checks", with_views(_LINES) + """
select case when accepted then unique_id end as unique_id, problem_chars, line from lines""")
def tolerant(spark, d):
    """Every line is either a row or a reject; both come from one parse of the files."""
    path = fresh_dir(spark, "damaged-lines")
    _lines(_question(spark, d)).select("value").write.text(path)
    return _accounted(*jsonl.store_tolerant(spark, path, _ROW, fresh_dir(spark, "parsed")))


@query("split_folder_checks", with_views(_LINES) + """
select case part when 0 then 'train' when 1 then 'validation' else 'test' end as split,
       case when accepted then unique_id end as unique_id, problem_chars, line from lines""")
def split_folder(spark, d):
    """A folder of damaged split files: rows and rejects by split."""
    path = fresh_dir(spark, "damaged-splits")
    lines = _lines(_question(spark, d))
    for rest, stem in enumerate(("train", "bank_val", "test")):
        lines.filter(F.col("doc_id") % 3 == rest).select("value").write.text(f"{path}/{stem}.jsonl")
    splits, bad = jsonl.store_split_folder(spark, path, _ROW, fresh_dir(spark, "parsed"))
    good = None
    for name, rows in splits.items():
        part = rows.withColumn("split", F.lit(name))
        good = part if good is None else good.unionByName(part)
    return _accounted(good, bad, "split")


@query("write_splits", """
select case doc_id % 3 when 0 then 'train' when 1 then 'validation' else 'test' end as split,
       md5(cast(doc_id as varchar)) as unique_id, cast(length(text) as bigint) as problem_chars from documents""")
def split_sink(spark, d):
    """One folder per split, each read back by itself."""
    names = F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path = fresh_dir(spark, "splits")
    jsonl.write_splits(_question(spark, d).withColumn("split", names).drop("doc_id"), path)
    found = None
    for name in ("train", "validation", "test"):
        part = jsonl.read_strict(spark, f"{path}/split={name}", _ROW).withColumn("split", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found.select("split", "unique_id", F.length("problem").cast("long").alias("problem_chars"))


@query("append_results", """
select md5(cast(doc_id as varchar)) as unique_id, cast(length(text) as bigint) as problem_chars, n_chars from documents
union all select md5(cast(doc_id as varchar)), cast(length(text) as bigint), n_chars from documents where doc_id % 2 = 0""")
def appended(spark, d):
    """A second batch adds to the first and changes nothing of it."""
    path, rows = fresh_dir(spark, "appended"), _question(spark, d)
    for batch in (rows, rows.filter("doc_id % 2 = 0")):
        jsonl.append_jsonl(batch.drop("doc_id"), path)
    return jsonl.read_strict(spark, path, _ROW).select("unique_id", F.length("problem").cast("long").alias("problem_chars"), "n_chars")


@query("threshold_report", with_views(PREDICTIONS, SWEEP) + """
select threshold, round(think_percentage, 6) as think_percentage, think_count, no_think_count, round(accuracy, 6) as accuracy,
       (select threshold from sweep order by accuracy desc, threshold limit 1) as best_threshold,
       (select round(accuracy, 6) from sweep order by accuracy desc, threshold limit 1) as best_accuracy from sweep""")
def report(spark, d):
    """The report file holds all thresholds and the best one."""
    path = fresh_dir(spark, "report")
    sweep = evaluation.threshold_sweep(views.predictions(spark, d))
    jsonl.write_threshold_report(sweep, path, evaluation.best_threshold(sweep))
    row = "threshold double, think_percentage double, think_count long, no_think_count long, accuracy double"
    schema = T.StructType.fromDDL(f"threshold_results array<struct<{row.replace(' ', ':').replace(',:', ',')}>>, best_threshold double, best_accuracy double")
    stored = jsonl.read_strict(spark, path, schema)
    return rounded(stored.select(F.inline("threshold_results"), "best_threshold", "best_accuracy"), "think_percentage", "accuracy", "best_accuracy")


_ENDINGS = [*MIME_TYPES, ""]


@query("image_data_urls", f"""
with paths as (select page_id, encode(html) as content,
         concat('/images/', cast(page_id as varchar), (list_value({", ".join(f"'{e}'" for e in _ENDINGS)}))[page_id % {len(_ENDINGS)} + 1]) as path,
         (list_value({", ".join(f"'{m}'" for m in [*MIME_TYPES.values(), "image/jpeg"])}))[page_id % {len(_ENDINGS)} + 1] as mime from pages)
select page_id, path as image, concat('data:', mime, ';base64,', base64(content)) as image_url from paths
union all select page_id, url, url from pages""")
def image_urls(spark, d):
    """Stored content as data URLs for references by path; web addresses stay as they are."""
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("page_id") % len(_ENDINGS)).cast("int"))
    pages = views.table(spark, d, "pages").select(
        "page_id", "url", "html", F.concat(F.lit("/images/"), F.col("page_id").cast("string"), ending).alias("path")
    )
    stored = pages.select("path", images.data_url(F.col("path"), F.encode("html", "UTF-8")).alias("image_url"))
    references = pages.select("page_id", F.explode(F.array("path", "url")).alias("image"))
    return images.resolve_images(references, stored).select("page_id", "image", "image_url")
