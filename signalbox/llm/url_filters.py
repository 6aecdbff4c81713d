"""URL filters as a temporal list join.

A block list is a log of dated entries: a pattern was added to or removed from a list. The log becomes
validity intervals, and every capture is judged by the entries that were active when it was fetched,
not by the list of today.

Patterns are hosts, which cover their subdomains, or a host with leading path segments. A capture
looks up its own host, its parent domains and its path prefixes. The as-of join is an equi-join on
pattern and time slice: an interval stands in each slice it touches, a capture in one, so a host with a
third of all captures is spread over the slices and meets few intervals in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices of the span of capture times, by which captures and intervals meet.
SLICES = 24


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``list_name, pattern, valid_from, valid_to`` from ``entries(list_name, pattern, action, at)``.

    ``action`` is ``add`` or ``remove``, ``at`` a whole number (days, seconds). Adding what is listed,
    removing what is not, and repeated entries change nothing; of entries of one time an ``add`` wins.
    ``valid_to`` is exclusive, null while the entry is listed. Rows with a null or another action are
    left out. Patterns are compared in lower case.
    """
    log = (
        entries.select("list_name", F.lower("pattern").alias("pattern"), F.lower("action").alias("action"), F.col("at").cast("long").alias("at"))
        .where("list_name is not null and pattern is not null and at is not null and action in ('add', 'remove')")
        .groupBy("list_name", "pattern", "at").agg(F.max((F.col("action") == "add").cast("int")).alias("listed"))
    )
    by_time = W.partitionBy("list_name", "pattern").orderBy("at")
    changes = log.withColumn("before", F.coalesce(F.lag("listed").over(by_time), F.lit(0))).where("listed <> before")
    return (
        changes.withColumn("valid_to", F.lead("at").over(by_time)).where("listed = 1")
        .select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def url_host(url):
    """Lower-case host of a url, without user and port; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def url_patterns(url):
    """All patterns that cover a url: its host, parent domains of two labels or more, and path prefixes."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def judged(captures: DataFrame, intervals: DataFrame, id_col: str = "page_id", url_col: str = "url",
           time_col: str = "fetched", slices: int = SLICES) -> DataFrame:
    """``captures`` with ``blocked, n_matches, list_name, pattern, valid_from`` of each row.

    The columns name the most specific active entry: the longest pattern, then the least pattern and
    list. A row without a url, host or time matches nothing. Rows with equal id, url and time are
    judged alike, and all rows stay. Columns of ``captures`` with one of the five names are replaced.
    Times are whole numbers of any unit: their span is cut into ``slices``, so an interval is repeated
    that often at the most, whether times are days or seconds.
    """
    added = ("blocked", "n_matches", "list_name", "pattern", "valid_from")
    captures = captures.drop(*added)
    probes = captures.select(F.col(url_col).alias("_url"), F.col(time_col).cast("long").alias("_at")).where("_url is not null and _at is not null")
    first, last = probes.agg(F.min("_at"), F.max("_at")).first()
    if last is None:
        first = last = 0
    size = (last - first) // slices + 1
    # Probes are few bytes each but become many patterns, so they are dealt to all tasks first.
    tasks = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probes = probes.distinct().repartition(tasks).withColumn("slice", F.floor((F.col("_at") - first) / size))

    def slice_of(time):
        return F.floor((F.greatest(time, F.lit(first)) - first) / size)

    reaching = intervals.where((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first)))
    end = F.least(F.coalesce("valid_to", F.lit(last) + 1) - 1, F.lit(last))
    spread = reaching.withColumn("slice", F.explode(F.sequence(slice_of(F.col("valid_from")), F.greatest(slice_of(F.col("valid_from")), slice_of(end)))))
    active = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    found = (
        probes.withColumn("pattern", F.explode(url_patterns(F.col("_url")))).join(spread, ["pattern", "slice"]).where(active)
        .groupBy("_url", "_at").agg(
            F.count("*").alias("n_matches"),
            F.min(F.struct((-F.length("pattern")).alias("rank"), "pattern", "list_name", "valid_from")).alias("best"))
    )
    same = (captures[url_col] == found["_url"]) & (captures[time_col].cast("long") == found["_at"])
    return captures.join(found, same, "left").select(
        *[captures[f"`{c}`"] for c in captures.columns], F.col("n_matches").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        "best.list_name", "best.pattern", "best.valid_from")
