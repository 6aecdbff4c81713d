"""Resumable collection: what failed, what to run again, and how to merge the new samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbox.functions.arrays import correct_count, graded_count
from signalbox.functions.text import is_failed_response

FULLY_FAILED, PARTIALLY_FAILED, OK = "fully_failed", "partially_failed", "ok"
NEW = "new"


def _failed_slots(responses: Column) -> Column:
    """0-based positions of unusable responses, found inside the array."""
    marked = F.transform(
        responses, lambda r, i: F.when(is_failed_response(r["full_response"]), i)
    )
    return F.array_compact(marked)


def _status_rows(results: DataFrame, failed: Column, fully: Column) -> DataFrame:
    named = results.filter(F.col("unique_id").isNotNull() & (F.col("unique_id") != ""))
    slots = named.select("unique_id", F.size("responses").alias("n_responses"), failed.alias("failed_slots"))
    state = (
        F.when(fully, F.lit(FULLY_FAILED))
        .when(F.size("failed_slots") > 0, F.lit(PARTIALLY_FAILED))
        .otherwise(F.lit(OK))
    )
    return slots.withColumn("status", state)


def response_status(results: DataFrame) -> DataFrame:
    """Status per stored question; all failed (none at all included) means fully failed."""
    fully = F.size("failed_slots") == F.col("n_responses")
    return _status_rows(results, _failed_slots(F.col("responses")), fully)


def response_status_selective(results: DataFrame, k: int) -> DataFrame:
    """Selective rule: slots missing up to ``k`` count as failed; fully failed means exactly ``k``."""
    have = F.size("responses")
    missing = F.when(have < k, F.sequence(have, F.lit(k - 1))).otherwise(F.array().cast("array<int>"))
    failed = F.concat(_failed_slots(F.col("responses")), missing)
    return _status_rows(results, failed, F.size("failed_slots") == k)


def resume_counters(status: DataFrame, k: int) -> DataFrame:
    """One row: successful, fully failed, partially failed, responses to retry."""
    fully = F.count_if(F.col("status") == FULLY_FAILED)
    partial = F.col("status") == PARTIALLY_FAILED
    partial_slots = F.coalesce(F.sum(F.when(partial, F.size("failed_slots"))), F.lit(0))
    return status.agg(
        F.count_if(F.col("status") != FULLY_FAILED).alias("successful"),
        fully.alias("fully_failed"),
        F.count_if(partial).alias("partially_failed"),
        (fully * k + partial_slots).cast("long").alias("responses_to_retry"),
    )


def with_default_id(dataset: DataFrame, index: str = "idx") -> DataFrame:
    """A question without an id is called ``q{row number}``."""
    fallback = F.concat(F.lit("q"), F.col(index).cast("string"))
    return dataset.withColumn("unique_id", F.coalesce("unique_id", fallback))


def resume_plan(dataset: DataFrame, status: DataFrame, retry_failed: bool, k: int = 1) -> DataFrame:
    """Questions to process now, with ``reason`` and the slots to regenerate.

    New questions always run; failed ones only on retry; finished ones never. ``status`` is a narrow frame.
    Questions that are certainly not in it are new without a join; of the others the ids are joined first, and
    only those that run meet their status whole.
    """
    known = status.select("unique_id", "status", "failed_slots")
    reason = F.coalesce("status", F.lit(NEW))
    wanted = [NEW, FULLY_FAILED, PARTIALLY_FAILED] if retry_failed else [NEW]
    listed = with_membership(dataset, known)
    ids = with_membership(dataset.select("unique_id"), known).where("_listed").select("unique_id")
    ids = ids.join(known, "unique_id", "left").where(reason.isin(wanted)).select("unique_id").distinct()
    open_rows = with_membership(listed.where("_listed").drop("_listed"), ids).where("_listed").drop("_listed")
    no_status = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("status", "failed_slots")]
    joined = open_rows.join(known, "unique_id", "left").unionByName(
        listed.where("not _listed").drop("_listed").select("*", *no_status))
    every_slot = F.sequence(F.lit(0), F.lit(k - 1))
    return (
        joined.withColumn("reason", reason)
        .filter(F.col("reason").isin(wanted))
        .withColumn(
            "retry_slots",
            F.when(F.col("reason") == PARTIALLY_FAILED, F.col("failed_slots")).otherwise(every_slot),
        )
        .drop("status", "failed_slots")
    )


def selective_resume(problems: DataFrame, status: DataFrame, retry_failed: bool) -> DataFrame:
    """Selective rule: on retry only failed ids, otherwise every problem, finished ones included."""
    if not retry_failed:
        return problems
    failed = status.filter(F.col("status") != OK).select("unique_id")
    return problems.join(failed, "unique_id", "left_semi")


def merge_arrays(existing: Column, new: Column, k: int) -> Column:
    """Merge fresh samples into stored ones.

    With at least ``k`` usable stored responses, failed slots are refilled in order and the
    rest stays put. Otherwise the usable ones are kept and all fresh ones appended, which may
    exceed ``k``.
    """
    usable = F.filter(existing, lambda r: ~is_failed_response(r["full_response"]))
    failed = _failed_slots(existing)

    def refill(response: Column, i: Column) -> Column:
        rank = F.array_position(failed, i).cast("int")
        return F.when(
            (rank > 0) & (rank <= F.size(new)), F.get(new, rank - 1)
        ).otherwise(response)

    return F.when(F.size(usable) >= k, F.transform(existing, refill)).otherwise(F.concat(usable, new))


#: Bits of the table that says which ids may be among some others: 8 MB at the most, whatever their number.
_ID_BITS = 1 << 26


def _id_place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_ID_BITS))


def with_membership(rows: DataFrame, ids: DataFrame, name: str = "_listed", key: str = "unique_id") -> DataFrame:
    """Adds ``name``: false for rows whose ``key`` is certainly not in ``ids``, without shuffling ``rows``.

    The ids set bits of a table of fixed size, which is broadcast. A row that only shares a bit with an id
    is true as well, so whoever needs the exact answer joins the few true rows. A null key is false.
    """
    number, position = F.bitmap_bucket_number(_id_place(key)), F.bitmap_bit_position(_id_place(key))
    bits = ids.where(F.col(key).isNotNull()).groupBy(number.alias("_number")).agg(F.bitmap_construct_agg(position).alias("_bits"))
    octet = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(octet, (position % 8).cast("int")) == 1
    found = rows.withColumn("_number", number).join(F.broadcast(bits), "_number", "left")
    return found.withColumn(name, F.coalesce(F.col(key).isNotNull() & held, F.lit(False))).drop("_number", "_bits")


def retry_merge(existing: DataFrame, fresh: DataFrame, k: int) -> DataFrame:
    """Fresh results with their responses merged into the stored ones of the same question.

    Of the stored rows only those that may be among the fresh ones reach the join.
    """
    listed = with_membership(existing.select("unique_id", F.col("responses").alias("_stored")), fresh.select("unique_id"))
    stored = listed.where("_listed").drop("_listed")
    joined = fresh.join(stored, "unique_id", "left")
    merged = F.when(F.col("_stored").isNull(), F.col("responses")).otherwise(
        merge_arrays(F.col("_stored"), F.col("responses"), k)
    )
    return joined.withColumn("responses", merged).drop("_stored")


def untouched(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows whose id is not in ``fresh``; of the others only ids are joined.

    Few ids share a bit with one of ``fresh`` without being one. These are found by their ids alone, and only
    rows that share a bit with them are joined whole.
    """
    ids = fresh.select("unique_id")
    listed = with_membership(existing, ids)
    kept = listed.where("not _listed").drop("_listed")
    chance = with_membership(existing.select("unique_id"), ids).where("_listed").select("unique_id").join(ids, "unique_id", "left_anti").distinct()
    back = with_membership(listed.where("_listed").drop("_listed"), chance).where("_listed").drop("_listed")
    return kept.unionByName(back.join(chance, "unique_id", "left_semi"))


def upsert(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows whose id is not in the batch, plus the batch."""
    return untouched(existing, fresh).unionByName(fresh)


def dedup_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Later row with the same key wins.

    A rank filter, which Spark also applies before the shuffle: a key with many copies sends
    one row per task, not all its copies to one place.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def topk_responses(graded: DataFrame, k: int) -> DataFrame:
    """First ``k`` responses per question, correct ones first, original order otherwise."""
    best = Window.partitionBy("unique_id").orderBy(
        F.coalesce("is_correct", F.lit(False)).desc(), F.col("response_idx")
    )
    return graded.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def topk_nested(results: DataFrame, k: int) -> DataFrame:
    """:func:`topk_responses` of responses kept in one array per question: ranked in the row, no shuffle.

    Only the correctness of the responses is read.
    """
    ranked = F.array_sort(F.transform(
        F.col("responses.is_correct"),
        lambda c, i: F.struct((~F.coalesce(c, F.lit(False))).alias("wrong"), i.alias("response_idx"), c.alias("is_correct"))))
    best = results.select("unique_id", F.posexplode(F.slice(ranked, 1, k)).alias("_at", "_best"))
    return best.select("unique_id", "_best.response_idx", "_best.is_correct", (F.col("_at") + 1).alias("rank"))


def weak_failures(results: DataFrame, failure_threshold: float = 0.5, k: int = 1) -> DataFrame:
    """Questions the weak model fails on, with ``failure_rate`` strictly above the threshold.

    At most ``k`` responses count, correct ones first, so ``min`` of the counts replaces a sort.
    With ``k = 1`` one correct sample among many is therefore a pass.
    """
    total, correct = F.least(graded_count(), F.lit(k)), F.least(correct_count(), F.lit(k))
    usable = F.col("unique_id").isNotNull() & (F.col("unique_id") != "") & (graded_count() > 0)
    return (
        results.filter(usable)
        .withColumn("failure_rate", 1.0 - correct / total)
        .filter(F.col("failure_rate") > failure_threshold)
        .drop("responses")
    )
