"""Ordered operators over conversations and response chunks.

A single conversation or request may hold a large part of all rows. Running totals are therefore
taken in two levels: within blocks of the order column, and over one partial sum per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def running_totals(
    df: DataFrame, key: str, order: str, values: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add inclusive running sums per key in the order of a numeric column.

    Rows shuffle once, by (key, block); no task holds a whole key, only at most ``block``
    distinct order values of it. Rows without a key are one group; those without an order value
    come first in theirs.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    for name, value in values.items():
        blocked = blocked.withColumn(f"_v_{name}", value)
    partial = blocked.groupBy(key, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = partial.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values]
    )
    within = (
        Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = blocked.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
    for name in values:
        joined = joined.withColumn(name, F.col(f"_o_{name}") + F.sum(f"_v_{name}").over(within))
    return joined.drop("_block", "_key", "_at", *[f"_{p}_{n}" for n in values for p in "vo"])


def turn_pairs(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, pair_id, user, assistant)`` from ``(conv_id, turn, role, text)``.

    A user message opens a pair with an empty reply; an assistant message sets the reply of the
    last pair, a later one overwriting it. An assistant message before any user message and
    other roles are ignored.
    """
    opens = F.when(F.col("role") == "user", F.lit(1)).otherwise(F.lit(0))
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    numbered = running_totals(spoken, "conv_id", "turn", {"pair_id": opens}, block)
    is_reply = F.col("role") == "assistant"
    return (
        numbered.filter(F.col("pair_id") > 0)
        .groupBy("conv_id", "pair_id")
        .agg(
            F.max(F.when(F.col("role") == "user", F.col("text"))).alias("user"),
            F.coalesce(
                F.max_by(F.when(is_reply, F.col("text")), F.when(is_reply, F.col("turn"))), F.lit("")
            ).alias("assistant"),
        )
    )


def recent_pairs(pairs: DataFrame, last: int) -> DataFrame:
    """Last pairs of each conversation; ``age`` 1 is the newest.

    Spark limits by rank before the shuffle too, so a huge conversation sends few rows.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.col("pair_id").desc())
    return pairs.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= last)


def recent_history(messages: DataFrame, last: int = 10, block: int = BLOCK) -> DataFrame:
    """Messages for the next call: the last ``last`` pairs, then the newest user message.

    One row per message: ``conv_id, position, role, content``.
    """
    recent = recent_pairs(turn_pairs(messages, block), last + 1)
    current = F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("content")))
    both = F.concat(
        current, F.array(F.struct(F.lit("assistant").alias("role"), F.col("assistant").alias("content")))
    )
    items = F.when(F.col("age") == 1, current).otherwise(both)
    rows = recent.select("conv_id", "age", F.posexplode(items).alias("part", "m"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("age"), "part")
    return rows.select(
        "conv_id", F.row_number().over(order).alias("position"), "m.role", "m.content"
    )


def _updated() -> Column:
    return F.col("content").isNotNull() | F.col("reasoning").isNotNull()


def _length(name: str) -> Column:
    return F.coalesce(F.length(name), F.lit(0))


def assemble_offsets(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Running length of content and reasoning at each chunk that carried something.

    The cumulative text at a chunk is ``left(final text, length)``, so storing lengths keeps the
    result linear in the input; repeated text would grow with its square.
    """
    lengths = {"content_length": _length("content"), "reasoning_length": _length("reasoning")}
    totals = running_totals(chunks.filter(_updated()), "request_id", "seq", lengths, block)
    return totals.select(
        "request_id", "seq", "content_length", "reasoning_length",
        (F.col("reasoning_length") > 0).alias("has_reasoning"),
    )


def _joined_in_order(name: str, order: str) -> Column:
    """Concatenation of a group's texts in order; nulls add nothing."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(name))))
    return F.array_join(F.transform(rows, lambda r: r[name]), "")


def _block_texts(chunks: DataFrame, block: int) -> DataFrame:
    """Text of each block of a request; no task holds more than one block at a time."""
    return (
        chunks.withColumn("_block", F.floor(F.col("seq") / block))
        .groupBy("request_id", "_block")
        .agg(
            _joined_in_order("content", "seq").alias("_content"),
            _joined_in_order("reasoning", "seq").alias("_reasoning"),
        )
    )


def _final_of_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("request_id").agg(
        _joined_in_order("_content", "_block").alias("content"),
        _joined_in_order("_reasoning", "_block").alias("reasoning"),
    )


def assemble_final(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Final text per request, concatenated per block first and then over the blocks."""
    whole = _final_of_blocks(_block_texts(chunks, block))
    return whole.withColumn("has_reasoning", F.col("reasoning") != "")


def assemble_running(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cumulative rows as a reader of the stream sees them, and one final row per request.

    Rows meet their text block by block, so even one dominant request is spread over tasks.
    Each row repeats the text so far, so the output grows with the square of a request's length; use
    :func:`assemble_offsets` where that is too much. A final row holds its request's whole text.
    """
    blocks = _block_texts(chunks, block)
    before = Window.partitionBy("request_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.select(
        F.col("request_id").alias("_key"), F.col("_block").alias("_at"), "_content", "_reasoning",
        *[F.array_join(F.collect_list(f"_{n}").over(before), "").alias(f"_{n}_before") for n in ("content", "reasoning")],
    )
    within = (
        Window.partitionBy("request_id", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = chunks.filter(_updated()).withColumn("_block", F.floor(F.col("seq") / block))

    def so_far(name: str) -> Column:
        seen = F.sum(_length(name)).over(within).cast("int")
        return F.concat(f"_{name}_before", F.left(f"_{name}", seen)).alias(name)

    same = F.col("request_id").eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at"))
    steps = rows.join(started, same).select(
        "request_id", "seq", F.lit(False).alias("is_final"), so_far("content"), so_far("reasoning")
    )
    last = _final_of_blocks(blocks).select(
        "request_id", F.lit(None).cast("long").alias("seq"), F.lit(True).alias("is_final"),
        "content", "reasoning",
    )
    return steps.unionByName(last).withColumn("has_reasoning", F.col("reasoning") != "").withColumn(
        "reasoning", F.nullif("reasoning", F.lit(""))
    )


def non_empty_messages(messages: DataFrame) -> DataFrame:
    """Messages that lead to a request; empty ones do not."""
    return messages.filter(F.length("text") > 0)
