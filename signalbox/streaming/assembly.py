"""Assembling streamed responses from their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "request_id long, last_seq long, content string, reasoning string, has_reasoning boolean"
STATE = "seqs array<long>, contents array<string>, reasonings array<string>"


def assemble_stream(chunks: DataFrame, idle_timeout_ms: int | None = None) -> DataFrame:
    """Text so far per request, emitted in update mode.

    The state of a request is its chunks by ``seq``, so the text does not depend on the order in which
    they arrive, and a chunk that comes again counts once, as it came last. An update writes the text so far.
    Without a timeout this is a streaming aggregation, which never leaves the JVM and keeps a chunk that comes
    again beside the first. The state of a request that went quiet is dropped after the timeout, if one is
    given; such state is kept by Python, one call for each request of a micro-batch. A query with a timeout
    never ends by itself, so an available-now trigger needs None.
    """
    return _with_timeout(chunks, idle_timeout_ms) if idle_timeout_ms else _aggregated(chunks)


def _aggregated(chunks: DataFrame) -> DataFrame:
    texts = (F.coalesce(name, F.lit("")).alias(name) for name in ("content", "reasoning"))
    chunk = F.struct("seq", "arrived", *texts)
    arrived = chunks.withColumn("arrived", F.current_timestamp())  # the time of the micro-batch
    sorted_chunks = arrived.groupBy("request_id").agg(F.sort_array(F.collect_list(chunk)).alias("_all"))
    newest = F.filter("_all", lambda c, i: F.coalesce(F.get("_all", i + 1)["seq"] != c["seq"], F.lit(True)))
    content, reasoning = (F.array_join(f"_chunks.{name}", "").alias(name) for name in ("content", "reasoning"))
    found = sorted_chunks.select("request_id", newest.alias("_chunks"))
    found = found.select("request_id", F.element_at("_chunks", -1)["seq"].cast("long").alias("last_seq"), content, reasoning)
    return found.withColumn("has_reasoning", F.col("reasoning") != "")


def _with_timeout(chunks: DataFrame, idle_timeout_ms: int) -> DataFrame:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = {seq: (c, r) for seq, c, r in zip(*state.get)} if state.exists else {}
        for batch in batches:
            texts = (batch[name].where(batch[name].notna(), "") for name in ("content", "reasoning"))
            seen.update((int(seq), pair) for seq, *pair in zip(batch["seq"], *texts))
        seqs = sorted(seen)
        contents, reasonings = ([seen[seq][i] for seq in seqs] for i in (0, 1))
        state.update((seqs, contents, reasonings))
        state.setTimeoutDuration(idle_timeout_ms)
        content, reasoning = "".join(contents), "".join(reasonings)
        yield pd.DataFrame(
            [(key[0], seqs[-1], content, reasoning, reasoning != "")],
            columns=["request_id", "last_seq", "content", "reasoning", "has_reasoning"],
        )

    return chunks.groupBy("request_id").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
