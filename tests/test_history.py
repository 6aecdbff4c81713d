from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from signalbox.operators import history
from signalbox.operators.messages import build_messages, format_history, message_content, system_or_default


def conversations(seed, count=40):
    rng = random.Random(seed)
    return {
        c: [(t, rng.choice(["user", "assistant", "system", "tool"]), f"{c}-{t}") for t in range(rng.randint(1, 15))]
        for c in range(count)
    }


def plain_pairs(turns):
    pairs = []
    for _, role, text in turns:
        if role == "user":
            pairs.append([text, ""])
        elif role == "assistant" and pairs:
            pairs[-1][1] = text
    return pairs


def frame(spark, data):
    rows = [(c, *turn) for c, turns in data.items() for turn in turns]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_turn_pairs(spark, block):
    data = conversations(3)
    rows = history.turn_pairs(frame(spark, data), block).orderBy("conv_id", "pair_id").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.conv_id, []).append([r.user, r.assistant])
    assert got == {c: plain_pairs(t) for c, t in data.items() if plain_pairs(t)}


@pytest.mark.parametrize("last", [1, 2, 10])
def test_recent_history(spark, last):
    data = conversations(5)
    got: dict = {}
    for r in history.recent_history(frame(spark, data), last, block=4).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.content))
    for c, turns in data.items():
        pairs = plain_pairs(turns)
        if not pairs:
            assert c not in got
            continue
        want = [m for u, a in pairs[:-1][-last:] for m in (("user", u), ("assistant", a))]
        assert got[c] == [*want, ("user", pairs[-1][0])]


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7])
def test_format_history_clamps(spark, size):
    pairs = [(f"u{i}", f"a{i}") for i in range(size)]
    df = spark.createDataFrame([(pairs,)], "h array<struct<user:string,assistant:string>>")
    out = df.select(format_history(F.col("h"), F.lit("now"), 3).alias("m")).first().m
    want = [m for u, a in pairs[-3:] for m in (("user", u), ("assistant", a))] + [("user", "now")]
    assert [(m.role, m.content) for m in out] == want


def test_messages(spark):
    df = spark.createDataFrame([("p", "s"), ("q", ""), ("r", None)], "p string, s string")
    out = df.select(build_messages(F.col("p"), F.col("s")).alias("m")).collect()
    assert [[tuple(m) for m in r.m] for r in out] == [
        [("system", "s"), ("user", "p")], [("user", "q")], [("user", "r")],
    ]
    defaulted = df.select(system_or_default(F.col("s")).alias("s")).collect()
    assert defaulted[0].s == "s" and defaulted[1].s == defaulted[2].s != ""
    images = spark.createDataFrame([("t", ["u", "v"]), ("t", None)], "t string, i array<string>")
    both, none = images.select(message_content(F.col("t"), F.col("i")).alias("c")).collect()
    assert [i.type for i in both.c] == ["text", "image_url", "image_url"]
    assert both.c[2].image_url.url == "v" and len(none.c) == 1


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_assembly(spark, block):
    rng = random.Random(9)
    rows = [
        (r, s, rng.choice([None, "", f"c{s} "]), rng.choice([None, None, f"r{s} "]))
        for r in range(6) for s in sorted(rng.sample(range(60), rng.randint(1, 20)))
    ]
    chunks = spark.createDataFrame(rows, "request_id long, seq long, content string, reasoning string").repartition(3)
    want = []
    for request in sorted({r[0] for r in rows}):
        content = reasoning = ""
        for _, seq, c, g in [r for r in rows if r[0] == request]:
            content, reasoning = content + (c or ""), reasoning + (g or "")
            if c is not None or g is not None:
                want.append((request, seq, False, content, reasoning or None, reasoning != ""))
        want.append((request, None, True, content, reasoning or None, reasoning != ""))
    running = history.assemble_running(chunks, block)
    got = running.orderBy("request_id", "is_final", "seq").select(
        "request_id", "seq", "is_final", "content", "reasoning", "has_reasoning"
    )
    assert [tuple(r) for r in got.collect()] == want
    lengths = history.assemble_offsets(chunks, block).orderBy("request_id", "seq").collect()
    assert [(r.request_id, r.seq, r.content_length, r.reasoning_length) for r in lengths] == [
        (w[0], w[1], len(w[3]), len(w[4] or "")) for w in want if not w[2]
    ]


def test_empty_messages_make_no_request(spark):
    df = spark.createDataFrame([("",), ("x",), (None,)], "text string")
    assert [r.text for r in history.non_empty_messages(df).collect()] == ["x"]


def test_rows_without_a_key_are_kept(spark):
    rows = [("a", 1, "user", "x"), ("a", 2, "assistant", "y"), (None, 1, "user", "p"), (None, 2, "assistant", "q"), (None, 5000, "user", "r")]
    pairs = history.turn_pairs(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.pair_id, r.user, r.assistant) for r in pairs} == {("a", 1, "x", "y"), (None, 1, "p", "q"), (None, 2, "r", "")}
    chunks = spark.createDataFrame([("a", 1, "x", None), (None, 1, "p", None), (None, 5000, "q", None)], "request_id string, seq long, content string, reasoning string")
    running = {(r.request_id, r.seq, r.content) for r in history.assemble_running(chunks).collect()}
    assert running == {("a", 1, "x"), ("a", None, "x"), (None, 1, "p"), (None, 5000, "pq"), (None, None, "pq")}
    assert {(r.request_id, r.content_length) for r in history.assemble_offsets(chunks).collect()} == {("a", 1), (None, 1), (None, 2)}


def test_stream_assembly_stays_in_the_jvm_and_the_chunk_that_comes_last_counts(spark, tmp_path):
    from signalbox.streaming.assembly import assemble_stream
    from signalbox.streaming.sinks import latest_updates, run_updates

    schema, source, out = "request_id long, seq long, content string, reasoning string", str(tmp_path / "in"), str(tmp_path / "out")
    runs = [
        [(1, 2, "b ", None), (1, 1, "a ", "r1 "), (2, 5, None, None)],
        [(1, 1, "A ", "r1 "), (1, 3, "c ", "r3 "), (3, 9, "z", "")],
        [(1, 3, "c ", "r3 ")],
    ]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = assemble_stream(spark.readStream.schema(schema).parquet(source))
        assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
        run_updates(stream, out, str(tmp_path / "checkpoint"))
    batches = spark.read.parquet(out)
    assert sorted((r.batch, r.request_id) for r in batches.collect()) == [(0, 1), (0, 2), (1, 1), (1, 3), (2, 1)]
    assert {tuple(r) for r in latest_updates(batches, "request_id").collect()} == {
        (1, 3, "A b c ", "r1 r3 ", True), (2, 5, "", "", False), (3, 9, "z", "", False)}
