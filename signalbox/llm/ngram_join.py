"""Jaccard join of word shingles with adaptive multi-match prefixes.

A text's set is its distinct k-word shingles (fewer words: the whole sequence; no word: empty and
linked with nothing). Two texts link when 100 * shared >= percent * union. The join returns each
text's component of links, not the links between copies.

Method. Order the shingles of all sets alike. A text of n shingles that links with another shares at
least a = ceil(n * percent / 100) of them, so the two share at least m shingles among the first
n - a + m of each (the m-prefix); prefixes of different m share the smaller m. The order is cheap
shingles first, by hash, then costly ones. A text whose first n - a + 1 shingles hold c costly ones
(by estimated list length) lengthens its prefix by c, and by a share of n, since long texts meet by
chance most often and cost most to verify; lengthened by e, it asks for e + 1 matches. A pair is
verified exactly once it shares as many prefix shingles as the less demanding of the two asks for,
counting only those that stand early enough in both for the two sizes at hand.

Scale. Equal sets meet by digest first. Texts that share low hashes are then linked with one leader
and verified, so that a group of near copies is one class before lists are paired: lists hold classes,
and a group never expands into all its pairs. Costs come from counts within each block of texts,
over all texts; what they decide is the order, never which pairs are found. Texts themselves are
never shuffled: a bitmap of the wanted ids, of fixed size, picks the texts to read again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.graph import components
from signalbox.llm.textkit import mix64, shingle_sets, slices, stream64
from signalbox.llm.wanted import held, id_bitmap, with_place
from signalbox.sources.store import materialize

#: Low hashes of a text by which it looks for a leader.
LOW = 8
#: Shingles counted together in one block, and kept at once in a task.
BLOCK = 1 << 20
#: A shingle in this many texts is costly; so many costly shingles are known to every task.
COSTLY, COSTLY_KNOWN = 8, 1 << 18
#: A prefix is lengthened by one shingle for so many of the text.
LENGTHEN = 32
#: Prefix shingles in one bucket, about.
BUCKET = 1 << 20


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, so the order of shingles does not matter."""
    second = mix64(tokens ^ stream64(1, 7)[0])
    return int(mix64(tokens).sum().view(np.int64)), int(second.sum().view(np.int64))


def _blocks(batches, k: int):
    """Ids and sets of the texts, about BLOCK shingles at a time."""
    ids, sets, held = [], [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            found = shingle_sets(part.column("text"), k)
            ids += part.column("id").to_pylist()
            sets += found
            held += sum(map(len, found))
            if held >= BLOCK:
                yield ids, sets
                ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _profiler(k: int, schema: pa.Schema):
    def profile(batches):
        for ids, sets in _blocks(batches, k):
            digests = [_digest(s) for s in sets]
            rows = {
                "kind": ["text"] * len(ids), "id": ids, "n": [len(s) for s in sets],
                "d1": [d[0] for d in digests], "d2": [d[1] for d in digests],
                "low": [s[:LOW].view(np.int64) for s in sets],
                "token": pa.nulls(len(ids), pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
            different = {d: i for i, d in enumerate(digests)}.values()
            token, seen = np.unique(np.concatenate([sets[i] for i in different]), return_counts=True)
            often = seen > 1
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_pydict({
                "kind": ["often"] * len(none), "id": pa.nulls(len(none), schema.field("id").type), "n": seen[often],
                "d1": none, "d2": none, "low": pa.nulls(len(none), schema.field("low").type),
                "token": token[often].view(np.int64),
            }, schema=schema)

    return profile


def _poster(k: int, percent: int, buckets: int, costly: np.ndarray, schema: pa.Schema):
    def prefix(s: np.ndarray) -> tuple[np.ndarray, int]:
        size = len(s) - (len(s) * percent + 99) // 100 + 1
        at = np.searchsorted(costly, s)
        is_costly = np.zeros(len(s), dtype=bool)
        if len(costly):
            is_costly = costly[np.minimum(at, len(costly) - 1)] == s
        ordered = np.concatenate([s[~is_costly], s[is_costly]])
        more = min(max(0, size - int((~is_costly).sum())) + len(s) // LENGTHEN, len(s) - size)
        return ordered[:size + more], more + 1

    def post(batches):
        for ids, sets in _blocks(batches, k):
            different = [i for i in {_digest(s): i for i, s in enumerate(sets)}.values() if len(sets[i])]
            if not different:
                continue
            chosen = [prefix(sets[i]) for i in different]
            token = np.concatenate([c[0] for c in chosen])
            owner = np.repeat(np.arange(len(different)), [len(c[0]) for c in chosen])
            bucket = (token >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            own_ids = pa.array([ids[i] for i in different], type=schema.field("ids").type.value_type)
            needs = np.array([c[1] for c in chosen], dtype=np.int32)
            rank = np.concatenate([np.arange(len(c[0]), dtype=np.int32) for c in chosen])
            full = np.flatnonzero(np.diff(bounds))
            token, owner = token[order], owner[order]
            offsets = pa.array(np.concatenate([bounds[full], bounds[-1:]]), type=pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(full, type=pa.int32()),
                pa.ListArray.from_arrays(offsets, pa.array(token.view(np.int64))),
                pa.ListArray.from_arrays(offsets, own_ids.take(pa.array(owner))),
                pa.ListArray.from_arrays(offsets, pa.array(needs[owner])),
                pa.ListArray.from_arrays(offsets, pa.array(rank[order])),
            ], schema=schema)

    return post


def _repeated(table: pa.Table) -> pa.Table:
    """Rows of the shingles that stand in more than one list entry of a bucket."""
    flat = [table.column(name).combine_chunks().flatten() for name in ("tokens", "ids", "needs", "ranks")]
    token = np.asarray(flat[0])
    order = np.argsort(token, kind="stable")
    equal = token[order][1:] == token[order][:-1]
    keep = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
    keep = pa.array(keep)
    return pa.table({name: column.take(keep) for name, column in zip(("token", "id", "need", "rank"), flat)})


def _set_reader(k: int, bits: np.ndarray, schema: pa.Schema):
    def read(batches):
        for batch in batches:
            for part in slices(held(bits, batch), "text"):
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id"), "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets]}, schema=schema)

    return read


def _verified(texts: DataFrame, pairs: DataFrame, k: int, percent: int, id_type, id_arrow) -> DataFrame:
    """The pairs ``a, b`` whose sets meet the threshold, by counting shared shingles exactly."""
    pairs = materialize(pairs, "pairs")
    bits = id_bitmap(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
    schema = pa.schema([("id", id_arrow), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    sets = materialize(
        with_place(texts.where("id is not null"))
        .mapInArrow(_set_reader(k, bits, schema), f"id {id_type}, n long, tokens array<long>"), "sets")
    left, right = (sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ta", "tb"))
    met = 100 * shared >= percent * (F.col("na") + F.col("nb") - shared)
    return materialize(pairs.join(left, "a").join(right, "b").where(met).select("a", "b").distinct(), "linked")


def _similar_size(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own id included. A row without
    an id links with nothing and has a null component. Rows that share an id count as one node that
    links as any of them does. A null text is empty. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    id_arrow = pa.from_numpy_dtype({"bigint": "int64", "int": "int32"}[id_type]) if id_type in ("bigint", "int") else pa.string()

    schema = pa.schema([("kind", pa.string()), ("id", id_arrow), ("n", pa.int64()), ("d1", pa.int64()),
                        ("d2", pa.int64()), ("low", pa.list_(pa.int64())), ("token", pa.int64())])
    profile = materialize(texts.mapInArrow(
        _profiler(k, schema), f"kind string, id {id_type}, n long, d1 long, d2 long, low array<long>, token long"), "profile")
    rows = profile.where("kind = 'text'")
    named = rows.where("id is not null and n > 0")

    # Equal sets: one representative each.
    reps = named.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    members = materialize(named.join(reps, ["n", "d1", "d2"]).select("id", "rep", "n", "low"), "members")
    single = members.where("id = rep").select("id", "n", "low").dropDuplicates(["id", "n", "low"])

    # Near copies: verified links with the first and last text that share low hashes.
    lows = single.select("id", "n", F.explode("low").alias("token"))
    leaders = (
        lows.groupBy("token").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
        .select("token", F.explode(F.array("first", "last")).alias("leader"))
    )
    sizes = single.groupBy(F.col("id").alias("leader")).agg(F.max("n").alias("leader_n"), F.min("n").alias("leader_m"))
    near = (
        lows.join(leaders, "token").where("id <> leader")
        .groupBy(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).agg(F.count("*").alias("common"), F.min("n").alias("n"))
        .where("common > 1 or n <= 8").select("a", "b")
    )
    size_a = sizes.select(F.col("leader").alias("a"), F.col("leader_n").alias("xa"), F.col("leader_m").alias("ma"))
    size_b = sizes.select(F.col("leader").alias("b"), F.col("leader_n").alias("xb"), F.col("leader_m").alias("mb"))
    near = near.join(size_a, "a").join(size_b, "b").where(
        f"100 * xa >= {percent} * mb and 100 * xb >= {percent} * ma").select("a", "b")
    first_links = _verified(texts, near, k, percent, id_type, id_arrow)
    copies = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = components(first_links)

    # All other links: adaptive prefixes of every text, lists of classes.
    costly = np.array(sorted(
        r.token & 0xFFFFFFFFFFFFFFFF for r in
        profile.where("kind = 'often'").groupBy("token").agg(F.sum("n").alias("seen")).where(F.col("seen") >= COSTLY)
        .orderBy(F.desc("seen"), "token").limit(COSTLY_KNOWN).select("token").collect()), dtype=np.uint64)
    total = named.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (100 - percent) / 100 / BUCKET))
    schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.list_(pa.int64())), ("ids", pa.list_(id_arrow)), ("needs", pa.list_(pa.int32())), ("ranks", pa.list_(pa.int32()))])
    repeated = materialize(
        texts.where("id is not null")
        .mapInArrow(_poster(k, percent, buckets, costly, schema),
                    f"bucket int, tokens array<long>, ids array<{id_type}>, needs array<int>, ranks array<int>")
        .groupBy("bucket").applyInArrow(_repeated, f"token long, id {id_type}, need int, rank int"), "repeated")
    own = members.select("id", "rep", "n").distinct()
    in_class = single.select(F.col("id").alias("rep"), "n").distinct().join(classes.withColumnRenamed("id", "rep"), "rep", "left").select(
        "rep", "n", F.coalesce("component", "rep").alias("class"))
    classed = repeated.join(own, "id").join(in_class, ["rep", "n"])
    lists = materialize(
        classed.groupBy("token", "class", "n")
        .agg(F.min("need").alias("least"), F.max("need").alias("most"), F.min("rank").alias("rank")), "lists")
    several = lists.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token")
    lists = materialize(lists.join(several, "token", "left_semi"), "lists")
    other = lists.select("token", *(F.col(c).alias(f"other_{c}") for c in ("class", "n", "least", "most", "rank")))
    # Sets of n and m shingles that link share t of them, so of the first n - t + e of each they share e.
    shared = F.ceil(F.lit(percent) * (F.col("n") + F.col("other_n")) / (100 + percent))
    asked = F.least("most", "other_most")
    inside = (F.col("rank") < F.col("n") - shared + asked) & (F.col("other_rank") < F.col("other_n") - shared + asked)
    met = (
        lists.join(other, "token").where(F.col("class") < F.col("other_class"))
        .where(_similar_size("n", "other_n", percent) & inside)
        .groupBy("class", "n", "other_class", "other_n")
        .agg(F.count("*").alias("common"), F.min(F.least("least", "other_least")).alias("need"))
        .where("common >= need").drop("common", "need")
    )
    in_other = in_class.select(F.col("rep").alias("b"), F.col("n").alias("other_n"), F.col("class").alias("other_class"))
    pairs = (
        met.join(in_class.withColumnRenamed("rep", "a"), ["class", "n"]).join(in_other, ["other_class", "other_n"])
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    more_links = _verified(texts, pairs, k, percent, id_type, id_arrow)

    whole = components(first_links.union(more_links).union(copies)).withColumnRenamed("component", "component_id")
    return (
        rows.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the rows of the smallest id of each component; rows without an id stay.

    Rows of equal id and text are one document and keep one row; all columns are kept.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    removed = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(removed, id_col, "left_anti").select(docs.columns)
    return named.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))
