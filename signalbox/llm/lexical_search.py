"""Ranked lexical search of test items among all documents, by a dual-tree search.

Documents are reduced once to the item terms they hold (``profiles``): a narrow table that is written to
the shared folder and gives the statistics, ``df`` of each item term, the number and the length of all
documents. From it a term's part of a document's score is known: weight times impact, whole numbers.

The search reads that table. Items and the documents of a batch are arranged in two hierarchies whose
neighbours share their heaviest term. A node of documents holds for each term the largest impact below
it, a node of items the terms of any item below it, so the sum of weight times impact over the common
terms bounds the score of every pair below two nodes. From the roots down, a pair of nodes is dropped
when its bound is below the weakest kth score of its items, and whole batches with it; what is left is
scored in full. An item's kth score only rises, and equal scores are kept, so nothing of the result is
lost. Each task gives its best k of each item, and a window over these few rows ranks them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalbox.llm.textkit import NOT_ALNUM, slices, words
from signalbox.sources.store import materialize

#: Documents kept for each item.
BEST = 10
#: Distinct terms, over all items of a block; a block has one item at least.
BLOCK_TERMS = 1 << 17
#: Children of a node; pairs of a posting and an item that are at hand at a time.
FAN_OUT, AT_HAND = 8, 1 << 20

#: Constants of the score, fixed values.
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, K, B_PERCENT = 1000, 1_000_000_000, 1000, 8, 90


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` of each range, one after the other."""
    total = int(count.sum())
    return np.arange(total) + np.repeat(first - (np.cumsum(count) - count), count)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(WEIGHT_SCALE * np.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A posting's impact, from its occurrences and its document's length; 64-bit whole numbers."""
    norm = 100 - B_PERCENT + (B_PERCENT * length * documents) // total
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + K * norm)


@dataclass
class Block:
    """Some items: their ids, the sorted term hashes of all, and each item's places in these."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]


def item_blocks(items: DataFrame, block_terms: int):
    """Blocks of ``items(item, text)``; the driver holds one partition's items and one block at a time."""
    def prepared(batch: list[tuple]) -> Block:
        vocabulary = np.unique(np.concatenate([t for _, t in batch]))
        return Block([i for i, _ in batch], vocabulary, [np.searchsorted(vocabulary, t) for _, t in batch])

    held, size = [], 0
    for row in items.toLocalIterator():
        found = np.unique(words(pa.array([row["text"]], type=pa.string()), NOT_ALNUM).hash)
        if not len(found):
            continue
        if held and size + len(found) > block_terms:
            yield prepared(held)
            held, size = [], 0
        held.append((row["item"], found))
        size += len(found)
    if held:
        yield prepared(held)


def _profiler(vocabulary: np.ndarray, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), NOT_ALNUM)
                at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
                known = vocabulary[at] == w.hash
                pair, tf = np.unique(w.doc[known] * len(vocabulary) + at[known], return_counts=True)
                bounds = np.searchsorted(pair // len(vocabulary), np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(w.count, type=pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(pair % len(vocabulary), type=pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(tf, type=pa.int32()))], schema=schema)

    return run


def profiles(docs: DataFrame, block: Block) -> DataFrame:
    """``id, n, terms, tf`` of every row of ``docs(id, text)``: its length, and the block's terms in it."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    return docs.mapInArrow(_profiler(block.vocabulary, schema), "id long, n long, terms array<int>, tf array<int>")


class Hierarchy:
    """Items in an order in which neighbours share their heaviest term, and levels of nodes over them.

    ``levels[0]`` has the items themselves. A level lists for each term its nodes that hold the term.
    """

    def __init__(self, block: Block, weight: np.ndarray):
        heaviest = [t[np.argsort(-weight[t], kind="stable")[:2]].tolist() for t in block.terms]
        self.order = sorted(range(len(block.ids)), key=lambda i: (heaviest[i], i))
        self.weight, self.size = weight, len(self.order)
        term = np.concatenate([block.terms[i] for i in self.order])
        node = np.repeat(np.arange(self.size), [len(block.terms[i]) for i in self.order])
        self.levels, self.widths = [], []
        width = self.size
        while True:
            pair = np.unique(term * width + node)
            term, node = pair // width, pair % width
            self.levels.append((np.searchsorted(term, np.arange(len(weight) + 1)), node))
            self.widths.append(width)
            if width == 1:
                return
            node, width = node // FAN_OUT, -(-width // FAN_OUT)


class Best:
    """The best k documents of each item so far, and the kth score: 0 while there are fewer."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.null = np.zeros(0, dtype=bool)
        self.least = np.zeros(items, dtype=np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, -score, item))
        item, score, ids, null = item[order], score[order], ids[order], null[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.k
        self.item, self.score, self.id, self.null = item[kept], score[kept], ids[kept], null[kept]
        full = np.flatnonzero((np.arange(len(item)) - first) == self.k - 1)
        self.least[item[full]] = score[full]


def _bounds(tree: Hierarchy, level: int, node: np.ndarray, term: np.ndarray, value: np.ndarray, nodes: int) -> np.ndarray:
    """Sum of weight times value over the common terms, for each node of documents and of the item level."""
    first, held = tree.levels[level]
    width = tree.widths[level]
    total = np.zeros(nodes * width)
    count = first[term + 1] - first[term]
    spent = np.cumsum(count)
    low = 0
    while low < len(term):
        high = max(low + 1, int(np.searchsorted(spent, (spent[low - 1] if low else 0) + AT_HAND, side="right")))
        part = slice(low, high)
        at = np.repeat(node[part], count[part]) * width + held[ranges(first[term[part]], count[part])]
        total += np.bincount(at, weights=np.repeat(tree.weight[term[part]] * value[part], count[part]), minlength=nodes * width)
        low = high
    return total.reshape(nodes, width)


def search(tree: Hierarchy, best: Best, ids: np.ndarray, null: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> int:
    """Add the documents of one batch to ``best``; gives the number of pairs scored in full.

    ``doc``, ascending, ``term`` and ``value`` are the postings: number of the document, term and impact.
    """
    if not len(doc):
        return 0
    # Documents that share their heaviest term become neighbours; those without a term are left out.
    part = tree.weight[term] * value
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    count = np.diff(np.append(first, len(doc)))
    top = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, first), count))
    number = np.repeat(np.arange(len(first)), count)
    heaviest = np.zeros(len(first), dtype=np.int64)
    heaviest[number[top]] = term[top]
    order = np.argsort(heaviest, kind="stable")
    postings = ranges(first[order], count[order])
    node, term, value = np.repeat(np.arange(len(order)), count[order]), term[postings], value[postings]
    ids, null = ids[doc[first[order]]], null[doc[first[order]]]

    # Levels of documents, from the documents up: node, term, and the largest value below the node.
    levels, widths = [(node, term, value)], [len(order)]
    while widths[-1] > 1:
        node, term, value = levels[-1]
        pair = node // FAN_OUT * len(tree.weight) + term
        order = np.argsort(pair, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(pair[order]) > 0))
        levels.append((pair[order][starts] // len(tree.weight), pair[order][starts] % len(tree.weight),
                       np.maximum.reduceat(value[order], starts)))
        widths.append(-(-widths[-1] // FAN_OUT))

    def bounds(at: int, item_level: int, nodes: np.ndarray) -> np.ndarray:
        """Bounds of the given nodes of a level of documents, which are read alone."""
        node, term, value = levels[at]
        low, high = np.searchsorted(node, nodes), np.searchsorted(node, nodes, side="right")
        own = ranges(low, high - low)
        return _bounds(tree, item_level, np.repeat(np.arange(len(nodes)), high - low), term[own], value[own], len(nodes))

    def weakest(item_level: int) -> np.ndarray:
        """The weakest kth score below each node of items."""
        starts = np.arange(tree.widths[item_level]) * FAN_OUT ** item_level
        return np.minimum.reduceat(best.least, starts)

    def score(nodes: np.ndarray, open_items: np.ndarray) -> int:
        """Score the pairs of leaves that are open: ``open_items`` has a row of item leaves for each node."""
        done = 0
        for low in range(0, len(nodes), 16):
            leaf, wanted = nodes[low:low + 16], open_items[low:low + 16]
            inside = (leaf[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            inside = inside[inside < widths[0]]
            scores = bounds(0, 0, inside).astype(np.int64)
            row = np.searchsorted(leaf, inside // FAN_OUT)
            at, item = np.nonzero((scores > 0) & (scores >= best.least))
            item_leaf = item // FAN_OUT if len(tree.widths) > 1 else item * 0
            take = wanted[row[at], item_leaf]
            at, item = at[take], item[take]
            best.add(item, scores[at, item], ids[inside[at]], null[inside[at]])
            done += int(wanted.sum())
        return done

    leaf_level = min(1, len(widths) - 1), min(1, len(tree.widths) - 1)
    if leaf_level[0] == 0:
        levels.append(levels[0])
        widths.append(widths[0])
        leaf_level = 1, leaf_level[1]
    depth, item_level = len(widths) - 1, len(tree.widths) - 1
    nodes = np.arange(widths[depth])
    alive = np.ones((len(nodes), tree.widths[item_level]), dtype=bool)
    while True:
        bound = np.where(alive, bounds(depth, item_level, nodes), 0)
        alive = (bound > 0) & (bound >= weakest(item_level))
        if (depth, item_level) == leaf_level:
            break
        some = alive.any(axis=1)
        nodes, alive = nodes[some], alive[some]
        if depth > leaf_level[0]:
            depth -= 1
            children = (nodes[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            inside = children < widths[depth]
            nodes, alive = children[inside], np.repeat(alive, FAN_OUT, axis=0)[inside]
        if item_level > leaf_level[1]:
            item_level -= 1
            alive = np.repeat(alive, FAN_OUT, axis=1)[:, :tree.widths[item_level]]
    # The node of the largest bound of each leaf of items first: kth scores rise early.
    done, ahead = 0, np.unique(bound.argmax(axis=0)) if len(nodes) else np.zeros(0, dtype=np.int64)
    mark = np.zeros(len(nodes), dtype=bool)
    mark[ahead] = True
    for chosen in (np.flatnonzero(mark), np.flatnonzero(~mark)):
        for low in range(0, len(chosen), 64):
            group = chosen[low:low + 64]
            still = alive[group] & (bound[group] >= weakest(item_level))
            some = still.any(axis=1)
            done += score(nodes[group[some]], still[some])
    return done


def _searcher(block: Block, number: int, tree: Hierarchy, documents: int, total: int, k: int, schema: pa.Schema):
    def run(batches):
        best = Best(tree.size, k)
        for batch in batches:
            lists, lengths = batch.column("terms"), np.asarray(batch.column("n"))
            count = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), count)
            tf = np.asarray(batch.column("tf").flatten()).astype(np.int64)
            null = np.asarray(batch.column("id").is_null())
            ids = np.asarray(batch.column("id").fill_null(0))
            search(tree, best, ids, null, doc, np.asarray(lists.flatten()).astype(np.int64), impacts(tf, lengths[doc], documents, total))
        item = np.array(tree.order, dtype=np.int64)[best.item]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(item), number), type=pa.int64()), pa.array(item, type=pa.int64()),
            pa.array([block.ids[i] for i in item], type=schema.field("item").type),
            pa.array(best.id, mask=best.null), pa.array(best.score, type=pa.int64())], schema=schema)

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` documents of highest score above 0 for each item.

    Terms are runs of ASCII letters and digits and of other characters beyond ASCII, A-Z lower-cased. A
    term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``, and its part in a document is the weight times
    ``10^9 tf div (1000 tf + 8m)``, with ``m = 10 + 90 n N div L``; n is the document's length, N the
    number of documents with a term, L the length of all.

    Equal scores go by ascending id, rows without an id last. Null and empty texts and items have no
    terms, so no rank. Repeated documents are ranked each; items equal in id and text are one, and others
    that share an id are ranked apart. Other columns are ignored; ids of documents are integers. Scores
    stay exact below 2^53, that is for items of up to 300,000 distinct terms.

    Items are taken in blocks of bounded size; each block scans the texts once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    queries = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct()
    item_type = queries.schema["item"].dataType.simpleString()
    item_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(item_type, pa.string())
    schema = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("item", item_arrow), ("id", pa.int64()), ("score", pa.int64())])
    described = f"block long, place long, item {item_type}, id long, score long"
    found = docs.sparkSession.createDataFrame([], described)
    for number, block in enumerate(item_blocks(queries, block_terms)):
        profiled = materialize(profiles(rows, block), "profiles")
        documents, total = profiled.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        counted = profiled.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)
        for row in counted:
            df[row["term"]] = row["count"]
        tree = Hierarchy(block, weights(df, documents))
        found = found.union(profiled.mapInArrow(_searcher(block, number, tree, documents, total, k, schema), described))
    place = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
