"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by size: class c holds items of (2^(c-1), 2^c] shingles. For each class a
text is covered by windows of 3 * 2^c shingles every 2^c, so an item that stands in the text stands
whole in a window at most six times its size, and short items are found in texts of any length (those of
fewer words than a shingle by their own number of words, one class for each): the
Jaccard similarity of item and window is bounded below by the class, not by the text. Each item has a
one-permutation MinHash sketch per permutation: the least hash in each of ``BINS`` bins. An item is a
candidate of a window if the window has the same least hash in a bin. The least hash of a bin is only
worked out where a text has a hash of some sketch: elsewhere no item can agree with it.

Each candidate is verified by exact containment: the share of the item's shingle set that is in the
text's shingle set. Items are collected in blocks of bounded size, and each block scans all texts, so
a benchmark of any size works; one block holds the usual ones.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import NOT_ALNUM, grams, mix64, shingle_sets, shingles, slices, stream64, words

BINS, PERMUTATIONS = 16, 4
#: Bytes of item text in one block.
BLOCK_BYTES = 32 << 20
_SEEDS = stream64(PERMUTATIONS, 11)


def _bin(hashed: np.ndarray) -> np.ndarray:
    return hashed >> np.uint64(60)


class Sketches:
    """Items of one block: their sets, and for each class and permutation the items by sketch value."""

    def __init__(self, items: list[tuple], k: int):
        self.ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], type=pa.string())
        sets = shingle_sets(texts, k, NOT_ALNUM)
        self.sets = sets
        #: Items of fewer than k words by their number of words: sorted hashes, and the items of each.
        self.short: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        count = words(texts, NOT_ALNUM).count
        for size in range(1, k):
            values = defaultdict(list)
            for n in np.flatnonzero(count == size):
                values[int(sets[n][0])].append(int(n))
            if values:
                self.short[size] = np.array(sorted(values), dtype=np.uint64), dict(values)
        self.classes: dict[int, list[tuple[np.ndarray, dict[int, list[int]]]]] = {}
        by_class = defaultdict(list)
        for n, s in enumerate(sets):
            if count[n] >= k:
                by_class[max(0, int(len(s) - 1).bit_length())].append(n)
        for c, numbers in by_class.items():
            self.classes[c] = []
            for seed in _SEEDS:
                values = defaultdict(list)
                for n in numbers:
                    hashed = np.sort(mix64(sets[n] ^ seed))
                    for v in hashed[np.unique(_bin(hashed), return_index=True)[1]]:
                        values[int(v)].append(n)
                self.classes[c].append((np.array(sorted(values), dtype=np.uint64), dict(values)))
        every = [v for tables in self.classes.values() for v, _ in tables]
        #: Bits of the low 20 bits of every sketch value, by permutation: most hashes of a text stop here.
        self.filters = []
        for p in range(PERMUTATIONS):
            bits = np.zeros(1 << 20, dtype=bool)
            for tables in self.classes.values():
                bits[(tables[p][0] & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.filters.append(bits)
        self.empty = not every

    def candidates(self, tokens: np.ndarray) -> set[int]:
        """Items that agree with a window of the text in the least hash of a bin."""
        found: set[int] = set()
        n = len(tokens)
        for p, seed in enumerate(_SEEDS):
            hashed = mix64(tokens ^ seed)
            maybe = np.flatnonzero(self.filters[p][(hashed & np.uint64(0xFFFFF)).astype(np.int64)])
            if not len(maybe):
                continue
            for c, tables in self.classes.items():
                values, items = tables[p]
                at = np.minimum(np.searchsorted(values, hashed[maybe]), len(values) - 1)
                for i in maybe[values[at] == hashed[maybe]]:
                    step, value = 1 << c, hashed[i]
                    owners = [x for x in items[int(value)] if x not in found]
                    if not owners:
                        continue
                    last = max(0, -(-(n - 3 * step) // step))
                    for w in range(max(0, int(i) // step - 2), min(int(i) // step, last) + 1):
                        window = hashed[w * step:w * step + 3 * step]
                        if not (window[_bin(window) == _bin(value)] < value).any():
                            found.update(owners)
                            break
        return found

    def contained(self, tokens: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """``item number, shared shingles`` of the items whose containment reaches ``percent``."""
        if not (found := self.candidates(tokens)):
            return []
        distinct = np.unique(tokens)
        result = []
        for n in sorted(found):
            own = self.sets[n]
            at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
            shared = int((distinct[at] == own).sum())
            if 100 * shared >= percent * len(own):
                result.append((n, shared))
        return result


def _found(texts: pa.Array, sketches: Sketches, k: int, percent: int) -> list[tuple[int, int, int]]:
    """``text number, item number, shared shingles`` of the items in each text."""
    w = words(texts, NOT_ALNUM)
    found = []
    for size, (values, items) in sketches.short.items():
        # One gram is the whole item, so its own hash is its sketch and there is nothing to verify.
        at, hashed = grams(w, size)
        place = np.minimum(np.searchsorted(values, hashed), len(values) - 1)
        same = values[place] == hashed
        pairs = np.unique(np.stack([w.doc[at[same]], place[same]]), axis=1)
        found += [(int(i), n, 1) for i, v in pairs.T for n in items[int(values[v])]]
    if sketches.empty:
        return found
    doc, hashed = shingles(w, k)
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    hashed = hashed[order]
    near = np.zeros(len(hashed) + 1, dtype=np.int64)
    for p, seed in enumerate(_SEEDS):
        near[1:] += sketches.filters[p][(mix64(hashed ^ seed) & np.uint64(0xFFFFF)).astype(np.int64)]
    near = np.cumsum(near)
    return found + [
        (int(i), n, shared) for i in np.flatnonzero(near[bounds[1:]] > near[bounds[:-1]])
        for n, shared in sketches.contained(hashed[bounds[i]:bounds[i + 1]], percent)]


def _searcher(sketches: Sketches, k: int, percent: int, schema: pa.Schema):
    def search(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                if rows := _found(part.column("text"), sketches, k, percent):
                    at, number, shared = (np.array(x) for x in zip(*rows))
                    size = np.array([len(sketches.sets[n]) for n in number])
                    yield pa.RecordBatch.from_arrays([
                        part.column("id").take(pa.array(at)),
                        pa.array([sketches.ids[n] for n in number], type=schema.field("item").type),
                        pa.array(shared), pa.array(size), pa.array(shared / size)], schema=schema)

    return search


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Rows of ``items(item, text)`` in lists whose texts hold ``block_bytes`` at most, one row at least."""
    number = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total = items.agg(F.sum(number)).first()[0] or 0
    count = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for block in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block)
        yield [(r["item"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col, item_col, shared, n_item, containment``: the items found in each text.

    Words are lower-cased runs of letters, digits and non-ASCII characters, so punctuation and case do
    not hide an item. An item is found if at least ``percent`` of its distinct k-word shingles are in
    one window of the text, and then counted over the whole text: shingles that are only scattered over a
    long text are no passage of it. An item of fewer than k words is found wherever its words stand one
    after the other.
    Null and empty texts hold no item, null and empty items are found nowhere. Repeated rows are
    searched each; equal result rows are given once. Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((rows, "id"), (items, "item"))]
    schema = pa.schema([("id", _arrow(kinds[0])), ("item", _arrow(kinds[1])), ("shared", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64())])
    found = None
    for block in blocks(items, block_bytes):
        part = rows.mapInArrow(
            _searcher(Sketches(block, k), k, percent, schema),
            f"id {kinds[0]}, item {kinds[1]}, shared long, n_item long, containment double")
        found = part if found is None else found.union(part)
    return found.distinct().withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in whose text an item is found, as :func:`contaminated` finds it.

    Rows are dropped where they are read, so nothing is shuffled and ids do not matter.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    left = docs
    for block in blocks(items, block_bytes):
        left = left.mapInArrow(_cleaner(Sketches(block, k), k, percent, text_col), docs.schema)
    return left


def _cleaner(sketches: Sketches, k: int, percent: int, text_col: str):
    def clean(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                dirty = {i for i, _, _ in _found(part.column(text_col), sketches, k, percent)}
                yield part.filter(pa.array([i not in dirty for i in range(part.num_rows)], type=pa.bool_()))

    return clean
