"""Words, hashes and shingles of whole Arrow batches of texts, without a Python loop over words.

All separators used by the operators are ASCII, so splitting UTF-8 bytes equals splitting code
points. Hashes are 64 bits: a multilinear hash of the bytes of a word, mixed with its length.
Batches are cut into slices of a few MB (one text at least), which bounds the memory of a task
whatever the batch size; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_A
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_B
    return x ^ (x >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers; the first ones are the same for every n."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _GOLDEN)


def _separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Complements of ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
SPACE = _separators([(0x20, 0x20), (0x09, 0x0D)])
NOT_ALNUM = _separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_CASED = stream64(256, 1)
_FOLDED = _CASED.copy()
_FOLDED[0x41:0x5B] = _CASED[0x61:0x7B]
_SHINGLE = stream64(64, 3) | np.uint64(1)
_PLACES = [stream64(4096, 2) | np.uint64(1)]


def _places(n: int) -> np.ndarray:
    if len(_PLACES[0]) < n:
        _PLACES[0] = stream64(2 * n, 2) | np.uint64(1)
    return _PLACES[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold about ``limit`` bytes together, one row at least."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(size):
        return
    part = (np.cumsum(size) - size) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]])
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(low, high - low)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, and the n + 1 offsets of the texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _CASED) -> np.ndarray:
    """One hash for the bytes of each non-empty span; the spans are disjoint and ascending."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = table[data[place + np.repeat(starts, size)]]
    values *= _places(int(size.max()))[place]
    return mix64(np.add.reduceat(values, first) + size.astype(np.uint64) * _GOLDEN)


@dataclass
class Words:
    """Words of some texts in order: text number, hash, byte span; and per text the first and count."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    count: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes outside ``separator``."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~separator[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words(texts: pa.Array, separator: np.ndarray = SPACE, fold: bool = True) -> Words:
    """Words of every text; ``fold`` treats A-Z as a-z."""
    data, offsets = raw_bytes(texts)
    start, end, doc = spans(data, offsets, separator)
    count = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, dtype=np.int64)
    hashed = span_hashes(data, start, end, _FOLDED if fold else _CASED)
    return Words(doc, hashed, start, end, np.cumsum(count) - count, count, data, offsets)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of each run of k words inside one text."""
    at = np.arange(max(0, len(w.hash) - k + 1))
    at = at[w.doc[at] == w.doc[at + k - 1]] if len(at) else at
    total = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        total += w.hash[at + j] * _SHINGLE[j]
    return at, mix64(total + np.uint64(k))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each k-word shingle; a text of fewer words is one shingle."""
    at, hashed = grams(w, k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    total = np.zeros(len(short), dtype=np.uint64)
    for j in range(k - 1):
        there = w.count[short] > j
        total[there] += w.hash[w.first[short[there]] + j] * _SHINGLE[j]
    whole = mix64(total + w.count[short].astype(np.uint64))
    return np.concatenate([w.doc[at], short]), np.concatenate([hashed, whole])


def shingle_sets(texts: pa.Array, k: int, separator: np.ndarray = SPACE, fold: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = words(texts, separator, fold)
    doc, hashed = shingles(w, k)
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order], np.arange(len(texts) + 1))
    hashed = hashed[order]
    return [np.unique(hashed[low:high]) for low, high in zip(bounds[:-1], bounds[1:])]
