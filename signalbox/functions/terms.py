"""Word counts of whole texts as sparse vectors, worked out for Arrow batches without a loop over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A batch is worked on in pieces whose texts hold about so many bytes, one text at least.
PIECE_BYTES = 1 << 20

#: Spans of so few are hashed one after the other.
FEW = 32

#: Bytes of ``\w`` after lower-casing.
_WORD = np.zeros(256, dtype=bool)
_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", dtype=np.uint8)] = True

_SEED, _ALL = 42, 0xFFFFFFFF
_TAILS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], dtype=np.uint32)


def _scrambled(block: np.ndarray) -> np.ndarray:
    block = block * np.uint32(0xCC9E2D51)
    return ((block << np.uint32(15)) | (block >> np.uint32(17))) * np.uint32(0x1B873593)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """MurmurHash3 (32 bits, signed) of byte spans, with the seed of ``HashingTF``."""
    size = end - start
    blocks = np.ndarray(len(data), "<u4", np.concatenate([data, np.zeros(3, np.uint8)]), strides=(1,))
    found = np.full(len(size), _SEED, dtype=np.uint32)
    done, rest = 0, np.flatnonzero(size >= 4)
    while len(rest) > FEW:
        mixed = found[rest] ^ _scrambled(blocks[start[rest] + done])
        found[rest] = ((mixed << np.uint32(13)) | (mixed >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
        done += 4
        rest = rest[size[rest] >= done + 4]
    for i in rest:  # the few longest
        value = int(found[i])
        for block in _scrambled(blocks[start[i] + done:end[i] - 3:4]).tolist():
            value ^= block
            value = (((value << 13 | value >> 19) & _ALL) * 5 + 0xE6546B64) & _ALL
        found[i] = value
    over = size & 3
    last = blocks[np.minimum(end - over, len(data) - 1)] & _TAILS[over]
    found ^= _scrambled(last) ^ size.astype(np.uint32)
    found = (found ^ (found >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    found = (found ^ (found >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (found ^ (found >> np.uint32(16))).view(np.int32)


def _counted(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of buckets of each text; buckets in ascending order within a text; and their counts."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (edge | ~before))
    end = np.flatnonzero(before & (edge | ~inside))
    if not len(start):
        return np.zeros(len(offsets) - 1, np.int64), start, start
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    keys, counts = np.unique(text * buckets + word_hashes(data, start, end) % buckets, return_counts=True)
    return np.bincount(keys // buckets, minlength=len(offsets) - 1), keys % buckets, counts


def bucket_counts(texts: pa.Array, buckets: int) -> pa.StructArray:
    """A sparse vector for each lower-cased text: its words, maximal runs of ``\\w``, counted by bucket. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    part = (offsets[:-1] - offsets[0]) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)] if len(texts) else [0]
    none = np.zeros(0, np.int64)
    pieces = [
        _counted(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low], buckets)
        for low, high in zip(cuts[:-1], cuts[1:])
    ]
    sizes, found, counts = (np.concatenate([none, *column]) for column in zip(*pieces)) if pieces else (none, none, none)
    bounds = pa.array(np.concatenate([none, [0], np.cumsum(sizes)]), pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(len(texts), np.int8)),  # the mark of a sparse vector
            pa.array(np.full(len(texts), buckets, np.int32)),
            pa.ListArray.from_arrays(bounds, pa.array(found, pa.int32())),
            pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.float64))),
        ],
        names=["type", "size", "indices", "values"],
    )


def term_counts(text: Column, buckets: int) -> Column:
    """What ``RegexTokenizer`` (lower case, split at ``\\W+``) and ``HashingTF`` make of a text, null as an empty one."""

    @F.arrow_udf(VectorUDT())
    def counts(texts: pa.Array) -> pa.Array:
        return bucket_counts(texts, buckets)

    return counts(F.lower(text))
