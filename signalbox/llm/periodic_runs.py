"""Periodic run detection: seeds of equal k-grams, extended along the diagonals of their lags.

A run is a stretch of words of smallest period q that is long enough, so on the diagonal of lag q it
matches itself over its length less q. That overlap is at least ``k(q) = least length - q``, which grows
with q. Lags are therefore taken in classes ``lo .. k(lo)``, and a class indexes all ``k(lo)``-grams of a
text: every run of the class then has seeds, and since ``k >= q`` a gram of the run cannot recur sooner
than q words later (the period would not be the smallest). So the occurrence pairs that matter are those
of neighbouring occurrences, at most one for each word, however often a gram occurs.

Seeds are taken by lag and place. A seed next to the one before it lies within what that one covers and
extends it; only a seed beyond the furthest word covered on its lag begins an extension. The classes
triple, so a text of n words takes about log n sorts of n numbers, and its index is dropped after each.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import SPACE, mix64, slices, words

#: A run has so many words, and so many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def overlap(q: int) -> int:
    """Words over which every run of period q matches itself at lag q."""
    return max(LEAST_WORDS, LEAST_PERIODS * q) - q


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * _A + mix64(right + _B))


def _grams(doubled: list[np.ndarray], k: int, n: int) -> np.ndarray:
    """Hash of the k words at each place, from the hashes of powers of two: two that overlap cover k."""
    power = k.bit_length() - 1
    while len(doubled) <= power:
        last, step = doubled[-1], 1 << (len(doubled) - 1)
        doubled.append(_joined(last[:len(last) - step], last[step:]))
    size = max(0, n - k + 1)
    return _joined(doubled[power][:size], doubled[power][k - (1 << power):][:size])


def runs(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word, length and smallest period of every run.

    ``word`` are the words' hashes, ``doc`` the number of the text of each, ascending; first words are
    counted within the whole array. Sorted by text, first word and period.
    """
    found = []
    longest = int(np.bincount(doc).max()) if len(doc) else 0
    doubled = [word]
    low = 1
    while max(LEAST_WORDS, LEAST_PERIODS * low) <= longest:
        k = overlap(low)
        gram = _grams(doubled, k, len(word))
        at = np.flatnonzero(doc[:len(gram)] == doc[k - 1:])
        key = mix64(gram[at] + doc[at].astype(np.uint64) * _A)
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        lag = place[1:] - place[:-1]
        seed = np.flatnonzero((key[1:] == key[:-1]) & (lag >= low) & (lag <= k))
        place, lag = place[seed], lag[seed]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # The furthest place covered on a lag is that of its last seed: one further begins anew.
        fresh = np.ones(len(place), dtype=bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1) | (doc[place[1:]] != doc[place[:-1]])
        first = np.flatnonzero(fresh)
        last = np.append(first, len(place))[1:] - 1
        period = lag[first]
        length = place[last] - place[first] + k + period
        kept = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append((place[first][kept], length[kept], period[kept]))
        low = k + 1
    start, length, period = (np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in range(3))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return doc[start] if len(start) else start, start, length, period


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words outside every run, or within its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _finder(schema: pa.Schema):
    def find(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), SPACE, fold=False)
                doc, start, length, period = runs(w.hash, w.doc)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                start = start - w.first[doc]
                texts = []
                for i in range(part.num_rows):
                    own = slice(bounds[i], bounds[i + 1])
                    pieces = w.data[w.offsets[i]:w.offsets[i + 1]].tobytes().split()
                    if bounds[i] < bounds[i + 1]:
                        pieces = compress(pieces, _kept(len(pieces), start[own], length[own], period[own]))
                    texts.append(b" ".join(pieces))
                listed = pa.ListArray.from_arrays(
                    pa.array(bounds, type=pa.int32()),
                    pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in (start, length, period)], fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(w.count, type=pa.int64()), listed, pa.array(texts, type=pa.binary()).cast(pa.string())], schema=schema)

    return find


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, runs, collapsed`` for every row of ``docs``.

    Words are runs of characters other than ASCII white space. ``runs`` lists ``start, length, period``
    of each maximal stretch of smallest period q with ``max(6, 4 * q)`` words at least, by start and
    period; several may overlap. ``collapsed`` has the words that no run holds beyond its first period,
    joined by a space. A null, empty or blank text has no words, no runs and an empty collapsed text.
    Repeated rows are searched each, a null id is kept, other columns are ignored.

    A text is searched whole: its words take about 100 bytes each while it is at hand. Words are compared
    by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    id_arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
    schema = pa.schema([("id", id_arrow), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
    found = rows.mapInArrow(
        _finder(schema), f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("id", id_col)
