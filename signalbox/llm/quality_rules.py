"""Quality rules: counted features of the text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed word unigrams and bigrams: one counted on trusted
documents, one on the raw corpus. A document's score is the mean, over its n-grams, of
``log p_trusted - log p_raw``: normalised by length, so short and long documents meet the same
threshold. The verdict is deterministic: the score of every document is compared with a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.multinomial import BITS, class_counts, collected, log_probabilities
from signalbox.llm.textkit import SPACE, grams, mix64, slices, span_hashes, spans, words
from signalbox.llm.wanted import read_again

#: A document is kept from this mean log-likelihood ratio on.
THRESHOLD = -0.1
#: Counts added to each place of both multinomials: this share of the trusted counts over all places, and
#: in small corpora, where few counts say little, so many at least.
SMOOTHING_SHARE, LEAST_SMOOTHING = 0.6, 16.0
#: Base rules: fewer words fail, and so do repeated words beyond this percentage.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NOT_NEWLINE = np.zeros(256, dtype=bool)
_NOT_NEWLINE[ord("\n")] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _places(w) -> tuple[np.ndarray, np.ndarray]:
    at, pair = grams(w, 2)
    shift = np.uint64(64 - BITS)
    return np.concatenate([w.doc, w.doc[at]]), (np.concatenate([mix64(w.hash), pair]) >> shift).astype(np.int64)


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of each word and each pair of neighbouring words."""
    return _places(words(texts, SPACE, fold=False))


def _within(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Counted features of each text, and the places of its n-grams."""
    w = words(texts, SPACE, fold=False)
    n = len(texts)
    lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    chars = np.bincount(w.doc, weights=lead[w.end] - lead[w.start], minlength=n).astype(np.int64)

    start, end, doc = spans(w.data, w.offsets, _NOT_NEWLINE)
    solid = np.concatenate([[0], np.cumsum(~SPACE[w.data])])
    with_word = solid[end] > solid[start]
    start, end, doc = start[with_word], end[with_word], doc[with_word]
    _, one = np.unique(mix64(span_hashes(w.data, start, end) + doc.astype(np.uint64) * _SALT), return_index=True)
    lines = np.bincount(doc, minlength=n) - np.bincount(doc[one], minlength=n)

    at, triple = grams(w, 3)
    _, which, seen = np.unique(mix64(triple + w.doc[at].astype(np.uint64) * _SALT), return_inverse=True, return_counts=True)
    twice = at[seen[which] > 1] if len(at) else at
    covered = np.zeros(len(w.hash), dtype=bool)
    for j in range(3):
        covered[twice + j] = True
    found = {
        "n_words": w.count, "word_chars": chars, "n_symbols": _within(_SYMBOL[w.data], w.offsets),
        "n_dup_lines": lines, "n_repeat_words": np.bincount(w.doc[covered], minlength=n),
    }
    return found, _places(w)


def trusted_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratio of each place, from all of ``docs`` and those whose id is in ``trusted``.

    Raw counts are scaled to the trusted total, and both are smoothed by a share of it, so the ratio of a
    place does not grow with the corpus, and a place too rare to be expected among the trusted documents
    says nothing. The raw corpus includes the trusted documents. Only texts of trusted ids are shuffled, by a merge
    join at every size. Without trusted documents the ratio is 0.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    raw = collected(class_counts(rows.select(F.lit("raw").alias("part"), "text"), word_places))
    ids = trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    chosen = read_again(rows, ids).join(ids.hint("merge"), "id", "left_semi")
    counts = collected(class_counts(chosen.select(F.lit("trusted").alias("part"), "text"), word_places))
    none = np.zeros(1 << BITS)
    if "trusted" not in counts:
        return none
    scaled = raw["raw"] * (counts["trusted"].sum() / raw["raw"].sum())
    smoothing = max(LEAST_SMOOTHING, SMOOTHING_SHARE * counts["trusted"].sum() / len(scaled))
    return log_probabilities(counts["trusted"], smoothing) - log_probabilities(scaled, smoothing)


def _scorer(ratio: np.ndarray, schema: pa.Schema):
    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found, (doc, place) = features(part.column("text"))
                size = np.bincount(doc, minlength=part.num_rows)
                mean = np.bincount(doc, weights=ratio[place], minlength=part.num_rows) / np.maximum(size, 1)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), **found, "score": mean}, schema=schema)

    return score


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """Features, ``score``, ``base_failed`` and ``kept`` of every row of ``docs``.

    ``trusted`` holds the ids of trusted documents. A null text has no words, fails the base rules
    and is not kept. A null id is never trusted; its row is scored like any other. Repeated rows
    are scored each. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    ratio = trusted_ratio(docs, trusted, id_col, text_col).astype(np.float32)
    schema = pa.schema([
        ("id", pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()),
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()), ("score", pa.float64())])
    scored = rows.mapInArrow(
        _scorer(ratio, schema),
        f"id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        scored.withColumnRenamed("id", id_col).withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def keep(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns, dropped where they are read."""
    ratio = trusted_ratio(docs, trusted, id_col, text_col).astype(np.float32)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                found, (doc, place) = features(part.column(text_col))
                size = np.maximum(np.bincount(doc, minlength=part.num_rows), 1)
                mean = np.bincount(doc, weights=ratio[place], minlength=part.num_rows) / size
                n, repeated = found["n_words"], found["n_repeat_words"]
                yield part.filter(pa.array((n >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PERCENT * n) & (mean >= threshold)))

    return docs.mapInArrow(run, docs.schema)
