"""Language identification as a mixture: proportions by expectation-maximisation, set by penalised likelihood.

Each language is a multinomial over hashed 3-byte grams of lower-cased text, counted on all labelled
rows. A document is cut into segments of a few words; the log-likelihood of a segment under each
language is the sum over its grams. Expectation-maximisation then fits the document's proportions of
languages. Starting from the best single language, the set grows along the fitted proportions while
the log-likelihood gains more than the penalty ``PENALTY * log(segments)`` of one more language.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.multinomial import BITS, class_counts, collected, log_probabilities
from signalbox.llm.textkit import SPACE, raw_bytes, slices, spans

SEGMENT_WORDS = 8
ROUNDS = 15
#: Nats per log(segments) that one more language has to gain; 3 asks for clear evidence in short texts too.
PENALTY, LEAST_GAIN = 1.0, 6.0
UNDETERMINED = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_GOLDEN32 = np.uint32(2654435769)


def _padded(texts: pa.Array):
    """Folded bytes with a space around each text, the place of the gram at each byte, and word spans."""
    data, offsets = raw_bytes(texts)
    size = np.diff(offsets)
    moved = offsets + np.arange(1, len(offsets) + 1)
    padded = np.full(len(data) + len(texts) + 4, 32, dtype=np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, len(size) + 1), size)] = _LOWER[data]
    wide = padded.astype(np.uint32)
    gram = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    place = (gram * _GOLDEN32) >> np.uint32(32 - BITS)
    start, end, doc = spans(padded, np.minimum(moved, len(padded)), SPACE)
    return place, start, end, doc


def gram_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of the grams that touch a word."""
    place, start, end, doc = _padded(texts)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(start - 1 - first, size)
    return np.repeat(doc, size), place[at].astype(np.int64)


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(c.isalpha() for c in text))


def fitted_mixture(logs: np.ndarray, doc: np.ndarray, n: int, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihood of each text, from segment log-likelihoods.

    ``doc`` numbers the text of each segment, ascending; ``allowed`` marks the languages of each text.
    """
    count = np.bincount(doc, minlength=n)
    full = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[full]
    allowed = np.ones((n, logs.shape[1]), dtype=bool) if allowed is None else allowed
    share = allowed / np.maximum(allowed.sum(axis=1, keepdims=True), 1)
    if not len(full):
        return share, np.zeros(n)
    top = logs.max(axis=1)
    likely = np.exp(logs - top[:, None])
    for _ in range(ROUNDS):
        joint = share[doc] * likely
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        share[full] = np.add.reduceat(joint, first, axis=0) / count[full, None]
    total = np.zeros(n)
    total[full] = np.add.reduceat(np.log(np.maximum((share[doc] * likely).sum(axis=1), 1e-300)) + top, first)
    return share, total


def _inferred(texts: pa.Array, model: np.ndarray):
    """Chosen proportions, whole-text evidence and set of languages of each text."""
    place, start, end, doc = _padded(texts)
    n, languages = len(texts), model.shape[0]
    count = np.bincount(doc, minlength=n)
    rank = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    opens = np.flatnonzero(rank % SEGMENT_WORDS == 0)
    closes = np.concatenate([opens[1:], [len(doc)]]) - 1 if len(opens) else opens
    segment_doc = doc[opens]
    logs = np.zeros((len(opens), languages))
    for j in range(languages):
        total = np.concatenate([[0.0], np.cumsum(model[j][place], dtype=np.float64)])
        logs[:, j] = total[end[closes]] - total[start[opens] - 1]
    free, _ = fitted_mixture(logs, segment_doc, n)
    order = np.argsort(-free, axis=1, kind="stable")
    segments = np.maximum(np.bincount(segment_doc, minlength=n), 1)
    penalty = np.maximum(PENALTY * np.log(segments), LEAST_GAIN)

    whole = np.zeros((n, languages))
    np.add.at(whole, segment_doc, logs)
    best = whole.argmax(axis=1)
    chosen = np.zeros((n, languages), dtype=bool)
    chosen[np.arange(n), best] = True
    value, share = whole[np.arange(n), best], chosen.astype(float)
    growing = np.flatnonzero(segments > 1)
    for size in range(2, languages + 1):
        if not len(growing):
            break
        tried = np.zeros((n, languages), dtype=bool)
        for j in range(size):
            tried[growing, order[growing, j]] = True
        rows = np.flatnonzero(np.isin(segment_doc, growing))
        found, likelihood = fitted_mixture(logs[rows], segment_doc[rows], n, tried)
        more = size - chosen[growing].sum(axis=1)
        better = growing[likelihood[growing] > value[growing] + penalty[growing] * more]
        chosen[better], value[better], share[better] = tried[better], likelihood[better], found[better]
        growing = better
    evidence = np.exp(logs - logs.max(axis=1, keepdims=True)) if len(logs) else logs
    evidence = evidence / evidence.sum(axis=1, keepdims=True) if len(logs) else evidence
    support = np.zeros((n, languages))
    np.add.at(support, segment_doc, evidence)
    return share, support / segments[:, None], chosen


def _predictor(names: list[str], model: np.ndarray, schema: pa.Schema):
    def predict(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                known = np.array([has_letter(t) for t in part.column("text").to_pylist()], dtype=bool) & bool(names)
                if not names:
                    best, score, listed = [UNDETERMINED] * n, np.zeros(n), [""] * n
                else:
                    share, support, chosen = _inferred(part.column("text"), model)
                    top = share.argmax(axis=1)
                    best = [names[i] if k else UNDETERMINED for i, k in zip(top, known)]
                    score = np.where(known, support[np.arange(n), top], 0.0)
                    listed = [
                        ",".join(f"{names[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if c[j]) if k else ""
                        for s, c, k in zip(share, chosen, known)]
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id"), "lang_pred": best, "score": np.clip(score, 0, 1), "mixture": listed}, schema=schema)

    return predict


def learned(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of each place, from all rows with a language."""
    rows = labelled.select(F.col(lang_col).alias("part"), F.col(text_col).alias("text")).where("text is not null")
    counts = collected(class_counts(rows, gram_places))
    names = list(counts)
    model = np.array([log_probabilities(counts[name]) for name in names]) if names else np.zeros((0, 1 << BITS))
    return names, model.astype(np.float32)


def identify(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col, lang_pred, score, mixture`` for every row of ``docs``.

    ``mixture`` lists the chosen languages with their proportions; ``lang_pred`` has the largest.
    ``score`` is the mean support of that language over the segments, all languages being as likely
    beforehand. A null text, or one without a letter, is ``und`` with score 0; so is every text if
    ``labelled`` has no language. Ties go to the first name. Other columns are ignored.
    """
    names, model = learned(labelled, lang_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    id_arrow = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    schema = pa.schema([("id", id_arrow), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.string())])
    found = rows.mapInArrow(_predictor(names, model, schema), f"id {id_type}, lang_pred string, score double, mixture string")
    return found.withColumnRenamed("id", id_col)
