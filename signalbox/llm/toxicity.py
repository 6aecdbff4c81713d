"""Toxicity: a logistic classifier with counterfactual regularisation.

Features of a text are the words and word beginnings that occur in it. The loss is the weighted
logistic loss, an L2 term, and a penalty on counterfactuals: in each labelled text that names a group,
the identity term is swapped for every other term of its kind, and the squared change of the score
is added, averaged over the swaps of the text. So an identity term that stands in toxic texts more often
than its counterparts does not raise the score of a neutral mention. A swap changes exactly the features
that the swapped text would have: those that other words of the text have too stay, and a counterpart
that stands in the text already adds nothing.

The classifier is fitted on a bounded sample of labelled rows: ``FIT_POSITIVE`` and ``FIT_NEGATIVE``
rows at most, those of the least hashed ids; both labels weigh the same. Spark counts their features by
label and picks about as many as there are rows, those whose occurrence differs most between the labels;
one task then fits on these alone, so what it holds is bounded by rows times features, however long the
texts are. Scoring reads every whole text once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.textkit import NOT_ALNUM, slices, span_hashes, words
from signalbox.llm.wanted import read_again
from signalbox.sources.store import materialize

#: Labelled rows that are fitted on, by label, at most.
FIT_POSITIVE, FIT_NEGATIVE = 4_000, 8_000
#: Features of the model: as many as fitted rows, within these bounds; texts that a feature has to occur in.
FEATURES, LEAST_TEXTS = (1 << 8, 1 << 14), 3
#: Lengths in bytes of the word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
ROUNDS, RIDGE, COUNTERFACTUAL = 300, 4.0, 40.0

#: Neutral names of groups, by kind; a term is swapped for the others of its kind. Terms are single words,
#: compared with A-Z in lower case; pass terms of other languages as ``terms``.
IDENTITY_TERMS = {
    "religion": "muslim christian jewish hindu buddhist sikh catholic protestant atheist",
    "origin": "african american asian european mexican indian chinese arab latino",
    "appearance": "black white brown",
    "gender": "woman man female male transgender nonbinary",
    "orientation": "gay straight lesbian bisexual heterosexual homosexual queer",
    "age": "old young elderly teenage",
    "ability": "blind deaf disabled paralyzed autistic",
}


def _word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """A row for each word: its hash and those of its beginnings, salted by their length, 0 where it is too short."""
    order = np.argsort(start)
    columns = [hashed]
    for length in BEGINNINGS:
        values = np.zeros(len(hashed), dtype=np.uint64)
        longer = order[(end - start)[order] > length]
        values[longer] = span_hashes(_folded(data), start[longer], start[longer] + length) ^ np.uint64(length)
        columns.append(values)
    return np.stack(columns, axis=1) if len(hashed) else np.zeros((0, 1 + len(BEGINNINGS)), dtype=np.uint64)


def _distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and word number of each distinct word of each text, and the features of the words."""
    w = words(texts, NOT_ALNUM)
    different, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    table = _word_features(w.data, w.start[one], w.end[one], different)
    n = max(len(different), 1)
    pair = np.unique(w.doc.astype(np.int64) * n + which) if len(which) else np.zeros(0, dtype=np.int64)
    return pair // n, pair % n, table


def _of_texts(doc: np.ndarray, word: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of each distinct feature, and the number of the text's words that have it."""
    doc, values = np.repeat(doc, table.shape[1]), table[word].ravel()
    doc, values = doc[values != 0], values[values != 0]
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])]) if len(doc) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(fresh)
    return doc[at], values[at], np.diff(np.append(at, len(doc)))


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct feature."""
    return _of_texts(*_distinct_words(texts))[:2]


def _folded(data: np.ndarray) -> np.ndarray:
    upper = (data >= 0x41) & (data <= 0x5A)
    return np.where(upper, data + 32, data).astype(np.uint8)


class Terms:
    """Features of identity terms, by the hash of the term, and the terms of the same kind."""

    def __init__(self, kinds: Mapping[str, str]):
        self.features: dict[int, np.ndarray] = {}
        self.others: dict[int, list[int]] = {}
        for kind in kinds.values():
            doc, word, table = _distinct_words(pa.array(kind.split()))
            own = [int(table[w][0]) for _, w in sorted(zip(doc, word))]
            for _, w in zip(doc, word):
                self.features[int(table[w][0])] = np.unique(table[w][table[w] != 0])
            for term in own:
                known = self.others.setdefault(term, [])
                known += [other for other in own if other != term and other not in known]
        self.hashes = np.array(sorted(self.features), dtype=np.uint64)

    def all_features(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.features.values(), np.zeros(0, dtype=np.uint64)]))

    def swaps(self, present: np.ndarray, values: np.ndarray, support: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Features added and removed by each swap in a text.

        ``present`` are the hashes of the text's terms, ``values`` its features in order, and ``support``
        the number of its distinct words that have them.
        """
        found = []
        for term in map(int, present):
            own = self.features[term]
            alone = own[support[np.searchsorted(values, own)] == 1]
            for other in self.others[term]:
                its = self.features[other]
                found.append((its[~np.isin(its, values)], alone[~np.isin(alone, its)]))
        return found


_FEATURES = pa.schema([
    ("label", pa.int32()), ("features", pa.list_(pa.int64())),
    ("swaps", pa.list_(pa.struct([("added", pa.list_(pa.int64())), ("removed", pa.list_(pa.int64()))])))])
_FEATURES_DDL = "label int, features array<long>, swaps array<struct<added array<long>, removed array<long>>>"


def _featurizer(terms: Terms):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                doc, word, table = _distinct_words(part.column("text"))
                named = np.isin(table[word, 0], terms.hashes)
                term_doc, term = doc[named], table[word[named], 0]
                doc, values, support = _of_texts(doc, word, table)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                swaps = [[] for _ in range(part.num_rows)]
                for i in np.unique(term_doc):
                    own = slice(bounds[i], bounds[i + 1])
                    swaps[i] = [{"added": a.view(np.int64), "removed": r.view(np.int64)}
                                for a, r in terms.swaps(term[term_doc == i], values[own], support[own])]
                yield pa.RecordBatch.from_arrays([
                    part.column("label").cast(pa.int32()),
                    pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(values.view(np.int64))),
                    pa.array(swaps, type=_FEATURES.field("swaps").type)], schema=_FEATURES)

    return run


def _flat(lists, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the list and place in the vocabulary of every known feature of some lists."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate([*lists, np.zeros(0, dtype=np.uint64)]).astype(np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    known = vocabulary[at] == values
    return row[known], at[known]


def fitted(sets, labels: np.ndarray, swaps, vocabulary: np.ndarray, strength: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights of the features in ``vocabulary`` (sorted) and the bias; deterministic for a given order of rows.

    ``sets`` holds the features of each text, ``swaps`` a list of (added, removed) features for each text.
    """
    n, size = max(len(sets), 1), len(vocabulary)
    ones = labels.sum()
    weight = np.where(labels == 1, 0.5 / max(ones, 1), 0.5 / max(len(labels) - ones, 1)) * len(labels)
    row, column = _flat(sets, vocabulary)
    base = np.repeat(np.arange(len(swaps)), [len(x) for x in swaps])
    share = strength / n / np.bincount(base, minlength=len(sets))[base]
    plus, plus_at = _flat([added for own in swaps for added, _ in own], vocabulary)
    minus, minus_at = _flat([removed for own in swaps for _, removed in own], vocabulary)

    w, bias = np.zeros(size), 0.0
    second_w, second_bias = np.zeros(size), 0.0
    first_w, first_bias = np.zeros(size), 0.0
    for step in range(1, ROUNDS + 1):
        logit = bias + np.bincount(row, weights=w[column], minlength=len(sets))
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        error = weight * (score - labels) / n
        if len(base):
            moved = logit[base] + np.bincount(plus, weights=w[plus_at], minlength=len(base)) - np.bincount(minus, weights=w[minus_at], minlength=len(base))
            other = 1 / (1 + np.exp(-np.clip(moved, -30, 30)))
            change = 2 * share * (score[base] - other)
            mine, its = change * score[base] * (1 - score[base]), change * other * (1 - other)
            error += np.bincount(base, weights=mine - its, minlength=len(sets))
        slope = np.bincount(column, weights=error[row], minlength=size) + RIDGE * w / n
        if len(base):
            slope -= np.bincount(plus_at, weights=its[plus], minlength=size)
            slope += np.bincount(minus_at, weights=its[minus], minlength=size)
        first_w, second_w = 0.9 * first_w + 0.1 * slope, 0.99 * second_w + 0.01 * slope**2
        first_bias, second_bias = 0.9 * first_bias + 0.1 * error.sum(), 0.99 * second_bias + 0.01 * error.sum() ** 2
        rate = 0.1 * (1 - step / (ROUNDS + 1))
        w = w - rate * (first_w / (1 - 0.9**step)) / (np.sqrt(second_w / (1 - 0.99**step)) + 1e-8)
        bias -= rate * (first_bias / (1 - 0.9**step)) / (math.sqrt(second_bias / (1 - 0.99**step)) + 1e-8)
    return w, bias


def _unsigned(values: pa.Array) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def _known(vocabulary: np.ndarray):
    """Leaves the features of the vocabulary alone, so rows are bounded whatever their texts."""
    def kept(lists: pa.ListArray) -> pa.ListArray:
        values = _unsigned(lists.flatten())
        at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
        known = vocabulary[at] == values
        before = np.concatenate([[0], np.cumsum(known)])
        ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        return pa.ListArray.from_arrays(pa.array(before[ends], type=pa.int32()), pa.array(values[known].view(np.int64)))

    def run(batches):
        for batch in batches:
            swaps = batch.column("swaps")
            flat = swaps.flatten()
            pairs = pa.StructArray.from_arrays([kept(flat.field(k)) for k in ("added", "removed")], ["added", "removed"])
            ends = np.concatenate([[0], np.cumsum(np.asarray(swaps.value_lengths()))])
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), kept(batch.column("features")),
                pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pairs)], schema=_FEATURES)

    return run


def _fitter(vocabulary: np.ndarray, strength: float):
    def fit(batches):
        rows = []
        for batch in batches:
            features = batch.column("features")
            flat, ends = _unsigned(features.flatten()), np.cumsum(np.asarray(features.value_lengths()))
            swaps = batch.column("swaps").to_pylist()
            for label, end, size, own in zip(batch.column("label").to_pylist(), ends, np.diff(ends, prepend=0), swaps):
                rows.append((label, flat[end - size:end].copy(), [(_unsigned(s["added"]), _unsigned(s["removed"])) for s in own]))
        if rows and len(vocabulary):
            rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), len(r[2])))
            labels, sets, swaps = zip(*rows)
            w, bias = fitted(sets, np.array(labels, dtype=float), swaps, vocabulary, strength)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([*vocabulary.view(np.int64), 0]), "weight": pa.array([*w, bias])})

    return fit


def _vocabulary(features: DataFrame, terms: Terms) -> np.ndarray:
    """The features that differ most between the labels, ``FEATURES`` at most, and those of the terms."""
    rows = {r.label: r.rows for r in features.groupBy("label").agg(F.count("*").alias("rows")).collect()}
    total = sum(rows.values())
    if not total:
        return np.zeros(0, dtype=np.uint64)
    limit = min(max(total, FEATURES[0]), FEATURES[1])
    share = (F.col("texts") + 1) * F.lit(rows.get(1, 0) / total)
    found = (
        features.select("label", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.count("*").alias("texts"), F.sum("label").alias("ones")).where(F.col("texts") >= LEAST_TEXTS)
        .orderBy(F.desc(F.abs(F.col("ones") - share) / F.sqrt(share + 1)), "feature").limit(limit).select("feature").toPandas()
    )
    return np.union1d(found["feature"].to_numpy(dtype=np.int64).view(np.uint64), terms.all_features())


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
            limits: tuple[int, int] = (FIT_NEGATIVE, FIT_POSITIVE), strength: float = COUNTERFACTUAL,
            terms: Mapping[str, str] = IDENTITY_TERMS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from a bounded, deterministic sample of ``labels``; ids with both labels count as 1."""
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    )
    sample = None
    for label, limit in zip((0, 1), limits):
        part = marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(limit)
        sample = part if sample is None else sample.union(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = read_again(rows, sample).join(sample.hint("merge"), "id").select("label", "text")
    known_terms = Terms(terms)
    features = materialize(chosen.mapInArrow(_featurizer(known_terms), _FEATURES_DDL), "features")
    vocabulary = _vocabulary(features, known_terms)
    if not len(vocabulary):
        return np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0
    narrow = features.mapInArrow(_known(vocabulary), _FEATURES_DDL).repartition(1)
    found = narrow.mapInArrow(_fitter(vocabulary, strength), "feature long, weight double").toPandas()
    if found.empty:
        return np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0
    values, weight = found["feature"].to_numpy().view(np.uint64), found["weight"].to_numpy()
    return values[:-1], weight[:-1], float(weight[-1])


def _scorer(vocabulary: np.ndarray, weights: np.ndarray, bias: float, schema: pa.Schema):
    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                doc, values = text_features(part.column("text"))
                logit = np.full(part.num_rows, bias)
                if len(vocabulary) and len(values):
                    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
                    known = vocabulary[at] == values
                    logit += np.bincount(doc[known], weights=weights[at[known]], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(logit, -50, 50))))], schema=schema)

    return score


def score(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          terms: Mapping[str, str] = IDENTITY_TERMS) -> DataFrame:
    """``id_col, score, predicted`` for every row of ``docs``.

    ``labels`` names the rows of ``training`` to learn from. A null or empty text gets the score of a
    text without features. Labels other than 0 and 1, null ids and ids without a text are not learned
    from; without labels every score is 0.5. ``terms`` names groups by kind, as words between blanks; without
    any there is no penalty. Other columns are ignored.
    """
    model = learned(training, labels, id_col, text_col, label_col, terms=terms)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = pa.schema([("id", {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())), ("score", pa.float64())])
    found = rows.mapInArrow(_scorer(*model, schema), f"id {id_type}, score double")
    return found.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
