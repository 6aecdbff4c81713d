"""Mixing to target weights with soft membership.

A naive Bayes classifier, fitted on a labelled table, gives every document a posterior over domains.
Each document gets a rate, the number of times it should be drawn, such that the expected tokens of
each domain, ``sum of rate * tokens * posterior``, match targets: a least-squares problem in
nonnegative rates, one per document. Of its solutions the one with the least squared change of rates
from 1, weighted by tokens, is taken: ``rate = max(0, 1 - posterior . v)`` with one number per domain.

``v`` is found by Newton steps with the matrix ``sum of tokens * p * p'`` over the documents whose rate
is positive, so rates of 0 do not slow them. A step is one pass over a narrow table that adds up, for
several lengths of the step at once, a few numbers per pair of domains; no rates are stored. If no
nonnegative rates meet the targets, the steps end at the least residual and a warning says so.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.multinomial import BITS, class_counts, collected, log_probabilities
from signalbox.llm.textkit import SPACE, slices, words
from signalbox.llm.wanted import read_again
from signalbox.sources.store import materialize

#: Labelled rows of each domain that the classifier is fitted on, those of the least hashed ids, at most.
FIT_ROWS = 20_000
#: The largest residual, as a share of all target tokens, of targets that count as met; steps at most.
TOLERANCE, STEPS = 1e-7, 100
#: Lengths of a step that one pass tries.
LENGTHS = 2.0 ** np.arange(4, -8, -1)
#: Weight of the change of ``v`` against the residual, in rounds that each start where the last one
#: ended, and the share by which a round has to lower the residual for another to follow.
DAMPING, PROGRESS = 1e-10, 1e-3


@dataclass
class Mixer:
    """Domains, classifier, and the steps of the rates; bounded by domains and places.

    ``met`` tells whether ``totals``, the expected tokens of the domains, are those of ``targets``;
    ``passes`` counts the passes over the memberships; ``missing`` names targets without a labelled text.
    """

    domains: list[str]
    prior: np.ndarray
    model: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    totals: np.ndarray | None = None
    targets: np.ndarray | None = None
    met: bool = True
    passes: int = 0
    missing: list[str] = field(default_factory=list)


def token_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and place of each word, A-Z as a-z."""
    w = words(texts, SPACE)
    return w.doc, (w.hash >> np.uint64(64 - BITS)).astype(np.int64)


def classifier(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, domain_col: str, fit_rows: int = FIT_ROWS) -> Mixer:
    """Fit on the texts of ``labelled(id_col, domain_col)``; an id with several domains counts as the first.

    Of each domain at most ``fit_rows`` labelled rows of ``docs`` are read; the prior counts all of them.
    """
    marks = (
        labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("part"))
        .where("id is not null and part is not null").groupBy("id").agg(F.min("part").alias("part"))
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = materialize(marks.join(rows.select("id").hint("merge"), "id", "left_semi"), "marks")
    share = {r["part"]: r["n"] for r in marks.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = [marks.where(F.col("part") == d).orderBy(F.xxhash64("id"), "id").limit(fit_rows) for d in sorted(share)]
    sample = materialize(reduce(DataFrame.union, parts, marks.limit(0)), "sample")
    chosen = read_again(rows, sample).join(sample.hint("merge"), "id").select("part", "text")
    counts = collected(class_counts(chosen, token_places))
    domains = [d for d in counts if d in share]
    prior = np.array([share[d] for d in domains], dtype=float)
    model = np.array([log_probabilities(counts[d]) for d in domains]) if domains else np.zeros((0, 1 << BITS))
    return Mixer(domains, np.log(prior / prior.sum()) if len(prior) else prior, model.astype(np.float32))


def posteriors(texts: pa.Array, mixer: Mixer) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its posterior over the domains.

    Words of a text are not independent: the evidence of n words counts as that of sqrt(n).
    """
    doc, place = token_places(texts)
    count = np.bincount(doc, minlength=len(texts))
    logs = np.stack([np.bincount(doc, weights=row[place], minlength=len(texts)) for row in mixer.model], axis=1)
    logs = mixer.prior + logs / np.sqrt(np.maximum(count, 1))[:, None]
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return count, p / p.sum(axis=1, keepdims=True)


def rates(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after all steps, from 1: each step goes down the gradient and back to nonnegative rates."""
    rate = np.ones(len(p))
    for v in steps:
        rate = np.maximum(0.0, rate - p @ v)
    return rate


def _matrix(batch: pa.RecordBatch, domains: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.asarray(batch.column("n_tokens"), dtype=float)
    return n, np.asarray(batch.column("posterior").flatten()).reshape(len(n), domains)


def _sums(n: np.ndarray, p: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """For each row of ``tried``, taken as ``v``: half the squared rates, tokens of the domains, and the matrix of positive rates."""
    found = []
    for v in tried:
        rate = np.maximum(0.0, 1.0 - p @ v)
        some = rate > 0
        drawn, held = rate[some] * n[some], p[some]
        found.append([drawn @ rate[some] / 2, *(drawn @ held), *((held * n[some, None]).T @ held).ravel()])
    return np.array(found)


def fit_rates(memberships: DataFrame, mixer: Mixer, targets: dict[str, float]) -> Mixer:
    """Rates that bring the expected tokens of the domains to ``targets``, shares of all tokens.

    A domain without a target has target 0; targets are scaled to sum to 1. If no nonnegative rates
    meet them, the rates approach the least residual, weighted by the inverse of ``sum of tokens * p * p'``,
    ``met`` is false, and a warning names the shares that are reached.
    """
    k = len(mixer.domains)

    def sums(tried: np.ndarray) -> np.ndarray:
        width = 1 + k + k * k

        def add(batches):
            total = np.zeros((len(tried), width))
            for batch in batches:
                total += _sums(*_matrix(batch, k), tried)
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), type=pa.int32()), "x": total.ravel()})

        values = np.zeros(len(tried) * width)
        for row in memberships.mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
            values[row["at"]] = row["x"]
        mixer.passes += 1
        return values.reshape(len(tried), width)

    return solve(sums, mixer, targets)


def solve(sums: Callable[[np.ndarray], np.ndarray], mixer: Mixer, targets: dict[str, float]) -> Mixer:
    """:func:`fit_rates` on the results of :func:`_sums`, added up over all documents.

    The rates minimise half the squared change of rates; ``v`` minimises the dual function, half the
    squared rates plus ``goal . v``, which is convex and quadratic between the places where a rate
    reaches 0. Each round also weighs the way from its start, so that a step exists when too few
    documents have a positive rate; rounds repeat until the targets are met or the residual stays.
    """
    k = len(mixer.domains)
    at = np.zeros(k)
    here = sums(at[None])[0]
    first, square = here[1:k + 1], here[k + 1:].reshape(k, k)
    wanted = np.array([max(0.0, float(targets.get(d, 0.0))) for d in mixer.domains])
    if not wanted.sum() or not first.sum():
        return mixer
    goal = wanted / wanted.sum() * first.sum()
    weight = np.linalg.pinv(square, rcond=1e-9, hermitian=True)
    reachable = square @ weight  # not what tells domains of equal posteriors apart
    allowed = TOLERANCE * goal.sum()
    start, last = at, np.inf
    for _ in range(STEPS):
        left = here[1:k + 1] - goal
        if np.abs(left).max() <= allowed:
            break
        left = reachable @ left
        slope = left - DAMPING * square @ (at - start)
        if np.abs(slope).max() <= 1e-3 * allowed or slope @ weight @ slope <= 1e-4 * (left @ weight @ left):
            residual = float(left @ weight @ left)
            if residual > (1 - PROGRESS) * last or residual <= TOLERANCE ** 2 * goal.sum():
                break
            start, last, slope = at, residual, left
        step = np.linalg.pinv(here[k + 1:].reshape(k, k) + DAMPING * square, rcond=1e-13, hermitian=True) @ slope
        tried = at + LENGTHS[:, None] * step
        found = sums(tried)
        way = tried - start
        value = found[:, 0] + tried @ goal + DAMPING / 2 * np.einsum("ij,jk,ik->i", way, square, way)
        best = int(np.argmin(value))
        at, here = tried[best], found[best]
    mixer.steps, mixer.totals, mixer.targets = [at], here[1:k + 1], goal
    mixer.met = bool(np.abs(mixer.totals - goal).max() <= allowed)
    if not mixer.met:
        reached = ", ".join(f"{d} {x:.6f} for {y:.6f}" for d, x, y in zip(mixer.domains, mixer.totals / goal.sum(), goal / goal.sum()))
        warnings.warn(f"no nonnegative rates were found that meet the targets; tokens as shares of all target tokens: {reached}", stacklevel=2)
    return mixer


def memberships(docs: DataFrame, mixer: Mixer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, draw, n_tokens, posterior`` of every row; ``draw`` is a number in [0, 1) from the id."""
    rows = docs.select(F.col(id_col).alias("id"), _draw(id_col).alias("draw"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, p = posteriors(part.column("text"), mixer)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), part.column("draw"), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * p.shape[1], type=pa.int32()), pa.array(p.ravel()))],
                    names=["id", "draw", "n_tokens", "posterior"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, draw double, n_tokens long, posterior array<double>").withColumnRenamed("id", id_col)


def _draw(id_col: str):
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain") -> tuple[Mixer, DataFrame | None]:
    """The fitted mixer, and the memberships it was fitted on (None without any labelled text)."""
    mixer = classifier(docs, labelled, id_col, text_col, domain_col)
    mixer.missing = sorted(d for d, share in targets.items() if share > 0 and d not in mixer.domains)
    if mixer.missing:
        warnings.warn(f"targets without a labelled text are left out and the others scaled up: {', '.join(mixer.missing)}", stacklevel=3)
    if not mixer.domains:
        return mixer, None
    held = materialize(memberships(docs, mixer, id_col, text_col), "memberships")
    return fit_rates(held, mixer, targets), held


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                 domain_col: str = "domain") -> DataFrame:
    """``id_col, n_tokens, rate, copies, posterior`` for every row of ``docs``.

    ``copies`` rounds the rate to a whole number, up with the probability of its fraction, by a draw
    that depends on the id alone. A null or empty text has no tokens and the posterior of the prior.
    Rows may repeat; rows without an id share one draw. Without labelled texts every rate is 1.
    Other columns are ignored.
    """
    mixer, held = fit(docs, labelled, targets, id_col, text_col, domain_col)
    if held is None:
        rows = docs.select(id_col, F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("n_tokens"))
        return rows.select(id_col, "n_tokens", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.array().cast("array<double>").alias("posterior"))
    k = len(mixer.domains)

    def run(batches):
        for batch in batches:
            rate = rates(_matrix(batch, k)[1], mixer.steps)
            copies = np.floor(rate + np.asarray(batch.column("draw"))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column("n_tokens"), pa.array(rate), pa.array(copies), batch.column("posterior")],
                names=[id_col, "n_tokens", "rate", "copies", "posterior"])

    kind = held.schema[id_col].dataType.simpleString()
    return held.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, rate double, copies long, posterior array<double>")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
          domain_col: str = "domain") -> DataFrame:
    """``docs`` that are drawn at least once, with all columns and ``n_tokens, rate, copies``.

    Posteriors are worked out again beside the text, so no text is shuffled. A column of ``docs``
    with one of the three names is replaced.
    """
    added = ("n_tokens", "rate", "copies")
    docs = docs.drop(*added)
    drawn = "_draw".ljust(max(map(len, docs.columns)) + 1, "_")
    mixer, held = fit(docs, labelled, targets, id_col, text_col, domain_col)
    if held is None:
        split = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        return docs.withColumns({"n_tokens": F.size(split).cast("long"), "rate": F.lit(1.0), "copies": F.lit(1).cast("long")})

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                n, p = posteriors(part.column(text_col), mixer)
                rate = rates(p, mixer.steps)
                copies = np.floor(rate + np.asarray(part.column(drawn))).astype(np.int64)
                kept = part.drop_columns([drawn])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(n.astype(np.int64)), pa.array(rate), pa.array(copies)],
                    names=[*kept.schema.names, *added]).filter(pa.array(copies > 0))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_tokens long", "rate double", "copies long"])
    return docs.withColumn(drawn, _draw(id_col)).mapInArrow(run, schema)
