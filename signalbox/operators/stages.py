"""The four places where user Python runs: generator, judge, scorer and verifier.

Generator and judge wait on remote calls, so each task runs them on a small thread pool over
pieces of an Arrow batch, about a megabyte each, so that the Python objects of a task do not grow with
the batch. They see a row's values as Python ones, ``None`` for null and whole
numbers whole; the columns themselves stay in Arrow and come out as they went in. The number of calls in
flight is ``running tasks x max_workers``; ``in_flight`` bounds it for the whole job. Every output row carries its key, so order within a
batch does not matter and nothing is gathered on the driver.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.text import GENERATION_ERROR_PREFIX, is_failed_response

Judge = Callable[[Mapping[str, Any]], "tuple[str, bool, str] | None"]
Generator = Callable[[Mapping[str, Any]], str]
Scorer = Callable[[pd.Series], pd.DataFrame]

_JUDGE_FIELDS = [
    T.StructField("extracted_answer", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("extraction_method", T.StringType()),
    T.StructField("judge_explanation", T.StringType()),
]

#: Bytes of the rows that are Python objects at once, about; a piece has a row for each worker at least.
PIECE_BYTES = 1 << 20

VERDICT_COLUMNS = [field.name for field in _JUDGE_FIELDS]


def _limited(rows: DataFrame, max_workers: int, in_flight: int | None) -> tuple[DataFrame, int]:
    """Rows in so few partitions, and workers for each, that no more calls than ``in_flight`` run at a time.

    Partitions are joined without a shuffle; they are streamed in batches, so their size needs no memory.
    Only a speculative copy of a task would add calls; leave speculation off where the bound is strict.
    """
    if in_flight is None:
        return rows, max_workers
    if in_flight < 1:
        raise ValueError("in_flight must be at least 1")
    workers = min(max_workers, in_flight)
    return rows.coalesce(in_flight // workers), workers


def _in_pieces(
    batches: Iterator[pa.RecordBatch], max_workers: int, call: Callable[[Any], Any],
    requests: Callable[[pa.RecordBatch], Iterable[Any]],
) -> Iterator[tuple[pa.RecordBatch, list[Any]]]:
    """Each batch in pieces, with the answers to the requests of a piece in their order.

    The calls of a piece start while the one before is still waited for, so no worker idles between them.
    """
    waiting: deque[tuple[pa.RecordBatch, list[Any]]] = deque()
    with ThreadPoolExecutor(max_workers) as pool:
        for batch in batches:
            step = max(max_workers, batch.num_rows * PIECE_BYTES // max(batch.nbytes, 1))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                waiting.append((piece, [pool.submit(call, request) for request in requests(piece)]))
                if len(waiting) > 1:
                    ready, answers = waiting.popleft()
                    yield ready, [answer.result() for answer in answers]
        while waiting:
            ready, answers = waiting.popleft()
            yield ready, [answer.result() for answer in answers]


def _verdict(judge: Judge, task: Mapping[str, Any], compat: bool) -> tuple[str, bool, str, str | None]:
    fallback = task["extracted_answer"]
    try:
        answer = judge(task)
    except Exception as error:  # a failing judge must not fail the job
        if compat:
            return "Judge error", False, "llm_judge", f"Error during LLM judgment: {error}"
        return fallback, False, "regex_fallback", f"LLM judge failed: {error}"
    if answer is None:
        if compat:
            return "Judge not available", False, "llm_judge", "LLM judge could not be initialized"
        return fallback, False, "regex_fallback", "LLM judge returned None"
    final, matches, why = answer
    return final, bool(matches), "llm_judge", why or None


def judge_stage(
    tasks: DataFrame, judge: Judge, max_workers: int = 40, compat: bool = False, only: str | None = None,
    in_flight: int | None = None,
) -> DataFrame:
    """Ask the judge about every row of ``tasks`` and replace its verdict columns.

    ``judge`` gets a row as a mapping (problem, full_response, correct_answer, is_mcq, choices,
    extracted_answer) and returns ``(final answer, match, explanation)``. An exception or
    ``None`` leaves the regex answer, marked ``regex_fallback``; with ``compat`` both are
    reported under ``llm_judge`` instead. With ``only``, a boolean column, the judge is asked about its
    true rows and the others keep the verdict columns they have. At most ``in_flight`` calls run at a time.
    """
    tasks, max_workers = _limited(tasks, max_workers, in_flight)
    replaced = {f.name for f in _JUDGE_FIELDS}
    passed = [f for f in tasks.schema.fields if f.name not in replaced]
    schema = T.StructType([*passed, *_JUDGE_FIELDS])

    kinds = [pa.string(), pa.bool_(), pa.string(), pa.string()]

    def asked(piece: pa.RecordBatch) -> list[dict[str, Any]]:
        return (piece if only is None else piece.filter(piece.column(only))).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, verdicts in _in_pieces(batches, max_workers, lambda row: _verdict(judge, row, compat), asked):
            if only is not None:
                answers, kept = iter(verdicts), piece.select([f.name for f in _JUDGE_FIELDS]).to_pylist()
                wanted = piece.column(only).to_pylist()
                verdicts = [next(answers) if ask else tuple(row.values()) for ask, row in zip(wanted, kept)]
            out = piece.select([f.name for f in passed])
            for position, (field, kind) in enumerate(zip(_JUDGE_FIELDS, kinds)):
                out = out.append_column(field.name, pa.array([v[position] for v in verdicts], type=kind))
            yield out

    return tasks.mapInArrow(run, schema)


def _answer(generator: Generator, request: Mapping[str, Any]) -> str:
    try:
        return generator(request).strip()
    except Exception as error:  # kept as a response, so the slot can be retried later
        return f"{GENERATION_ERROR_PREFIX} {error}"


def generate_samples(
    prompts: DataFrame, generator: Generator, k: int = 1, max_workers: int = 30, in_flight: int | None = None
) -> DataFrame:
    """``k`` responses per prompt, one row each: the input columns, ``response_idx``, ``full_response``.

    Samples of one prompt are spread like any other rows. A failed call becomes an error text.
    At most ``in_flight`` calls run at a time.
    """
    prompts, max_workers = _limited(prompts, max_workers, in_flight)
    slots = prompts.withColumn(
        "response_idx", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    )
    schema = T.StructType([*slots.schema.fields, T.StructField("full_response", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _in_pieces(batches, max_workers, lambda row: _answer(generator, row), pa.RecordBatch.to_pylist):
            yield piece.append_column("full_response", pa.array(texts, type=pa.string()))

    return slots.mapInArrow(run, schema)


def generate_nested(
    prompts: DataFrame, generator: Generator, k: int = 1, max_workers: int = 30, in_flight: int | None = None
) -> DataFrame:
    """``k`` responses per prompt kept in one row: no explode and no regrouping shuffle.

    Adds ``responses`` in sample order and ``success`` (false when every call failed). At most
    ``in_flight`` calls run at a time.
    """
    prompts, max_workers = _limited(prompts, max_workers, in_flight)
    fields = [*prompts.schema.fields, T.StructField("texts", T.ArrayType(T.StringType()))]

    def calls(piece: pa.RecordBatch) -> list[dict[str, Any]]:
        return [{**row, "response_idx": i} for row in piece.to_pylist() for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in _in_pieces(batches, max_workers, lambda row: _answer(generator, row), calls):
            grouped = [texts[n * k : (n + 1) * k] for n in range(piece.num_rows)]
            yield piece.append_column("texts", pa.array(grouped, type=pa.list_(pa.string())))

    generated = prompts.mapInArrow(run, T.StructType(fields))
    failed = F.forall("texts", lambda t: t.startswith(GENERATION_ERROR_PREFIX))
    return generated.select(
        *prompts.columns,
        F.transform("texts", lambda t: F.struct(t.alias("full_response"))).alias("responses"),
        (~failed).alias("success"),
    )


def drop_failed(generated: DataFrame) -> DataFrame:
    """Keep prompts with at least one answered sample."""
    return generated.filter("success")


def all_failed(generated: DataFrame) -> bool:
    """True when no question of a batch has a usable response."""
    usable: Column = F.exists("responses", lambda r: ~is_failed_response(r["full_response"]))
    return generated.filter(usable).limit(1).count() == 0


def score_with(df: DataFrame, text_col: str, scorer: Scorer, labels: list[str]) -> DataFrame:
    """Add ``{label}_probability`` columns from a batch scorer (texts in, probabilities out)."""
    names = [f"{label}_probability" for label in labels]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer(batch.column(text_col).to_pandas())
            for i, name in enumerate(names):
                batch = batch.append_column(name, pa.array(scores.iloc[:, i].to_numpy("float64")))
            yield batch

    return df.mapInArrow(run, schema)


def win_rate_scores(df: DataFrame, text_col: str, scorer: Callable[..., Any], batched: bool = False) -> DataFrame:
    """Confidence that the strong model is needed; a failing scorer gives the neutral 0.5.

    ``scorer`` takes one text, or with ``batched`` a list of texts and returns their scores.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("confidence", T.DoubleType())])

    def one(text: str) -> float:
        try:
            return float(scorer(text))
        except Exception:
            return 0.5

    def many(texts: list[str]) -> list[float]:
        try:
            return [float(score) for score in scorer(texts)]
        except Exception:
            return [0.5] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            scores = many(texts) if batched else [one(t) for t in texts]
            yield batch.append_column("confidence", pa.array(scores, type=pa.float64()))

    return df.mapInArrow(run, schema)
