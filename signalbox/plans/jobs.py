"""The composed jobs: grade, collect, cascade, publish and evaluate."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.answers import answers_match
from signalbox.operators import evaluation, grading, metrics, resume
from signalbox.operators.prompts import with_prompts
from signalbox.operators.publish import publish_splits
from signalbox.operators.splits import batch_index, dense_index
from signalbox.operators.stages import VERDICT_COLUMNS, Generator, Judge, all_failed, generate_nested, judge_stage
from signalbox.schemas import GRADED_RESULT, RAW_RESULT, RESULT_COLUMNS
from signalbox.session import fresh_dir
from signalbox.sources.jsonl import fill_defaults, model_collisions, read_results_directory, store_split_folder
from signalbox.sources.store import BatchLog, ResultStore, VersionedTable, matching_paths


def grade_job(
    results: DataFrame, out: str, judge: Judge | None = None, keep: tuple[str, ...] = ("category",), max_workers: int = 40
) -> dict[str, DataFrame]:
    """Grade once, store the rows, and give the accuracy tables read from the store.

    The stored rows are what makes the judge run exactly once per unresolved response.
    """
    if judge is None:
        rows = grading.grade_rows(grading.explode_responses(results), answers_match)
        columns = ["unique_id", "response_idx", *keep, "full_response", "extracted_answer",
                   "is_correct", "extraction_method"]
        graded = rows.select(*columns).withColumn("judge_explanation", F.lit(None).cast("string"))
    else:
        graded = grading.grade_three_phase(results, judge, max_workers, keep=keep)
    graded.write.mode("errorifexists").parquet(out)
    stored = results.sparkSession.read.parquet(out)
    unanswered = results.filter(F.size("responses") == 0).select(
        *keep, *[F.lit(None).cast(t).alias(n) for n, t in (("response_idx", "int"), ("is_correct", "boolean"))]
    )
    countable = stored.select(*keep, "response_idx", "is_correct").unionByName(unanswered)
    tables = {
        "graded": stored,
        "overall": metrics.overall_accuracy(stored),
        "by_method": metrics.accuracy_by_method(stored),
    }
    if "category" in keep:
        tables["by_category"] = metrics.accuracy_by_category(countable)
    if "model" in keep:
        tables["by_model"] = metrics.accuracy_by_model(stored)
        if "category" in keep:
            tables["by_model_parts"] = metrics.accuracy_grouping_sets(stored)
    return tables


def grade_directory_job(
    spark: SparkSession, path: str, out: str, judge: Judge | None = None, max_workers: int = 40
) -> dict[str, DataFrame]:
    """Grade every result file of a folder and report per model, category and method.

    The tables of :func:`grade_job`, with ``by_model``, ``by_model_parts`` (model, model and category,
    model and method) and ``collisions``, the models fed by more than one file.
    """
    results = fill_defaults(read_results_directory(spark, path, RAW_RESULT))
    tables = grade_job(results, out, judge, ("model", "file", "category"), max_workers)
    return tables | {"collisions": model_collisions(tables["graded"])}


#: What a judge sees of a task, and so what makes two tasks the same.
TASK_COLUMNS = ("problem", "full_response", "correct_answer", "is_mcq", "choices", "extracted_answer")


def judge_job(
    tasks: DataFrame,
    log_path: str,
    judge: Judge,
    batches: int = 16,
    max_workers: int = 40,
    retry_failed: bool = False,
    in_flight: int | None = None,
    keys: tuple[str, ...] = ("unique_id", "response_idx"),
) -> DataFrame:
    """Verdicts on ``tasks`` from a log at ``log_path``: each distinct task is asked once, over all runs.

    Tasks are the same if all of ``TASK_COLUMNS`` are, by their SHA-256. Those without a verdict in the log are
    written once, split by the hash into ``batches``, and each batch is committed when it is answered,
    so a run that was stopped asks only what its finished batches leave. With ``retry_failed``, tasks whose
    judge failed are asked again, and the later verdict counts. Returns ``keys`` and the verdict columns;
    only these and the digest meet in a join, never the texts.
    """
    spark = tasks.sparkSession
    log = BatchLog(spark, log_path)
    digest = F.sha2(F.to_json(F.struct(*TASK_COLUMNS), {"ignoreNullFields": "false"}), 256)
    keyed = tasks.withColumn("task", digest)
    known = log.read()
    if known is not None:
        answered = known.where("extraction_method = 'llm_judge'") if retry_failed else known
        open_tasks = keyed.join(answered.select("task").distinct(), "task", "left_anti")
    else:
        open_tasks = keyed
    open_tasks = open_tasks.select("task", *TASK_COLUMNS).dropDuplicates(["task"])
    part = F.pmod(F.xxhash64("task"), F.lit(batches)).alias("part")
    plan = fresh_dir(spark, "judge-plan")
    open_tasks.select("*", part).write.partitionBy("part").parquet(plan)
    number = max(log.done(), default=-1)
    for path in matching_paths(spark, f"{plan}/part=*"):
        number += 1
        asked = judge_stage(spark.read.schema(open_tasks.schema).parquet(path), judge, max_workers, in_flight=in_flight)
        verdicts = asked.select("task", *VERDICT_COLUMNS).withColumn("number", F.lit(number))
        log.commit(number, verdicts)
    known = log.read()
    if known is None:
        empty = open_tasks.schema["task"].dataType
        kinds = {"is_correct": "boolean"}
        known = keyed.limit(0).select(
            F.lit(None).cast(empty).alias("task"), *[F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in VERDICT_COLUMNS],
            F.lit(0).alias("number"),
        )
    latest = known.groupBy("task").agg(F.max_by(F.struct(*VERDICT_COLUMNS), "number").alias("verdict"))
    return keyed.select(*keys, "task").join(latest, "task", "left").select(*keys, "verdict.*")


def _stored_form(results: DataFrame) -> DataFrame:
    """Stored columns of a collected question, defaults filled in."""
    kept = [c for c in RESULT_COLUMNS if c in results.columns]
    return fill_defaults(results).select(*kept, "responses")


def _collect_batches(
    planned: DataFrame,
    log: BatchLog,
    generator: Generator,
    k: int,
    batches: list[int],
    max_workers: int,
    on_all_failed: str,
    in_flight: int | None,
) -> DataFrame | None:
    """Generate and commit one batch after the other; finished batches are not repeated. None without any."""
    done = set(log.done())
    for number in batches:
        if number in done:
            continue
        part = with_prompts(planned.filter(F.col("batch") == number).drop("batch"))
        fresh = generate_nested(part, generator, k, max_workers, in_flight)
        stored = log.commit(number, _stored_form(fresh))
        if on_all_failed == "stop" and all_failed(stored):
            break
    return log.read()


def _nothing_collected(plan: DataFrame, generator: Generator, k: int) -> DataFrame:
    """An empty result table, in the form that a run over ``plan`` would store."""
    return _stored_form(generate_nested(with_prompts(plan.limit(0)), generator, k))


def collect_job(
    dataset: DataFrame,
    store_path: str,
    generator: Generator,
    k: int = 1,
    retry_failed: bool = False,
    batch_size: int = 1_000_000,
    order_col: str = "idx",
    max_workers: int = 30,
    on_all_failed: str = "stop",
    run_path: str | None = None,
    plan: DataFrame | None = None,
    in_flight: int | None = None,
) -> DataFrame:
    """Collect ``k`` responses per open question and upsert them into the result store.

    The plan of a run is written once, partitioned by batch, so a batch reads only its own rows;
    each batch is generated, committed and never redone, and the store is changed once per run
    rather than once per batch, in the buckets of the collected ids alone. A run that was interrupted
    continues when called again with the same ``run_path``. It always merges into the responses of the
    version it started from, so calling it again, or after a partial merge, changes nothing that is
    already merged. With nothing to collect the store stays as it is; the result is empty if there is none.
    At most ``in_flight`` calls run at a time over all tasks, if it is given.
    """
    spark: SparkSession = dataset.sparkSession
    store = ResultStore(spark, store_path)
    run_path = run_path or f"{store_path.rstrip('/')}/run-{(store.version() or 0) + 1}"
    started = VersionedTable(spark, f"{run_path}/base")
    if started.read() is None:
        started.replace(spark.createDataFrame([(store.version(),)], "version long").coalesce(1))
    base = started.read().first().version
    existing = None if base is None else store.read(base)
    if plan is None:
        empty = spark.createDataFrame([], "unique_id string, status string, failed_slots array<int>")
        status = resume.response_status(existing) if existing is not None else empty
        plan = resume.resume_plan(resume.with_default_id(dataset, order_col), status, retry_failed, k)
    plan_table = VersionedTable(spark, f"{run_path}/plan")
    if plan_table.version() is None:
        numbered = dense_index(plan, order_col, name="_row")
        batched = numbered.withColumn("batch", batch_index(F.col("_row"), batch_size)).drop("_row")
        plan_table.replace(batched, partition_by="batch")
    batches = sorted(int(path.rsplit("=", 1)[1]) for path in matching_paths(spark, f"{plan_table.path()}/batch=*"))
    log, merges = BatchLog(spark, run_path), VersionedTable(spark, f"{run_path}/merged")
    collected = None
    if batches:
        collected = _collect_batches(plan_table.read(), log, generator, k, batches, max_workers, on_all_failed, in_flight)
    finished = len(log.done())
    if collected is None or merges.version() == finished:
        current = store.read()
        return _nothing_collected(plan, generator, k) if current is None else current
    ids = collected.select("unique_id")
    if existing is not None:
        collected = resume.retry_merge(store.read(base, store.touched(ids, base)), collected, k)
    result = store.upsert(collected, ids)
    spark.range(1).write.mode("overwrite").parquet(f"{run_path}/merged/v={finished}")
    return result


def cascade_job(
    weak_graded: DataFrame,
    store_path: str,
    generator: Generator,
    failed_path: str,
    failure_threshold: float = 0.5,
    k: int = 1,
    retry_failed: bool = False,
    order_col: str = "idx",
    **options,
) -> DataFrame:
    """Give the strong model only what the weak model failed on; the selection is stored too."""
    spark = weak_graded.sparkSession
    resume.weak_failures(weak_graded, failure_threshold, k).write.mode("overwrite").parquet(failed_path)
    failed = spark.read.parquet(failed_path)
    existing = ResultStore(spark, store_path).read()
    plan = failed
    if existing is not None:
        status = resume.response_status_selective(existing, k)
        plan = resume.selective_resume(failed, status, retry_failed)
    return collect_job(
        failed, store_path, generator, k, retry_failed, order_col=order_col, plan=plan, **options
    )


def publish_job(splits: Mapping[str, DataFrame], out: str) -> DataFrame:
    """Write all present splits in the shared wide schema, one folder per split.

    ``splits`` is a mapping of frames, such as ``read_split_folder`` gives.
    """
    wide = publish_splits(splits)
    wide.write.mode("errorifexists").partitionBy("split").parquet(out)
    return wide.sparkSession.read.parquet(out)


def publish_folder_job(spark: SparkSession, path: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Publish the graded split files of a folder: the stored wide table, and the lines that were rejected.

    Files are parsed once, into ``<out>/parsed``; the table stands in ``<out>/wide``.
    """
    splits, rejects = store_split_folder(spark, path, GRADED_RESULT, f"{out}/parsed")
    return publish_job(splits, f"{out}/wide"), rejects


def evaluate_job(predictions: DataFrame, inference: DataFrame | None = None, key: str = "unique_id") -> dict[str, DataFrame]:
    """All router reports for scored prompts.

    Labels decide the kind of report by the schema. Without them, measured results of both modes
    are compared if given.
    """
    labelled = "label" in predictions.columns
    sweep = evaluation.threshold_sweep(predictions, labelled)
    reports = {
        "threshold_sweep": sweep,
        "score_summary": evaluation.score_summary(predictions),
        "classify_half": evaluation.classify_half(predictions),
    }
    if labelled:
        reports["best_threshold"] = evaluation.best_threshold(sweep)
        reports["label_accuracy"] = evaluation.label_accuracy(predictions)
        reports["label_distribution"] = evaluation.label_distribution(predictions)
        reports["pick_distribution"] = evaluation.pick_distribution(predictions)
        if {"think_score", "no_think_score"} <= set(predictions.columns):
            reports["label_strategy_reward"] = evaluation.label_strategy_reward(predictions)
        if "diff_score" in predictions.columns:
            reports["diff_stats"] = evaluation.diff_stats(predictions)
    elif inference is not None:
        joined = evaluation.router_vs_inference(inference, predictions, key)
        reports["pick_value_counts"] = evaluation.pick_value_counts(joined)
        if {"think_accuracy", "no_think_accuracy"} <= set(joined.columns):
            reports["strategy_accuracy"] = evaluation.strategy_accuracy(joined)
        elif {"think_score", "no_think_score"} <= set(joined.columns):
            reports["strategy_reward"] = evaluation.strategy_reward(joined)
    return reports
