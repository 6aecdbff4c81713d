"""JSON lines in and out, always with an explicit schema."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.functions.text import is_blank
from signalbox.sources.store import matching_paths, rename

# Split names and the file stems that hold them.
SPLIT_STEMS = {"train": ("train",), "validation": ("val", "validation"), "test": ("test",)}

_log = logging.getLogger(__name__)


def read_strict(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """One object per line; blank lines are skipped, a malformed line stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _parsed(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """``file, row`` of every line with text; a line that does not parse stands in ``row._rejected``.

    Lines are parsed from text, since the JSON reader does not allow a query that looks at
    rejected lines alone.
    """
    with_reject = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_rejected"}
    return (
        spark.read.text(path)
        .filter(~is_blank(F.col("value")))
        .select(F.col("_metadata.file_path").alias("file"), F.from_json("value", with_reject, options).alias("row"))
    )


def _good(parsed: DataFrame, *keep: str) -> DataFrame:
    return parsed.filter(F.col("row._rejected").isNull()).select(*keep, "row.*").drop("_rejected")


def _bad(parsed: DataFrame, *keep: str) -> DataFrame:
    return parsed.filter(F.col("row._rejected").isNotNull()).select("file", F.col("row._rejected").alias("line"), *keep)


def read_tolerant(spark: SparkSession, path: str | list[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rejected lines as ``(file, line)``.

    Both are lazy, so using both parses the files twice; :func:`store_tolerant` parses them once.
    """
    parsed = _parsed(spark, path, schema)
    return _good(parsed), _bad(parsed)


def _store_parsed(parsed: DataFrame, out: str, *by: str) -> DataFrame:
    """Write parsed lines once, apart by what was accepted, and read them with their schema."""
    marked = parsed.withColumn("accepted", F.col("row._rejected").isNull())
    marked.write.mode("errorifexists").partitionBy("accepted", *by).parquet(out)
    return parsed.sparkSession.read.schema(marked.schema).parquet(out)


def store_tolerant(
    spark: SparkSession, path: str | list[str], schema: T.StructType, out: str
) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines, as :func:`read_tolerant` gives them, from one parse stored at ``out``.

    Either side is read from its own part of the store, and counting it reads no text.
    """
    stored = _store_parsed(_parsed(spark, path, schema), out)
    return _good(stored.filter("accepted")), _bad(stored.filter("not accepted"))


def fill_defaults(results: DataFrame) -> DataFrame:
    """Values of missing keys: not multiple choice, empty texts, no responses."""
    filled = results
    for name in ("explanation_correct", "answer_correct", "category"):
        if name in results.columns:
            filled = filled.withColumn(name, F.coalesce(name, F.lit("")))
    if "is_mcq" in results.columns:
        filled = filled.withColumn("is_mcq", F.coalesce("is_mcq", F.lit(False)))
    if "responses" in results.columns:
        none = F.array().cast(results.schema["responses"].dataType)
        filled = filled.withColumn("responses", F.coalesce("responses", none))
    return filled


def _split_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    return {
        name: [f for stem in stems for form in (stem, f"*_{stem}") for f in matching_paths(spark, f"{path}/{form}.jsonl")]
        for name, stems in SPLIT_STEMS.items()
    }


def read_split_folder(spark: SparkSession, path: str, schema: T.StructType) -> dict[str, DataFrame]:
    """Splits of a folder by file stem; a missing one is logged, none at all is an error.

    Accepts ``train.jsonl`` as well as ``<anything>_train.jsonl``, and ``val`` for validation.
    Bad lines are left out; :func:`split_folder_rejects` has them.
    """
    splits = {}
    for name, files in _split_files(spark, path).items():
        if files:
            splits[name] = fill_defaults(read_tolerant(spark, files, schema)[0])
        else:
            _log.warning("no %s data in %s", name, path)
    if not splits:
        raise ValueError(f"no split files in {path}")
    return splits


def split_folder_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Lines that :func:`read_split_folder` leaves out, with their ``split``; None without any file."""
    rejects = [
        read_tolerant(spark, files, schema)[1].withColumn("split", F.lit(name))
        for name, files in _split_files(spark, path).items() if files
    ]
    return reduce(DataFrame.unionByName, rejects) if rejects else None


def _split_of(file: Column) -> Column:
    """Split of a file by its stem, also where the file is a folder of parts."""
    stems = "|".join(stem for stems in SPLIT_STEMS.values() for stem in stems)
    stem = F.regexp_extract(file, rf"(?:/|_)({stems})\.jsonl(?:/[^/]*)?$", 1)
    return F.coalesce(*[F.when(stem.isin(*names), F.lit(split)) for split, names in SPLIT_STEMS.items()])


def store_split_folder(
    spark: SparkSession, path: str, schema: T.StructType, out: str
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Splits as :func:`read_split_folder` gives them and rejected lines with their ``split``.

    All files are parsed by one job and stored at ``out``, apart by split and by what was accepted.
    """
    files = _split_files(spark, path)
    present = [name for name, found in files.items() if found]
    for name in files.keys() - set(present):
        _log.warning("no %s data in %s", name, path)
    if not present:
        raise ValueError(f"no split files in {path}")
    parsed = _parsed(spark, [f for name in present for f in files[name]], schema)
    stored = _store_parsed(parsed.withColumn("split", _split_of(F.col("file"))), out, "split")
    good = stored.filter("accepted")
    splits = {name: fill_defaults(_good(good.filter(F.col("split") == name))) for name in present}
    return splits, _bad(stored.filter("not accepted"), "split")


def model_of_file(file_name: Column) -> Column:
    """Model name of a result file: the text before its first underscore."""
    return F.split_part(file_name, F.lit("_"), F.lit(1))


def read_results_directory(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every ``*.jsonl`` of a folder with ``model`` and ``file`` from its name.

    A ``.jsonl`` may be a file or a folder of parts, as Spark writes it. Files sharing a model prefix
    are all kept; :func:`model_collisions` names them. A folder without any is an error.
    """
    found = matching_paths(spark, f"{path}/*.jsonl")
    if not found:
        raise ValueError(f"no result files in {path}")
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(found)
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    file = F.regexp_extract(plain, r"([^/]+\.jsonl)(?:/[^/]*)?$", 1)
    return rows.select("*", model_of_file(file).alias("model"), file.alias("file"))


def write_results_directory(df: DataFrame, path: str, suffix: str = "results") -> None:
    """Result files of several models: ``<model>_<suffix>.jsonl`` by the ``model`` column.

    All models are written by one job to a side folder; each part then takes its name in one step, so a
    reader never sees half a file. The models must be free of underscores, which end the name.
    """
    parts = f"{path}/_{suffix}-parts"
    _ordered(df).write.mode("overwrite").partitionBy("model").option("ignoreNullFields", "false").json(parts)
    for part in matching_paths(df.sparkSession, f"{parts}/model=*"):
        rename(df.sparkSession, part, f"{path}/{part.rsplit('=', 1)[1]}_{suffix}.jsonl")


def model_collisions(results: DataFrame) -> DataFrame:
    """Models fed by more than one file."""
    files = results.groupBy("model", "file").agg(F.count(F.lit(1)).alias("rows"))
    return files.groupBy("model").agg(F.count(F.lit(1)).alias("files")).filter(F.col("files") > 1)


def _ordered(df: DataFrame) -> DataFrame:
    if "unique_id" not in df.columns:
        return df
    return df.select("unique_id", *[c for c in df.columns if c != "unique_id"])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, ``unique_id`` first, nulls written, non-ASCII kept."""
    _ordered(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, mode="append")


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split; a later read of one split touches only its folder."""
    _ordered(df).write.mode(mode).partitionBy("split").option("ignoreNullFields", "false").json(path)


def write_threshold_report(sweep: DataFrame, path: str, best: DataFrame | None = None) -> None:
    """All threshold rows, and the best one if given, as a single JSON object.

    The sweep has one row per threshold, a fixed number.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*sweep.columns)))
    report = sweep.agg(ordered.alias("threshold_results"))
    if best is not None:
        row = best.first()
        report = report.withColumn("best_threshold", F.lit(row.best_threshold)).withColumn(
            "best_accuracy", F.lit(row.best_accuracy)
        )
    report.write.option("ignoreNullFields", "false").json(path)
