"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, and a mixture.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.llm import decontaminate, mixing, ngram_join, quality_rules, secret_scan
from signalbox.llm.queries import table
from signalbox.session import ship_package
from signalbox.sources.store import materialize

#: Shares of tokens of the mixture, by the toxic label. The quality label makes no domain here: the quality
#: rules reject the labelled documents of quality 0 (all 571 of sf0.1, 56 of 58 of sf0.01), so there is
#: no text left to learn such a domain from.
TARGETS = {"toxic0": 0.96, "toxic1": 0.04}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; labels of quality 1 name the trusted ones."""
    ship_package()
    return quality_rules.keep(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id stays of each group of near duplicates."""
    ship_package()
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship_package()
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are replaced in the text; every document stays, with its new length."""
    ship_package()
    changed = secret_scan.redact(docs.withColumn("_before", F.length("text")))
    length = F.when(F.length("text") != F.col("_before"), F.length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).drop("_before")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture draws, with ``n_tokens``, ``rate`` and the number of ``copies``."""
    ship_package()
    labels = table(spark, sf_dir, "labels").where("toxic is not null")
    return mixing.mixed(docs, labels.select("doc_id", F.concat(F.lit("toxic"), "toxic").alias("domain")), TARGETS)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing to target weights", mixture),
]

#: Classifier, joins of near duplicates and the fit are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
