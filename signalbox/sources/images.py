"""Images as data URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbox.functions.text import is_url, mime_type


def data_url(path: Column, content: Column) -> Column:
    encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), mime_type(path), F.lit(";base64,"), encoded)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, image_url)`` for every file below ``path``."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", data_url(F.col("path"), F.col("content")).alias("image_url"))


def resolve_images(references: DataFrame, images: DataFrame, column: str = "image") -> DataFrame:
    """Add ``image_url``: web addresses stay as they are, paths take their data URL."""
    joined = references.join(images.withColumnRenamed("path", column), column, "left")
    return joined.withColumn("image_url", F.when(is_url(F.col(column)) & F.col("image_url").isNull(), F.col(column)).otherwise(F.col("image_url")))
