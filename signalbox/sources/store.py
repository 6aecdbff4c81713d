"""Result tables with atomic replacement: numbered versions, the newest finished one is current.

Parquet is written under a new number and finished by Spark's own ``_SUCCESS`` mark. A
failed or killed write leaves an unfinished folder that readers skip, and no path is ever
overwritten while it is read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbox.operators.resume import untouched
from signalbox.session import fresh_dir


_BUCKET = "id_bucket"
_STATE = "schema string, buckets int, places array<struct<bucket:int,version:int>>"


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths of a glob on whatever file system it names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(found.getPath().toString() for found in (fs.globStatus(path) or []))


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Give a file or folder another name on its file system; an existing target is an error."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    fs = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(paths[1]) or not fs.rename(*paths):
        raise FileExistsError(f"cannot rename {source} to {target}")


def _finished(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the finished ``<prefix>=<number>`` folders below ``root``."""
    marks = matching_paths(spark, f"{root}/{prefix}=*/_SUCCESS")
    return sorted(int(mark.split("/")[-2].split("=")[1]) for mark in marks)


class VersionedTable:
    """Table at ``root`` that is written whole each time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int | None:
        return max(_finished(self.spark, self.root, "v"), default=None)

    def path(self, version: int | None = None) -> str:
        return f"{self.root}/v={self.version() if version is None else version}"

    def read(self) -> DataFrame | None:
        """Rows of the current version, or None while nothing is stored."""
        return None if self.version() is None else self.spark.read.parquet(self.path())

    def replace(self, df: DataFrame, partition_by: str | None = None) -> None:
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path((self.version() or 0) + 1))


class ResultStore:
    """Versioned results at ``root``, in buckets of the hashed id.

    Rows stand below ``data/v=<number>/id_bucket=<bucket>``. A version is a small table ``v=<number>``,
    written last, that names for every bucket the version whose folder holds it, so a change writes only
    the buckets it touches and a reader sees a version whole or not at all. The number of buckets is
    fixed by the first version. Rows without an id share a bucket.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def version(self) -> int | None:
        return max(_finished(self.spark, self.root, "v"), default=None)

    def _state(self, version: int) -> Row:
        return self.spark.read.schema(_STATE).parquet(f"{self.root}/v={version}").first()

    def _bucket(self, state: Row | None) -> Column:
        return F.pmod(F.xxhash64("unique_id"), F.lit(state.buckets if state else self._buckets)).cast("int")

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of the current or a given version, of all or some buckets, or None while nothing is stored."""
        current = self.version() if version is None else version
        if current is None:
            return None
        state = self._state(current)
        schema = T.StructType.fromJson(json.loads(state.schema))
        paths = [f"{self.root}/data/v={v}/{_BUCKET}={b}" for b, v in state.places if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, ids: DataFrame, version: int) -> set[int]:
        """Buckets of some ids; the driver sees at most as many numbers as there are buckets."""
        return {row[0] for row in ids.select(self._bucket(self._state(version))).distinct().collect()}

    def _write(self, df: DataFrame, number: int, state: Row | None, kept: dict[int, int]) -> DataFrame:
        """Write the buckets of ``df`` as version ``number``, and its state with the ``kept`` places."""
        path = f"{self.root}/data/v={number}"
        bucketed = df.withColumn(_BUCKET, self._bucket(state)).hint("rebalance", _BUCKET)
        bucketed.write.mode("overwrite").option("compression", "zstd").partitionBy(_BUCKET).parquet(path)
        made = {int(found.rsplit("=", 1)[1]): number for found in matching_paths(self.spark, f"{path}/{_BUCKET}=*")}
        buckets = state.buckets if state else self._buckets
        row = (df.schema.json(), buckets, sorted((kept | made).items()))
        self.spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/v={number}")
        return self.read(number)

    def replace(self, df: DataFrame) -> DataFrame:
        """Make ``df`` the whole content, as a new version."""
        current = self.version()
        return self._write(df, (current or 0) + 1, None if current is None else self._state(current), {})

    def upsert(self, fresh: DataFrame, ids: DataFrame | None = None) -> DataFrame:
        """Keep stored rows whose id is not in ``fresh`` and add ``fresh``, as a new version.

        Only buckets of the fresh ids are read and written. Fresh rows are written first, so they are
        worked out once; not if ``ids`` is given, a stored table whose ``unique_id`` are those of ``fresh``.
        """
        current = self.version()
        if current is None:
            return self.replace(fresh)
        state = self._state(current)
        if ids is None:
            ids = fresh = materialize(fresh, "fresh")
        touched = self.touched(ids, current)
        kept = {b: v for b, v in state.places if b not in touched}
        return self._write(untouched(self.read(current, touched), ids).unionByName(fresh), current + 1, state, kept)


class BatchLog:
    """Batches committed one by one under ``batch=<number>``; a restart skips finished ones."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def done(self) -> list[int]:
        return _finished(self.spark, self.root, "batch")

    def commit(self, number: int, df: DataFrame) -> DataFrame:
        path = f"{self.root}/batch={number}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path)

    def read(self) -> DataFrame | None:
        done = self.done()
        if not done:
            return None
        return self.spark.read.parquet(*[f"{self.root}/batch={n}" for n in done])


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_result_layout(df: DataFrame, root: str) -> None:
    """``results/dataset/router`` layout from full ``dataset`` and ``router`` names."""
    from signalbox.functions.text import name_tail

    tails = df.withColumn("dataset", name_tail(F.col("dataset"))).withColumn(
        "router", name_tail(F.col("router"))
    )
    tails.write.partitionBy("dataset", "router").json(root)
