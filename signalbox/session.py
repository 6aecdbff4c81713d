"""Session defaults and the shared working folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}


def local_session(cores: str = "8", name: str = "signalbox", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a fresh local folder made and
    used for the life of the application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="signalbox-")
    return _LOCAL_FALLBACK[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def ship_package() -> None:
    """Send this package's functions to the Python workers by value.

    For a session whose workers cannot import the package. A cluster that got it through
    ``--py-files`` or a wheel does not need this.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])
