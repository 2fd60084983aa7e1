"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Hot names, formulations and sections are split at run time once a shuffle partition is both
    # larger than the threshold and several times the median.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "assayer-scratch")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


_SCRATCH = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stages that this thread writes inside are removed at the end, so only results that are written elsewhere may leave it."""
    outer, _SCRATCH.folders = getattr(_SCRATCH, "folders", None), []
    try:
        yield
    finally:
        configuration = spark._jsc.hadoopConfiguration()
        for folder in _SCRATCH.folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(configuration).delete(path, True)
        _SCRATCH.folders = outer


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    Stages used several times (snapshot views, distinct requests) are cut here: later plans stay
    small, a lost executor never recomputes them, and the reader knows their real size, which is
    what decides whether a join may broadcast them.
    """
    return _written(df, purpose)


#: Shuffle files of a finished execution go at once, and not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """``materialize`` for chains of stages over all rows: small files, and what a stage shuffled is gone once it is written."""
    with tidy(df.sparkSession):
        return _written(df, purpose, compression="zstd")


def _written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    path = shared_folder(df.sparkSession, purpose)
    if getattr(_SCRATCH, "folders", None) is not None:
        _SCRATCH.folders.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
