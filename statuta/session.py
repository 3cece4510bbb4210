"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": os.environ.get("STATUTA_SHUFFLE_PARTITIONS", "8"),
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.ui.enabled": "false",
    "spark.driver.memory": os.environ.get("STATUTA_DRIVER_MEMORY", "8g"),
}


def get_session(master: str | None = None, app: str = "statuta") -> SparkSession:
    """A session with the settings the plans are written for.

    A session that is there already is taken as it is, and what was submitted with the application wins;
    only what is unset is added.
    """
    if SparkSession.getActiveSession() is not None:
        return SparkSession.getActiveSession()
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    submitted = _submitted()
    for key, value in DEFAULTS.items():
        if not (submitted and submitted.contains(key)):
            builder = builder.config(key, value)
    return builder.getOrCreate()


def _submitted() -> SparkConf | None:
    """The settings of an application that was submitted, whose JVM is there before any session."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return None
    SparkContext._ensure_initialized()
    return SparkConf()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Plans that are started inside get no generated method that the JVM leaves uncompiled for its size.

    Such a stage runs with one projection split into many methods instead, several times as fast for very long
    expressions. The session's setting is put back."""
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame once to the shared folder and go on from the written table.

    Survives the loss of executors, evaluates the frame a single time, and later steps read only the
    columns they need.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; a local one only where none is set."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or _checkpoint_dir(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
