"""New folders for what is written only to be read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that the executors share; a temporary one only for a local session that names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="prismloom-")
    return f"{shared.rstrip('/')}/files-{uuid.uuid4().hex}"


@contextmanager
def _planned(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Settings (with __ for dots) that hold only for what is planned and run meanwhile."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, within: bool = False) -> DataFrame:
    """df as a table in a new shared folder: what several parts of a plan read is computed once, and a lost executor costs no more.

    The files of its shuffles are gone when it is written. Within: what was dealt by a key is joined and grouped by
    more keys where it is, so nothing is shuffled again; for keys as even as images.
    """
    path = scratch(df.sparkSession)
    with _planned(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **({"spark__sql__requireAllClusterKeysForCoPartition": "false"} if within else {})):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
