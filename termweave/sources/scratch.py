"""Scratch tables in the folder that driver and executors share: lineage ends at them, and they
survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir() -> str:
    """A folder of this process, for a Spark of one machine."""
    folder = tempfile.mkdtemp(prefix="termweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a Spark of one
    machine gets a folder of its own, and a cluster an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return _own_dir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there and
    survives lost executors. What ``unstage`` has not deleted goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/termweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(spark, path)
    if _scopes:
        _scopes[-1].append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


_scopes: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged inside are deleted at its end, where their results are written."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*frames: DataFrame | None) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        if df is not None and getattr(df, "staged_path", None):
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
