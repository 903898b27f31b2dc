"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    """(file system, path) of whichever store a path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _store(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path; none where it isn't there."""
    store, at = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(at) if f.isDirectory()) if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    store, at = _store(spark, path)
    _, there = _store(spark, to)
    store.mkdirs(there.getParent())
    if not store.rename(at, there):
        raise OSError(f"{path} can't be moved to {to}")


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time of change and length of a file or folder."""
    store, at = _store(spark, path)
    status = store.getFileStatus(at)
    return status.getModificationTime(), status.getLen()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; on a single machine that may be unset, and a temporary folder takes its place."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="quillon-")
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"
