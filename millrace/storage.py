"""Folders for intermediate tables that the driver and all executors share.

All of an application's folders lie in one, which goes when the application's process ends, when clear() is called, or (those made
inside it) with temporary().
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: The folder of each application with what is needed to remove it, and the folders made in this process.
_ROOTS: dict[str, tuple[str, object]] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a local session takes a new temporary folder; a cluster has to name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return path.rstrip("/")


def _remove(path: str, configuration) -> None:
    from pyspark import SparkContext

    at = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(configuration).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the application's folder."""
    key = spark.sparkContext.applicationId
    if key not in _ROOTS:
        _ROOTS[key] = (f"{shared_dir(spark)}/scratch-{key}-{uuid.uuid4().hex}", spark._jsc.hadoopConfiguration())
    _MADE.append(f"{_ROOTS[key][0]}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Remove all folders of the application; nothing made of them may be read later."""
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        _remove(*root)


@atexit.register
def _clear_all() -> None:
    for root in _ROOTS.values():
        # the JVM may have ended before
        with suppress(Exception):
            _remove(*root)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove what is written to scratch folders inside; nothing made of it may be read later."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            _remove(path, spark._jsc.hadoopConfiguration())
        del _MADE[before:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, lost executors lose nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
