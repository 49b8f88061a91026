"""The folder that driver and executors share, and tables written there to cut a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local master gets a folder of its own; a cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        place = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and return a reader of it.

    The plan above starts at files that all executors reach, so a lost executor costs no recomputation of what stands
    below, and (unlike checkpoint()) the rows are computed once.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, whatever file system it is on; nothing happens if it isn't there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that cut() writes within, at the end: what is built on them must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)
