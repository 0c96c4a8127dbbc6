"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read, from ``spark.checkpoint.dir``.

    Where that is unset (tests on a local master) a temporary folder is made; a real cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-corpusloom-")
    return "file://" + _LOCAL_DIRS[sc.applicationId]


#: Folders written inside each open ``scratch``, innermost last.
_OPEN: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was materialised inside; collect or write results before that."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            fs, where = _file_system(spark, path)
            fs.delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors.

    The folder goes when the ``scratch`` around it ends, and otherwise with the driver.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "corpusloom", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
