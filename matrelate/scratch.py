"""Shared storage for intermediate results of iterative computations."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set; else a temporary folder made once a session (local use and tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("matrelate.scratch", None)
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="matrelate-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = "file://" + folder
        spark.conf.set("matrelate.scratch", place)
    return place.rstrip("/")


#: Folders of the computations that are under way, innermost last.
_open: list[str] = []


def path(spark: SparkSession, name: str) -> str:
    return f"{_open[-1] if _open else root(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def folder(spark: SparkSession):
    """Steps settled inside go to a folder of their own, which is deleted at the end."""
    target = f"{root(spark)}/run-{uuid.uuid4().hex}"
    _open.append(target)
    try:
        yield
    finally:
        _open.remove(target)
        delete(spark, target)


def settle(df: DataFrame, name: str = "step", keep: bool = False) -> DataFrame:
    """Write and read back: cuts the lineage of a loop, and survives lost executors.

    ``keep`` writes outside the folder of the computation under way.
    """
    target = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}" if keep else path(df.sparkSession, name)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def delete(spark: SparkSession, target: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
