"""Tables of a running job in a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.conf.set("spark.checkpoint.dir", found)
    folder = f"{found.rstrip('/')}/orrery-{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        _KNOWN.add(folder)
        atexit.register(_leave, spark, folder)
    return folder


_KNOWN: set[str] = set()


def _leave(spark: SparkSession, folder: str) -> None:
    """What queries have put into the scratch folder goes with the application; within one, `clearing` tells what is done with."""
    with suppress(Exception):  # the session may be gone
        delete(spark, folder)


_NOTED: list[list[str]] = []


def new_folder(spark: SparkSession, name: str = "t") -> str:
    """A folder that nothing else uses."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for noted in _NOTED:
        noted.append(path)
    return path


def delete(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what was put into the scratch folder within; only for results that have been written by then."""
    _NOTED.append([])
    try:
        yield
    finally:
        delete(spark, *_NOTED.pop())


def save(frame: DataFrame) -> DataFrame:
    """Cut the lineage: write a table into the shared scratch folder and read it back.

    A lost executor then costs at most the stage that is running.
    """
    path = new_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
