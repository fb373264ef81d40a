"""Tables written to cut lineage or to hand data from one job to the next.

They live under the folder the cluster names in ``spark.checkpoint.dir``, which
every executor can reach, so losing executors never loses them. Reading a
written table back also gives the planner its true size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def parent_folder(spark: SparkSession) -> str:
    """What all scratch folders of this application lie in."""
    base = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    return f"{base.rstrip('/')}/rosterlake-{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    folder = f"{parent_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has written there; results must be written before."""
    _delete(spark, parent_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """Remove on leaving what this block has written there; what it returns must be written elsewhere."""
    token = _made.set([])
    try:
        yield
    finally:
        for folder in _made.get() or []:
            _delete(spark, folder)
        _made.reset(token)


def write_and_read(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once, to a fresh folder if none is given, and go on from the written copy."""
    spark = df.sparkSession
    folder = folder or scratch_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
