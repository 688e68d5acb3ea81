"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import shared_path, ship


#: The setting of how much text goes to Python at once, Spark's own value, and what this package asks for.
BATCH_SETTING, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, "4m"


def prepared(spark: SparkSession) -> None:
    """Ship the package, and keep batches to Python small unless the session says otherwise.

    Executors hold a batch or two for each core outside their heap, and Python holds them again.
    """
    ship(spark)
    if spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_SETTING, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store Spark knows will do."""
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    prepared(spark)
    return shared_path(spark, name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage, and the rows outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path in whatever store it is."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nothing refers to any more.

    Called once their results are written; files would else stay until the driver happens
    to collect its garbage.
    """
    gc.collect()
    spark._jvm.System.gc()


def plan_bytes(df: DataFrame) -> int:
    """What Catalyst takes the frame's size to be, in bytes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


#: Bytes up to which a table is sent to every executor.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, rows: int, width: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where rows of about width bytes stay under limit; else Spark shuffles."""
    return F.broadcast(df) if rows * width <= limit else df


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_remembered: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks; one thing at a time.

    Workers outlive tasks and stages, so a new operator's tables take the place of the last
    one's, and the freed memory goes back to the system.
    """
    if name not in _remembered:
        _remembered.clear()
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: it is only memory
            pass
        _remembered[name] = make()
    return _remembered[name]
