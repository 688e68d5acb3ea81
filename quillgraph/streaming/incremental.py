"""Streaming uses of the same operators: edges that arrive, windows over events.

The batch engine rebuilds; these keep a graph current from a stream of edge rows and count
transitions in event-time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.session import shared_path


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """window start, event_type, n, value sum, in event time; later rows than late are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def observed_edges(edges: DataFrame, late: str = "10 minutes") -> DataFrame:
    """src, dst, first and last sight and number of sights, by hour, as traces arrive."""
    w = edges.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "src", "dst")
    return w.agg(F.count("*").alias("observedCount"), F.min("ts").alias("firstObserved"), F.max("ts").alias("lastObserved")).drop("window")


def replace_by_source(changes: DataFrame, path: str, key: str = "sourceFile") -> StreamingQuery:
    """Keeps the edges at path current: a batch replaces all edges of the files it names.

    A batch writes a new version folder and then a pointer to it; a batch that is run again
    after a failure writes the same version, so results are exactly once.
    """
    spark = changes.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        old = current(spark, path)
        rows = batch
        if old is not None:
            rows = old.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch, allowMissingColumns=True)
        rows.write.mode("overwrite").parquet(f"{path}/versions/{n:010d}")
        spark.range(1).select(F.lit(n).alias("version")).coalesce(1).write.mode("overwrite").json(f"{path}/pointers/{n:010d}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame | None:
    """The latest version that replace_by_source has finished; None before the first."""
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{path}/pointers")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(base) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{path}/versions/{max(done)}") if done else None
