"""Frames stored in buckets of their keys, and changed by whole versions.

A version is one small file that names, for each frame, the folder of each of its buckets. An
upsert writes the buckets that new rows fall in, and a version in which those have taken the
place of the old ones; all others are named as before. The version appears in one step, and
only if no other writer has taken its number, so a reader sees all frames of one version, and a
writer that dies leaves the last version as it was.

What the driver holds is frames x buckets names, whatever the number of rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(f"{self.path}/_versions") if n.startswith("v") and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> dict[str, dict]:
        """Frame -> schema, key, buckets and folders (by bucket) of a version, the last one if none is said; empty before the first."""
        numbers = self.versions()
        if not numbers:
            return {}
        fs, p = self._fs(f"{self.path}/_versions/v{numbers[-1] if version is None else version:010d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        folders = [f"{self.path}/{f}" for f in entry["folders"].values()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _written(self, name: str, df: DataFrame, key: Sequence[str], buckets: int) -> dict[str, str]:
        """The folder of each bucket that df has rows in."""
        folder = f"_data/{name}/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int")
        # rebalanced by bucket: a large one is split over tasks, small ones share one
        df.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith("_bucket=")}

    def put(self, name: str, df: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> dict:
        """The entry of a frame that is written whole."""
        return {"schema": df.schema.jsonValue(), "key": list(key), "buckets": buckets, "folders": self._written(name, df, key, buckets)}

    def merged(self, name: str, entry: dict, df: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> dict:
        """The entry of a frame after combine(old rows, new rows), of the buckets that new rows fall in alone."""
        staged = self._written(name, df, entry["key"], entry["buckets"])
        old, new = entry | {"folders": {b: f for b, f in entry["folders"].items() if b in staged}}, {"schema": df.schema.jsonValue(), "folders": staged}
        both = combine(self.read(old), self.read(new))
        folders = entry["folders"] | self._written(name, both, entry["key"], entry["buckets"])
        for folder in {f.rpartition("/")[0] for f in staged.values()}:
            fs, p = self._fs(f"{self.path}/{folder}")
            fs.delete(p, True)
        return entry | {"schema": both.schema.jsonValue(), "folders": folders}

    def commit(self, frames: dict[str, dict], after: int) -> int:
        """Make version after + 1 appear, in one step; Conflict if it is there already."""
        fs, src = self._fs(f"{self.path}/_versions/.staged-{uuid.uuid4().hex}")
        out = fs.create(src, False)
        try:
            out.write(bytearray(json.dumps(frames), "utf-8"))
        finally:
            out.close()
        _, dst = self._fs(f"{self.path}/_versions/v{after + 1:010d}")
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":  # a rename there would replace a file; a link does not
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(dst), local(src))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise Conflict(f"version {after + 1} was committed by another writer") from e
        finally:
            fs.delete(src, False)
        return after + 1

    def vacuum(self, keep: int = 2, retain: float = 86_400.0) -> None:
        """Delete all versions but the last few, and folders that those do not name and that are older than retain seconds."""
        numbers = self.versions()
        for v in numbers[:-keep]:
            fs, p = self._fs(f"{self.path}/_versions/v{v:010d}")
            fs.delete(p, False)
        named = {f for v in numbers[-keep:] for entry in self.manifest(v).values() for f in entry["folders"].values()}
        whole = {f.rpartition("/")[0] for f in named}
        for frame in self._names(f"{self.path}/_data"):
            for run in self._names(f"{self.path}/_data/{frame}"):
                folder = f"_data/{frame}/{run}"
                fs, p = self._fs(f"{self.path}/{folder}")
                if fs.getFileStatus(p).getModificationTime() / 1000 > time.time() - retain:
                    continue
                if folder not in whole:
                    fs.delete(p, True)
                    continue
                for bucket in self._names(f"{self.path}/{folder}"):
                    if bucket.startswith("_bucket=") and f"{folder}/{bucket}" not in named:
                        _, b = self._fs(f"{self.path}/{folder}/{bucket}")
                        fs.delete(b, True)
