"""Size-tiered compaction of a shard store (operator 6, native).

A store is a folder of immutable Parquet shards and versioned manifests. Arrivals are
appended as small shards, written by the tasks that read them, without a shuffle. A tier
holds shards of like size (within a factor of ``FAN_IN``); once it has FAN_IN of them they
are merged into target-sized files: the shards are coalesced to as many tasks as the tier
has target sizes, and each task writes one file, again without a shuffle.

*Manifests* are Parquet tables, written and read by Spark, so their rows do not pass the
driver; a merge takes ``MERGE_SHARDS`` paths at a time to the driver, and rounds go on until
no tier is full. *A commit* makes the version's file, which names the manifest, appear at
once and only if no other writer's is there: by a hard link on a local file system, else by a
rename that does not overwrite, which HDFS does in one step; a writer that was overtaken
fails. (Object stores without such a rename need a committer of their own.) *Vacuum* deletes
versions that were superseded longer ago than readers need, and shards that no kept version
names.

Defined results: rows are stored as they come, nulls and repeats included, whatever their
columns; an empty table has a manifest without shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh, scratch_path, table

ARRIVAL_ROWS = 2_048
TARGET_BYTES = 32 << 20
BASE_BYTES = 1 << 19
FAN_IN = 4
#: Seconds for which a superseded version can still be read.
RETAIN = 24 * 3600.0
#: Shards that are merged at a time at most; the next round goes on with the rest.
MERGE_SHARDS = 20_000
#: How often an append or a round of merging starts anew because another writer was faster.
TRIES = 10
MANIFEST = "shard string, path string, tier int, n_rows long, n_bytes long"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A shard store at a path that driver and executors can reach."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.target, self.base, self.fan_in = spark, path.rstrip("/"), target_bytes, base_bytes, fan_in

    # -- files and manifests

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> dict[int, float]:
        """Committed versions and when each was, in order."""
        fs, p = self._fs(f"{self.path}/_versions")
        if not fs.exists(p):
            return {}
        found = ((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p))
        return dict(sorted((int(name[1:]), at) for name, at in found if name[0] == "v"))

    def versions(self) -> list[int]:
        return list(self._versions())

    def _named(self, version: int) -> str:
        """The manifest's path that a version's file names."""
        fs, p = self._fs(f"{self.path}/_versions/v{version:010d}")
        with_name = fs.open(p)
        try:
            return f"{self.path}/_manifests/{json.loads(bytes(with_name.readAllBytes()).decode())['manifest']}"
        finally:
            with_name.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """shard, path, tier, n_rows, n_bytes of the latest or a given version."""
        return self.spark.read.schema(MANIFEST).parquet(self._named(self.versions()[-1] if version is None else version))

    def _listed(self, folder: str) -> DataFrame:
        """Manifest rows of a folder's files that hold rows."""
        m = F.col("_metadata")
        files = self.spark.read.parquet(folder).groupBy(m["file_name"].alias("shard"), m["file_path"].alias("path"), m["file_size"].alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(float(self.fan_in), F.col("n_bytes") / self.base) - 1e-9))
        return files.select(F.regexp_replace("shard", r"\.parquet$", "").alias("shard"), "path", tier.cast("int").alias("tier"), "n_rows", "n_bytes")

    def _commit(self, rows: DataFrame, after: int) -> int:
        """Write the manifest of version after + 1, then make the version appear if it is not there."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/_manifests/{name}")
        fs, src = self._fs(f"{self.path}/_versions/.staged-{name}")
        out = fs.create(src, False)
        try:
            out.write(bytearray(json.dumps({"manifest": name}), "utf-8"))
        finally:
            out.close()
        _, dst = self._fs(f"{self.path}/_versions/v{after + 1:010d}")
        try:
            self._appear(fs, src, dst)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            manifests, p = self._fs(f"{self.path}/_manifests/{name}")
            manifests.delete(p, True)
            raise Conflict(f"version {after + 1} was committed by another writer") from e
        finally:
            fs.delete(src, False)
        return after + 1

    def _appear(self, fs, src, dst) -> None:
        """Give src the name dst, in one step and only if nothing has it."""
        jvm = self.spark._jvm
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(dst), local(src))
            return
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark._jsc.hadoopConfiguration()).rename(src, dst, none)

    def vacuum(self, retain: float = RETAIN) -> None:
        """Delete versions superseded over retain seconds ago, and shards that no version left names."""
        versions = self._versions()
        numbers, now = list(versions), time.time()
        old = [v for v, later in zip(numbers, numbers[1:]) if now - versions[later] >= retain]
        if not old:
            return
        paths = lambda vs: self.spark.read.schema(MANIFEST).parquet(*map(self._named, vs)).select("path").distinct()
        gone = paths(old).join(paths(numbers[len(old) :]), "path", "left_anti")
        for r in gone.toLocalIterator():  # a partition at a time
            fs, p = self._fs(r["path"])
            fs.delete(p, False)
        for v in old:  # the version goes before its manifest, so none that is seen lacks one
            manifest = self._named(v)
            for path in (f"{self.path}/_versions/v{v:010d}", manifest):
                fs, p = self._fs(path)
                fs.delete(p, True)

    # -- operations

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Add arrivals as small shards; gives the new version. If another writer is faster, they are added to what it left."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
        new = self._listed(folder)
        for left in reversed(range(TRIES)):
            versions = self.versions()
            try:
                return self._commit(self.manifest(versions[-1]).unionByName(new) if versions else new, versions[-1] if versions else 0)
            except Conflict:
                if not left:
                    self._drop(folder)
                    raise
        raise AssertionError("not reached")

    def _drop(self, folder: str) -> None:
        """Delete a folder that no version names."""
        fs, p = self._fs(folder)
        fs.delete(p, True)

    def compact(self, retain: float = RETAIN) -> int:
        """Merge tiers that are full until none is; gives the last version. What another writer overtakes is merged anew."""
        lost = 0
        while True:
            version = self.versions()[-1]
            every = self.manifest(version)
            small = every.where(F.col("n_bytes") < self.target // 2)
            full = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan_in).orderBy("tier").collect()  # a row a tier
            if not full:
                return version
            merged, new = [], []
            for tier in full:
                old = small.where(F.col("tier") == tier["tier"]).orderBy("path").limit(MERGE_SHARDS).select("path", "n_bytes").collect()  # bounded
                merged += [r["path"] for r in old]
                new.append(self._merge([r["path"] for r in old], sum(r["n_bytes"] for r in old)))
            gone = self.spark.createDataFrame([(p,) for p in merged], "path string")
            rows = every.join(gone, "path", "left_anti").select(*every.columns)
            for folder in new:
                rows = rows.unionByName(self._listed(folder))
            try:
                self._commit(rows, version)
            except Conflict:
                for folder in new:
                    self._drop(folder)
                lost += 1
                if lost == TRIES:
                    raise
                continue
            self.vacuum(retain)

    def _merge(self, paths: list[str], n_bytes: int) -> str:
        """Rewrite shards as fewer files of about the target size; gives their folder."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        files = max(1, math.ceil(n_bytes / self.target))
        self.spark.read.parquet(*paths).coalesce(files).write.option("compression", "zstd").parquet(folder)
        return folder

    def read(self, version: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows of a version with their shard's manifest row, as shard, tier, shard_rows, shard_bytes.

        Where the stored rows have such a column, the manifest's gets an underscore.
        """
        m = self.manifest(version)
        paths = [r["path"] for r in m.select("path").toLocalIterator()]  # Spark's reader takes its files as a list
        rows = self.spark.read.parquet(*paths) if paths else self.spark.range(0).select()
        if columns is not None:
            rows = rows.select("_metadata.file_name", *[c for c in columns if c in rows.columns]) if paths else rows
        own = [c for c in rows.columns if c != "file_name" or columns is None]
        shard, tier, n_rows, n_bytes = (fresh(own, c) for c in ("shard", "tier", "shard_rows", "shard_bytes"))
        if not paths:
            return rows.select(*[F.lit(None).cast(t).alias(c) for c, t in ((shard, "string"), (tier, "int"), (n_rows, "long"), (n_bytes, "long"))])
        name = F.col("file_name") if columns is not None else F.col("_metadata.file_name")
        rows = rows.select(*[f"`{c}`" for c in own], F.regexp_replace(name, r"\.parquet$", "").alias(shard))
        sizes = m.select(F.col("shard").alias(shard), F.col("tier").alias(tier), F.col("n_rows").alias(n_rows), F.col("n_bytes").alias(n_bytes))
        return rows.join(sizes, shard)  # Spark broadcasts the manifest while it is small


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores documents as arrivals, compacts them and gives each document's shard."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch_path(spark, "store"))
    store.append(docs)
    version = store.compact(retain=0)  # nothing else reads this store
    out = store.read(columns=["doc_id"])
    if "doc_id" not in out.columns:
        out = out.withColumn("doc_id", F.lit(None).cast("long"))
    return out.select("doc_id", "shard", "tier", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
