"""A graph as frames by label and edge type, with storage, statistics and queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.operators import merge, patterns
from quillgraph.sources.snapshots import BUCKETS, Conflict, Snapshots

#: How often a merge is done anew because another writer was faster.
TRIES = 5


class Graph:
    """Frames by name: labels as in model.LABELS, edges as in model.EDGES."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame] | None = None):
        self.spark, self.frames = spark, dict(frames or {})

    def nodes(self, label: str) -> DataFrame:
        return self.frames[label]

    def edges(self, *rels: str, source: str | None = None, target: str | None = None) -> DataFrame:
        """src_label, src, rel, dst_label, dst of all edges of the types between the labels."""
        parts = []
        for name, (rel, a, b) in model.EDGES.items():
            if name in self.frames and (not rels or rel in rels) and source in (None, a) and target in (None, b):
                parts.append(self.frames[name].select(F.lit(a).alias("src_label"), F.col("from_id").alias("src"), F.lit(rel).alias("rel"), F.lit(b).alias("dst_label"), F.col("to_id").alias("dst")))
        if not parts:
            return self.spark.createDataFrame([], "src_label string, src string, rel string, dst_label string, dst string")
        return reduce(DataFrame.unionByName, parts)

    def vertices(self, *labels: str) -> DataFrame:
        """label, id, name, path of nodes of any of the labels."""
        parts = []
        for label in labels or [x for x in model.LABELS if x in self.frames]:
            df, key = self.frames[label], model.LABELS[label]
            col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
            parts.append(df.select(F.lit(label).alias("label"), F.col(key).alias("id"), col("name").alias("name"), col("path").alias("path")))
        return reduce(DataFrame.unionByName, parts)

    def stats(self) -> DataFrame:
        """kind (node or edge), name, n; the roll-up rows have null names."""
        labels = [x for x in model.LABELS if x in self.frames and x != "Entity"]
        nodes = patterns.totals(self.vertices(*labels).select(F.col("label").alias("name")), "name").withColumn("kind", F.lit("node"))
        edges = patterns.totals(self.edges().select(F.col("rel").alias("name")), "name").withColumn("kind", F.lit("edge"))
        return nodes.unionByName(edges).select("kind", "name", "n")

    def constraint_violations(self) -> DataFrame:
        """label, key value and number of rows of every repeated key."""
        parts = [merge.duplicate_keys(self.frames[label], key).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), "n") for label, key in model.LABELS.items() if label in self.frames]
        return reduce(DataFrame.unionByName, parts)

    def broken_paths(self, files: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
        """valid and invalid counts of node paths against a file listing, over all or n random nodes."""
        with_path = self.vertices().where("path IS NOT NULL AND path <> ''")
        if n:
            with_path = patterns.sampled(with_path, n, seed)
        known = files.select("path", F.lit(True).alias("ok")).distinct()
        return with_path.join(known, "path", "left").agg(F.count_if(F.col("ok")).alias("valid"), F.count_if(F.col("ok").isNull()).alias("invalid"))

    def write(self, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> int:
        """Store the graph as a new version; gives its number.

        Appending merges nodes by key and edges by all columns, bucket by bucket: buckets that no
        new row falls in are not read. Readers see the version before until all frames are
        written. If another writer was faster, the merge is done again on what it left.
        """
        store = Snapshots(self.spark, path)
        for _ in range(TRIES):
            last = (store.versions() or [0])[-1]
            old = store.manifest(last) if last and mode == "append" else {}
            entries = dict(old)
            for name, df in self.frames.items():
                key = [model.LABELS[name]] if name in model.LABELS else ["from_id", "to_id"] if name in model.EDGES else df.columns[:1]
                if name not in old:
                    entries[name] = store.put(name, df, key, buckets)
                elif name in model.LABELS:
                    entries[name] = store.merged(name, old[name], df, lambda before, new, key=key: before.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True))
                else:
                    entries[name] = store.merged(name, old[name], df, lambda before, new: before.unionByName(new, allowMissingColumns=True).distinct())
            try:
                return store.commit(entries, last)
            except Conflict:
                if mode != "append":
                    raise
        raise Conflict(f"{TRIES} other writers were faster")

    @classmethod
    def clear(cls, spark: SparkSession, path: str) -> int:
        """An empty version; those before stay until vacuum()."""
        store = Snapshots(spark, path)
        return store.commit({}, (store.versions() or [0])[-1])

    @classmethod
    def vacuum(cls, spark: SparkSession, path: str, keep: int = 2, retain: float = 86_400.0) -> None:
        """Delete all but the last versions of a stored graph, with the buckets that only they have."""
        Snapshots(spark, path).vacuum(keep, retain)

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: int | None = None) -> Graph:
        store = Snapshots(spark, path)
        return cls(spark, {n: store.read(entry) for n, entry in store.manifest(version).items()})

    def views(self) -> None:
        """Temporary views of all frames, and vertices and edges, for SQL."""
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)
        self.edges().createOrReplaceTempView("edges")
        self.vertices().createOrReplaceTempView("vertices")

    def schema(self) -> dict[str, str]:
        return {n: df.schema.simpleString() for n, df in self.frames.items()}

    def query(self, question: str, /, **params) -> DataFrame:
        from quillgraph.plans.catalogue import QUERIES

        return QUERIES[question](self, **params)
