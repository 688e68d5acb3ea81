"""Upsert semantics of a property graph: nodes by key, edges by endpoints, diffs of builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _prefer(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: str = "_rank") -> DataFrame:
    return df.withColumn(keep, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(keep) == 1).drop(keep)


def merge_nodes(rows: DataFrame, key: str, seq: str, base: DataFrame | None = None) -> DataFrame:
    """Nodes after an upsert: of rows with one key the last by seq sets every property.

    Rows without a key are dropped. base holds the nodes that are there already; their
    properties stay where the key gets no new row.
    """
    last = _prefer(rows.where(F.col(key).isNotNull()), [key], [F.col(seq).desc_nulls_last()]).drop(seq)
    if base is None:
        return last
    return base.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def merge_edges(rows: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str, target_key: str, first_by: Sequence[str] | None = None, seq: str | None = None) -> DataFrame:
    """Edges after an upsert: both ends must exist; equal in type, ends and properties is one.

    first_by: columns of which only the first row (by seq) survives, as (from_id, to_id) or
    a wider key; without it edges that differ in a property stay side by side.
    """
    kept = rows.join(sources.select(F.col(source_key).alias("from_id")).distinct(), "from_id", "left_semi")
    kept = kept.join(targets.select(F.col(target_key).alias("to_id")).distinct(), "to_id", "left_semi").select(*rows.columns)
    if first_by is None:
        return (kept.drop(seq) if seq else kept).distinct()
    return _prefer(kept, first_by, [F.col(seq).asc_nulls_last()]).drop(seq)


def write_counts(rows: DataFrame, written: DataFrame) -> DataFrame:
    """attempted and written row counts of an upsert."""
    return rows.agg(F.count("*").alias("attempted")).crossJoin(written.agg(F.count("*").alias("written")))


def set_properties(nodes: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Sets properties of nodes that exist, in one join; absent keys create nothing."""
    new = [c for c in updates.columns if c != key]
    u = updates.select(key, F.struct(*new).alias("_set"))
    joined = nodes.join(u, key, "left")
    kept = [F.when(F.col("_set").isNotNull(), F.col("_set")[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns]
    return joined.select(*kept, *[F.col("_set")[c].alias(c) for c in new if c not in nodes.columns])


def duplicate_keys(nodes: DataFrame, key: str) -> DataFrame:
    """Keys that break a uniqueness constraint, with their number of rows."""
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def valid_edges(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Edges between known nodes, no loops, the first of each pair.

    Joined by sorting, as in resolve.best_candidate; what lies by from_id after the second join
    needs no further shuffle to drop duplicates.
    """
    ids = known.select(F.col(key).alias("_id")).distinct().hint("merge")
    return edges.where(F.col("from_id") != F.col("to_id")).join(ids, F.col("to_id") == F.col("_id"), "left_semi").join(ids, F.col("from_id") == F.col("_id"), "left_semi").dropDuplicates(["from_id", "to_id"])


def priority_merge(*sources: DataFrame, key: str) -> DataFrame:
    """One row per key, from the first source that has it; all share one schema."""
    tagged = [s.withColumn("_priority", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    others = [F.col(c).asc_nulls_last() for c in every.columns if c not in (key, "_priority")]
    return _prefer(every, [key], [F.col("_priority"), *others]).drop("_priority")


def graph_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """change (added, removed, changed) and key of what differs between two builds."""
    key = list(key)
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("_old") if rest else F.lit(True).alias("_old"))
    n = new.select(*key, F.struct(*[c for c in rest]).alias("_new") if rest else F.lit(True).alias("_new"))
    both = o.join(n, key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(*key, change.alias("change")).where(F.col("change").isNotNull())


def missing_nodes(mentioned: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are mentioned but not known: the nodes still to be made."""
    return mentioned.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
