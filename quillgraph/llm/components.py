"""Connected components of an edge table, with nothing gathered on the driver.

Each task first contracts its own edges; alternating large and small stars (Kiveris et
al., 2014) then link every node to the smallest of its component. Every round is written
to the shared folder, so lineage stays short and executors may be lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut


def union_find(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node to the smallest node of its component, for all nodes that pairs name."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(k, v) for k, v in union_find(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())).items() if k != v]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that is not a root.

    edges: two long columns; null ends are dropped, loops and repeated edges do no harm.
    """
    a, b = (F.col(c) for c in edges.columns[:2])
    e = edges.select(a.alias("u"), b.alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.mapInArrow(_contract, "u long, v long"), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = cut(small.distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
