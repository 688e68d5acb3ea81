"""Traversal of edge frames: hops, bounded reach, closure, paths and degrees.

Edge frames have the columns src, dst and, where edges have types, rel. Parallel edges are
rows of their own; only the operators that say so collapse them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.session import shared_path


def of_types(edges: DataFrame, rels: Sequence[str]) -> DataFrame:
    """Edges of any of the types (type alternation)."""
    return edges.where(F.col("rel").isin(list(rels)))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in edges.columns])


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges))


def hop(starts: DataFrame, edges: DataFrame, start: str = "id") -> DataFrame:
    """start, dst, one row for each edge that leaves a start (multiplicity is kept)."""
    return starts.select(F.col(start).alias("src")).join(edges, "src")


def reach(starts: DataFrame, edges: DataFrame, most: int, least: int = 1) -> DataFrame:
    """start, node, depth: nodes at the end of a path of least to most edges, at least depth.

    A start is among its own nodes if it lies on a cycle that short. Exact for paths without
    repeated edges: a shortest walk repeats none. Up to three hops the plan is lazy and the
    least depth of each pair is taken at the end; beyond, each round is written and drops the
    pairs that were seen, as in closure().
    """
    if most > 3:
        found = closure(starts, edges, most)
        return found.where(F.col("depth") >= least) if least > 1 else found
    pairs = edges.select("src", "dst").distinct()
    seeds = starts.select(F.col("id").alias("start")).distinct()
    here = seeds.join(pairs, seeds["start"] == pairs["src"]).select("start", F.col("dst").alias("node"))
    found = here.withColumn("depth", F.lit(1))
    for depth in range(2, most + 1):
        here = here.select("start", F.col("node").alias("src")).join(pairs, "src").select("start", F.col("dst").alias("node")).distinct()
        found = found.unionByName(here.withColumn("depth", F.lit(depth)))
    if most > 1:  # one aggregation in place of an anti-join a round
        found = found.groupBy("start", "node").agg(F.min("depth").alias("depth"))
    return found.where(F.col("depth") >= least) if least > 1 else found


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """kept(), and the number of rows, which the write has seen."""
    path, seen = shared_path(df.sparkSession, "round"), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


#: Rounds whose rows are kept apart until they go to the bucketed table.
RECENT = 16


class Bucketed:
    """Rows of many rounds in one table of the shared folder, bucketed by key and appended to.

    A join on the key reads the buckets where they lie: only the other side is shuffled.
    """

    def __init__(self, spark: SparkSession, keys: Sequence[str]):
        self.spark, self.keys, self.path = spark, list(keys), shared_path(spark, "seen")
        self.name, self.schema = f"quillgraph_{self.path[-32:]}", None

    def append(self, rows: DataFrame) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema = rows.schema
        # dealt out by the key already, so each task writes its own buckets
        dealt = rows.repartition(buckets, *self.keys)
        dealt.write.bucketBy(buckets, *self.keys).sortBy(*self.keys).mode("append").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def closed(self) -> DataFrame:
        """The rows by their files; the table's name goes."""
        self.spark.sql(f"DROP TABLE {self.name}")
        return self.spark.read.schema(self.schema).parquet(self.path)


def rounds(first: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: Sequence[str], most: int | None = None) -> DataFrame:
    """first and what step(rows of the last round, depth) adds to it, as long as keys are new.

    Every round is written, so lineage stays one round deep and a lost executor repeats no
    earlier one. What a round shuffles follows its own rows and those of the RECENT rounds
    before it; all earlier ones lie in a bucketed table. Rounds are joined by sorting: by the
    size of its compressed files a round would be taken for small and sent through the driver.
    """
    old, recent, depth = Bucketed(first.sparkSession, keys), [], 1
    rows, n = counted(first)
    while n:
        recent.append(rows)
        if depth == most:
            break
        if len(recent) == RECENT:
            old.append(reduce(DataFrame.unionByName, recent))
            recent = []
        depth += 1
        found = step(rows, depth)
        if recent:
            found = found.join(reduce(DataFrame.unionByName, recent).select(*keys).hint("merge"), list(keys), "left_anti")
        if old.schema is not None:
            found = found.join(old.rows().select(*keys).hint("merge"), list(keys), "left_anti")
        rows, n = counted(found)
    parts = [*([old.closed()] if old.schema is not None else []), *recent]
    return reduce(DataFrame.unionByName, parts) if parts else rows


def closure(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """start, node, depth of everything reachable (over most edges at most), cycles included; ends when nothing is new."""
    pairs = kept(edges.select("src", "dst").distinct())
    seeds = starts.select(F.col("id").alias("start")).distinct()
    first = seeds.join(pairs.hint("merge"), seeds["start"] == pairs["src"]).select("start", F.col("dst").alias("node"), F.lit(1).alias("depth"))

    def step(rows: DataFrame, depth: int) -> DataFrame:
        return rows.select("start", F.col("node").alias("src")).join(pairs.hint("merge"), "src").select("start", F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth))

    return rounds(first, step, ["start", "node"], most)


def paths(starts: DataFrame, edges: DataFrame, most: int, least: int = 1) -> DataFrame:
    """start, nodes (array), edge_ids (array), depth: a row for each path of least to most edges.

    No edge repeats within a path, nodes may. edges need a column edge_id that tells parallel
    edges apart.
    """
    e = edges.select("src", "dst", "edge_id")
    here = starts.select(F.col("id").alias("start")).distinct().withColumn("nodes", F.array("start")).withColumn("edge_ids", F.array().cast(f"array<{e.schema['edge_id'].dataType.simpleString()}>"))
    found = []
    for depth in range(1, most + 1):
        here = here.withColumn("src", F.element_at("nodes", -1)).join(e, "src").where(~F.array_contains("edge_ids", F.col("edge_id")))
        here = here.select("start", F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
        if depth >= least:
            found.append(here.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found)


class PathGraph:
    """The paths of up to most edges from starts, kept as layers of edges and not one by one.

    layers[d - 1] has src, dst and edge_id of the edges that can be the d-th of a path, so what
    is stored grows with edges and depth, whatever the number of paths. Paths are counted by
    summing over layers; they are written out on demand, up to a stated number.
    """

    def __init__(self, starts: DataFrame, edges: DataFrame, most: int):
        e = edges.select("src", "dst", "edge_id")
        self.starts, self.most, self.layers = kept(starts.select(F.col("id").alias("start")).distinct()), most, []
        here = self.starts.select(F.col("start").alias("src"))
        for _ in range(most):
            layer, n = counted(e.join(here, "src", "left_semi"))
            if not n:
                break
            self.layers.append(layer)
            here = layer.select(F.col("dst").alias("src")).distinct()

    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.layers).distinct()

    def counts(self) -> DataFrame:
        """start, depth, n_paths (decimal): how many paths of that many edges leave a start; none is 0 and has no row.

        A path repeats no edge, as in paths(). Where no cycle is in reach, each walk is a path,
        and the walks of one length are the sum of those one shorter over the next nodes. The
        other starts, those that can come to a cycle, have their paths counted one by one.
        """
        if not self.layers:
            return self.starts.select("start", F.lit(1).alias("depth"), F.lit(0).cast("decimal(38,0)").alias("n_paths")).limit(0)
        e = kept(self.edges())
        looping = self._before_cycles(e)
        free = self.starts if looping is None else self.starts.join(looping.withColumnRenamed("node", "start"), "start", "left_anti")
        n, found = None, []
        steps = e.groupBy("src", "dst").agg(F.count("*").cast("decimal(38,0)").alias("m"))
        for depth in range(1, len(self.layers) + 1):
            way = steps.withColumn("k", F.col("m")) if n is None else steps.join(n.withColumnRenamed("src", "dst"), "dst").withColumn("k", (F.col("m") * F.col("n")).cast("decimal(38,0)"))
            n = kept(way.groupBy("src").agg(F.sum("k").cast("decimal(38,0)").alias("n")))
            found.append(free.join(n.withColumnRenamed("src", "start"), "start").select("start", F.lit(depth).alias("depth"), F.col("n").alias("n_paths")))
        if looping is not None:
            one_by_one = paths(self.starts.join(looping.withColumnRenamed("node", "start"), "start", "left_semi").select(F.col("start").alias("id")), e, self.most)
            found.append(one_by_one.groupBy("start", "depth").agg(F.count("*").cast("decimal(38,0)").alias("n_paths")))
        return reduce(DataFrame.unionByName, found)

    def _before_cycles(self, e: DataFrame) -> DataFrame | None:
        """Nodes from which a cycle can be reached in the layers; None if there is none.

        Nodes without an edge in or without one out are peeled off until all have both; what
        is left holds every cycle (and what lies between cycles).
        """
        left, n = counted(e.select("src", "dst").distinct())
        while n:
            inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            inner, m = counted(inner.select("src", "dst"))
            if m == n:
                break
            left, n = inner, m
        if not n:
            return None
        nodes = left.select(F.col("src").alias("node")).distinct()
        for _ in range(self.most):
            nodes = nodes.unionByName(e.join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))).distinct()
        return kept(nodes)

    def total(self) -> int:
        return int(self.counts().agg(F.sum("n_paths")).first()[0] or 0)

    def listed(self, bound: int) -> DataFrame:
        """All paths, as of paths(); an error, before any is written, if there are more than bound."""
        if (n := self.total()) > bound:
            raise ValueError(f"{n} paths, more than {bound}")
        e = self.edges() if self.layers else self.starts.sparkSession.createDataFrame([], "src string, dst string, edge_id string")
        return paths(self.starts.select(F.col("start").alias("id")), e, self.most)


def degrees(edges: DataFrame, end: str, other: str) -> DataFrame:
    """node, n_edges (parallel ones counted each), n_neighbours."""
    return edges.groupBy(F.col(end).alias("node")).agg(F.count("*").alias("n_edges"), F.countDistinct(other).alias("n_neighbours"))


def mutual(edges: DataFrame) -> DataFrame:
    """a < b joined both ways; parallel edges multiply the rows as the pattern does."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"]).where(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))


def without_incoming(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that no edge enters (all the types given at once)."""
    return nodes.join(edges.select(F.col("dst").alias(key)), key, "left_anti")


def nearest_supertypes(direct: DataFrame) -> DataFrame:
    """start, node, depth, bfs: supertypes nearest first; siblings in order of name.

    bfs is the least path of names that leads there, which orders nodes of one depth.

    Each round doubles the depth: a shortest path longer than span has a node at span, and both
    its parts are least shortest paths that are known. So there are as many rounds as the depth
    has binary digits, and a path is put together once, not shuffled again at every level above.
    Upper parts are asked of starts that lie at span above another only (inner), and those get
    fewer with every round.
    """

    def marked(rows: DataFrame, middles: DataFrame) -> DataFrame:
        inner = middles.select(F.col("node").alias("start")).distinct().withColumn("inner", F.lit(True))
        return rows.join(inner.hint("merge"), "start", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))

    pairs = kept(direct.select(F.col("src").alias("start"), F.col("dst").alias("node")).distinct().where("start <> node"))
    rows = kept(marked(pairs.select("start", "node", F.lit(1).alias("depth"), F.array("node").alias("bfs")), pairs))
    found, span = [rows], 1
    while not (ends := rows.where(F.col("depth") == span)).isEmpty():
        known = reduce(DataFrame.unionByName, found)
        heads = marked(ends.select("start", F.col("node").alias("middle"), F.col("bfs").alias("head")), ends)
        tails = known.where("inner").select(F.col("start").alias("middle"), "node", (F.col("depth") + span).alias("depth"), F.col("bfs").alias("tail"))
        met = heads.join(tails.hint("merge"), "middle").where("start <> node").select("start", "node", "inner", "depth", F.concat("head", "tail").alias("bfs"))
        new = met.join(known.select("start", "node").hint("merge"), ["start", "node"], "left_anti")
        new = new.groupBy("start", "node").agg(F.min(F.struct("depth", "bfs")).alias("least"), F.bool_or("inner").alias("inner"))
        rows = kept(new.select("start", "node", "least.depth", "least.bfs", "inner"))
        found.append(rows)
        span *= 2
    return reduce(DataFrame.unionByName, found).drop("inner")


def nearest_with(asked: DataFrame, having: DataFrame, direct: DataFrame, by: Sequence[str]) -> DataFrame:
    """start, the columns of by, node, depth, bfs: the supertypes of least depth that have what a start asks for.

    asked: start and by, distinct; having: node and by. Order and bfs are those of
    nearest_supertypes(), but a search ends with the first level that has a hit, so the levels
    above are neither walked nor kept.
    """
    by = list(by)
    key = ["start", *by]
    pairs = kept(direct.select("src", "dst").distinct().where("src <> dst"))
    has = kept(having.select("node", *by).distinct().join(pairs.select(F.col("dst").alias("node")).distinct().hint("merge"), "node", "left_semi"))
    # what no supertype has need not be looked for
    open_ = asked.select(*key).join(has.select(*by).distinct(), by, "left_semi")

    def level(rows: DataFrame, depth: int) -> DataFrame:
        found = rows.join(pairs.hint("merge"), "src").groupBy(*key, F.col("dst").alias("node")).agg(F.min(F.array_append("bfs", F.col("dst"))).alias("bfs")).where("start <> node")
        marked = found.join(has.withColumn("hit", F.lit(True)).hint("merge"), ["node", *by], "left")
        return marked.select(*key, "node", F.lit(depth).alias("depth"), "bfs", F.coalesce("hit", F.lit(False)).alias("hit"))

    def step(rows: DataFrame, depth: int) -> DataFrame:
        missed = rows.withColumn("_met", F.max("hit").over(W.partitionBy(*key))).where("NOT _met")
        return level(missed.select(*key, F.col("node").alias("src"), "bfs"), depth)

    first = level(open_.withColumn("src", F.col("start")).withColumn("bfs", F.array().cast("array<string>")), 1)
    return rounds(first, step, [*key, "node"]).where("hit").drop("hit")
