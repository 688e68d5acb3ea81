"""Closures of many rounds, path graphs and lists cut to their heads, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import patterns, traverse


def reached(pairs, starts):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    found = set()
    for s in starts:
        seen, level, depth = set(), out[s], 1
        while level - seen:
            new = level - seen
            found |= {(s, n, depth) for n in new}
            seen |= new
            level, depth = set().union(*(out[n] for n in new)), depth + 1
    return sorted(found)


@pytest.mark.parametrize("recent", [1, 3, 16])
def test_closure_over_many_rounds(spark, monkeypatch, recent):
    monkeypatch.setattr(traverse, "RECENT", recent)
    rng = random.Random(recent)
    pairs = [(k, k + 1) for k in range(14)] + [(rng.randrange(15), rng.randrange(15)) for _ in range(4)] + [(14, 3)]
    starts = [0, 5, 14, 99]
    edges = spark.createDataFrame(pairs, "src int, dst int")
    got = traverse.closure(spark.createDataFrame([(s,) for s in starts], "id int"), edges)
    assert sorted(map(tuple, got.collect())) == reached(pairs, starts)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quillgraph_")]


def test_earlier_rounds_are_not_shuffled(spark):
    rows = spark.range(20_000).selectExpr("id % 100 AS start", "id AS node")
    old = traverse.Bucketed(spark, ["start", "node"])
    old.append(rows.where("node < 9000"))
    old.append(rows.where("node BETWEEN 9000 AND 15000"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = rows.join(old.rows().select("start", "node"), ["start", "node"], "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 4999 and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert old.closed().count() == 15_001


def trails(edges, starts, most):
    out, found = defaultdict(list), Counter()
    for e in edges:
        out[e[0]].append(e)
    for s in starts:
        todo = [(s, ())]
        while todo:
            node, used = todo.pop()
            for e in out[node]:
                if e not in used:
                    found[s, len(used) + 1] += 1
                    if len(used) + 1 < most:
                        todo.append((e[1], (*used, e)))
    return found


@pytest.mark.parametrize("seed, cyclic", [(1, False), (2, True), (3, True)])
def test_paths_are_counted_as_enumerated(spark, seed, cyclic):
    rng = random.Random(seed)
    edges = [(a, b, k) for k in range(40) for a, b in [(rng.randrange(12), rng.randrange(12))] if cyclic or a < b]
    starts = list(range(0, 13, 2))
    g = traverse.PathGraph(spark.createDataFrame([(s,) for s in starts], "id int"), spark.createDataFrame(edges, "src int, dst int, edge_id int"), 4)
    want = trails(edges, starts, 4)
    assert {(r.start, r.depth): int(r.n_paths) for r in g.counts().collect()} == dict(want)
    assert g.listed(10**6).count() == sum(want.values()) == g.total()
    with pytest.raises(ValueError):
        g.listed(sum(want.values()) - 1)


def test_a_billion_paths_are_counted(spark):
    edges = spark.range(64).selectExpr("id div 8 AS a", "id % 8 AS b").crossJoin(spark.range(9).withColumnRenamed("id", "d")).selectExpr("d * 8 + a AS src", "(d + 1) * 8 + b AS dst").withColumn("edge_id", F.concat_ws(">", "src", "dst"))
    g = traverse.PathGraph(spark.range(8), edges, 9)
    assert {r.depth: int(r.n) for r in g.counts().groupBy("depth").agg(F.sum("n_paths").alias("n")).collect()} == {d: 8 ** (d + 1) for d in range(1, 10)}
    assert g.total() > 10**9


def test_no_paths(spark):
    none = spark.createDataFrame([], "src int, dst int, edge_id int")
    g = traverse.PathGraph(spark.createDataFrame([(1,)], "id int"), none, 3)
    assert g.counts().collect() == [] and g.total() == 0


def test_heads_of_lists(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", rng.choice([None, *range(400)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(4)
    found = patterns.first_lists(df, "k", "v", 7, "vs")
    assert {r.k: r.vs for r in found.collect()} == {k: sorted({v for a, v in rows if a == k and v is not None})[:7] for k in {k for k, _ in rows}}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan
