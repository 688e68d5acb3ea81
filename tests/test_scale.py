"""What large tables bring: keys above a million, more edges than a report shows, one row group, rounds that look small."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.extract import java
from quillgraph.operators import merge, patterns, resolve, traverse
from quillgraph.plans import questions, tables, trees

D = "/root/testdata/sf0.001"


def both(spark, queries, oracles, name, folder):
    """Sorted rows of a query and of its SQL over a folder of tables."""
    df = queries[name](spark, str(folder))
    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return sorted(map(tuple, df.collect())), sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracles[name]})").fetchall())


def plans_since(spark, done):
    """Plans, as they ended, of the executions after the first done ones."""
    store = spark._jsparkSession.sharedState().statusStore()
    return [store.executionsList().apply(k).physicalPlanDescription() for k in range(done, store.executionsCount())]


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_weights_of_large_ids(spark, tmp_path):
    """Ids of a million and more: depth 1 at 1,900,000 weighs more than depth 2 at 100,000."""
    chain = [1_900_000, 1_800_000, 100_000, 90_000]
    lines = [(o, p, n) for o, pair in enumerate(zip(chain, chain[1:])) for n, p in enumerate(pair, 1)]
    duckdb.sql("SELECT 1")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INTEGER)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?)", lines)
    con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"COPY (SELECT unnest({chain})::BIGINT AS p_partkey, 3 AS p_size) TO '{tmp_path}/part.parquet'")
    got, want = both(spark, tables.QUERIES, tables.ORACLES, "override_nearest", tmp_path)
    assert got == want and (1_900_000, 100_000, 1) in got


def test_all_circular_modules(spark, tmp_path):
    for t in ("nation", "region"):
        duckdb.sql(f"COPY (SELECT * FROM '{D}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    duckdb.sql(f"COPY (SELECT k::BIGINT AS s_suppkey, 'S' || k AS s_name, ((k * 11 + k // 25) % 25)::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(700) t(k)) TO '{tmp_path}/supplier.parquet'")
    got, want = both(spark, trees.QUERIES, trees.ORACLES, "question_circular_modules", tmp_path)
    assert len(want) > 10 and got == want


def test_include_chains_compare_no_pairs(spark):
    plan = questions.QUERIES["question_include_chains"](spark, D)._jdf.queryExecution().optimizedPlan().toString()
    assert "s_suppkey" in plan and "<=" not in plan and ">=" not in plan


@pytest.mark.parametrize("rows", [500, 9_001])
def test_tables_are_dealt_out(spark, tmp_path, monkeypatch, rows):
    """A table of one row group is parsed by as many tasks as its rows ask for."""
    monkeypatch.setattr(trees.Tree, "ROWS", 1_000, raising=False)
    duckdb.sql(f"COPY (SELECT * FROM '{D}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    duckdb.sql(f"COPY (SELECT k::BIGINT AS p_partkey FROM range({rows}) t(k)) TO '{tmp_path}/part.parquet'")
    files = trees.Tree(spark, str(tmp_path)).java()
    held = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == rows and max(held) <= 1_500


def test_rounds_are_not_broadcast(spark):
    edges = spark.range(300).selectExpr("id AS src", "id div 2 AS dst").union(spark.range(300).selectExpr("id", "(id * 7) % 300"))
    done = executions(spark)
    traverse.closure(spark.range(1), edges).count()
    traverse.nearest_supertypes(edges.selectExpr("string(src)", "string(dst)").where("src > dst")).count()
    found = plans_since(spark, done)
    assert any("SortMergeJoin" in p for p in found) and not any("BroadcastHashJoin" in p for p in found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overrides_stop_at_the_first_hit(spark, seed):
    """As the whole closure says, cycles and diamonds included."""
    rng = random.Random(seed)
    pairs = sorted({(f"C{rng.randrange(14)}", f"C{rng.randrange(14)}") for _ in range(24)})
    methods = sorted({(f"C{rng.randrange(14)}", f"m{rng.randrange(5)}", rng.choice(["int", "String"]), rng.random() < 0.2) for _ in range(40)})
    direct = spark.createDataFrame(pairs, "src string, dst string").where("src <> dst")
    m = spark.createDataFrame([(f"{o}#{n}({t}){s}", n, o, f"{n}({t})", 1, False, s, False) for o, n, t, s in methods], "id string, name string, ownerFqn string, signature string, arity int, isConstructor boolean, isStatic boolean, hasOverrideAnnotation boolean")
    above = {}
    for r in traverse.nearest_supertypes(direct).collect():
        above.setdefault(r.start, []).append((r.depth, r.bfs, r.node))
    rows = m.collect()
    want = set()
    for a in rows:
        met = [(d, b, a.signature != x.signature, x.id) for d, b, n in above.get(a.ownerFqn, []) for x in rows if x.ownerFqn == n and x.name == a.name]
        if met and not a.isStatic:
            want.add((a.id, min(met)[3], "arity" if min(met)[2] else "signature"))
    got = java.overrides(m, direct).select("from_id", "to_id", "matchKind").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_levels_above_a_hit_are_not_walked(spark, monkeypatch):
    """A chain in which every class has the method ends after its first level."""
    depths = []
    true = traverse.counted
    monkeypatch.setattr(traverse, "counted", lambda df: depths.append(1) or true(df))
    direct = spark.range(1, 30).selectExpr("concat('C', id) AS src", "concat('C', id - 1) AS dst")
    m = spark.range(30).selectExpr("concat('C', id, '#m()') AS id", "'m' AS name", "concat('C', id) AS ownerFqn", "'m()' AS signature", "0 AS arity", "false AS isConstructor", "false AS isStatic", "false AS hasOverrideAnnotation")
    assert java.overrides(m, direct).count() == 29 and len(depths) <= 5


def test_pairs_are_counted_by_tasks_that_follow_the_rows(spark, monkeypatch):
    rows = spark.range(4_000).selectExpr("id div 4 AS g", "id % 60 AS i")
    before = sorted(map(tuple, patterns.co_occurrence(rows, "g", "i").collect()))
    monkeypatch.setattr(patterns, "ROWS", 250, raising=False)
    cut = patterns.co_occurrence(rows, "g", "i")
    assert sorted(map(tuple, cut.collect())) == before
    assert "RepartitionByExpression [a" in cut._jdf.queryExecution().optimizedPlan().toString() and ", 16" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_class_names_are_not_broadcast(spark):
    """What the extractor reads out of a small table's rows is joined by sorting, whatever its size is taken for."""
    graph = java.java(trees._hierarchy(trees.Tree(spark, D)), {})
    for kind in ("EXTENDS", "IMPLEMENTS", "IMPORTS", "OVERRIDES"):
        plan = graph[kind]._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, kind


def test_known_names_are_joined_by_sorting(spark):
    known = spark.sql("SELECT * FROM VALUES ('a'), ('b') AS t(fqn)")
    edges = spark.createDataFrame([("a", "b", "f"), ("a", "b", "f"), ("a", "a", "f"), ("b", "z", "f"), ("z", "a", "f")], "from_id string, to_id string, sourceFile string")
    found = [merge.valid_edges(edges, known, "fqn"), resolve.best_candidate(edges.withColumn("rank", F.lit(1)), ["from_id"], "to_id", "rank", known, "fqn")]
    assert all("BroadcastHashJoin" not in f._jdf.queryExecution().executedPlan().toString() for f in found)
    assert [sorted(map(tuple, f.collect())) for f in found] == [[("a", "b", "f")], [("a", "a", 1), ("z", "a", 1)]]


def nearest_by_hand(pairs):
    out, found = {}, set()
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
    for s in out:
        level, seen = {s: ()}, {s}
        while level:
            above = {}
            for n, way in level.items():
                for b in out.get(n, []):
                    if b not in seen:
                        above[b] = min(above.get(b, (*way, b)), (*way, b))
            found |= {(s, n, len(way), way) for n, way in above.items()}
            seen |= set(above)
            level = above
    return sorted(found)


@pytest.mark.parametrize("seed", [1, 2])
def test_supertypes_of_deep_graphs(spark, monkeypatch, seed):
    """A path of 40 takes a write for each doubling of the depth, not for each level; diamonds, shortcuts and cycles included."""
    writes = []
    true = traverse.counted
    monkeypatch.setattr(traverse, "counted", lambda df: writes.append(1) or true(df))
    rng = random.Random(seed)
    pairs = [(f"C{k}", f"C{k + 1}") for k in range(40)] + [(f"C{k}", f"I{rng.randrange(5)}") for k in range(40)]
    pairs += [("I1", "I0"), ("I2", "I0"), ("I3", "I2"), ("I3", "I1"), ("I0", "I3"), ("C40", "C31"), ("C7", "C7")] + [(f"D{k}", f"D{k + d}") for k in range(20) for d in (1, 2, rng.randrange(3, 9))]
    direct = spark.createDataFrame(pairs, "src string, dst string")
    got = traverse.nearest_supertypes(direct).select("start", "node", "depth", "bfs").collect()
    assert sorted((r.start, r.node, r.depth, tuple(r.bfs)) for r in got) == nearest_by_hand(pairs)
    assert len(writes) <= 9


def test_supertypes_are_read_without_overrides(spark, monkeypatch):
    """What only asks for the supertypes does not search them for methods."""
    monkeypatch.setattr(java, "overrides", lambda *a: pytest.fail("overrides were sought"))
    assert trees.QUERIES["nearest_supertypes"](spark, D).columns == ["start", "node", "depth", "way"]
