import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import merge, patterns, resolve, traverse
from quillgraph.streaming import incremental


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "src string, dst string, edge_id int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycles_lead_back(spark):
    e = edges(spark, [("1", "2"), ("2", "3"), ("3", "1")])
    assert rows(traverse.reach(ids(spark, "1"), e, 2)) == [("1", "2", 1), ("1", "3", 2)]
    assert rows(traverse.reach(ids(spark, "1"), e, 3)) == [("1", "1", 3), ("1", "2", 1), ("1", "3", 2)]
    assert rows(traverse.closure(ids(spark, "1"), e)) == rows(traverse.reach(ids(spark, "1"), e, 9))
    assert traverse.closure(ids(spark, "none"), e).count() == 0


def test_paths_repeat_no_edge(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "d")])
    got = [(r.nodes, r.depth) for r in traverse.paths(ids(spark, "a"), e, 4).collect()]
    assert sorted(x for x, _ in got if x[-1] == "d") == [["a", "b", "d"], ["a", "b", "d", "d"], ["a", "c", "d"], ["a", "c", "d", "d"]]
    assert rows(traverse.reach(ids(spark, "a"), e, 2).where("node = 'd'")) == [("a", "d", 2)]


def test_parallel_edges_and_dangling_ends(spark):
    raw = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "y", 2), ("a", "b", "x", 3), ("a", "gone", "x", 4), (None, "b", "x", 5)], "from_id string, to_id string, config string, seq int")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    kept = merge.merge_edges(raw.drop("seq"), nodes, nodes, "id", "id")
    assert rows(kept) == [("a", "b", "x"), ("a", "b", "y")]
    assert rows(merge.merge_edges(raw, nodes, nodes, "id", "id", ["from_id", "to_id"], "seq")) == [("a", "b", "x")]
    d = traverse.degrees(kept.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), "src", "dst")
    assert rows(d) == [("a", 2, 1)]
    assert rows(merge.write_counts(raw, kept)) == [(5, 2)]


def test_nodes_and_properties(spark):
    base = spark.createDataFrame([("a", "old"), ("z", "kept")], "id string, name string")
    new = spark.createDataFrame([("a", "one", 1), ("a", "two", 2), (None, "x", 3)], "id string, name string, seq int")
    assert rows(merge.merge_nodes(new, "id", "seq", base)) == [("a", "two"), ("z", "kept")]
    up = spark.createDataFrame([("a", "set", 5), ("nobody", "x", 6)], "id string, name string, n int")
    assert rows(merge.set_properties(base, up, "id")) == [("a", "set", 5), ("z", "kept", None)]
    assert rows(merge.graph_diff(base, merge.set_properties(base, up.select("id", "name"), "id").union(spark.createDataFrame([("n", "n")], base.schema)).where("id <> 'z'"), ["id"])) == [("a", "changed"), ("n", "added"), ("z", "removed")]


def test_optional_keeps_rows(spark):
    base, right = ids(spark, "a", "b"), spark.createDataFrame([("a", 1), ("a", 9)], "id string, v int")
    assert [(r.id, r.v) for r in patterns.optional_match(base, right, "id", F.col("v") > 5).orderBy("id").collect()] == [("a", 9), ("b", None)]
    agg = right.where("v > 100").groupBy("id").agg(patterns.listed("v").alias("vs"))
    assert [(r.id, r.vs) for r in patterns.optional_branches(base, "id", x=agg).orderBy("id").collect()] == [("a", None), ("b", None)]


def test_nearest_supertype(spark):
    direct = spark.createDataFrame([("c", "p"), ("c", "q"), ("p", "g"), ("q", "g"), ("g", "c")], "src string, dst string")
    got = {(r.start, r.node): r.depth for r in traverse.nearest_supertypes(direct).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "c"} == {"p": 1, "q": 1, "g": 2}


def test_versions(spark):
    order = ["1.0-alpha", "1.0-rc1", "1.0", "1.2", "1.9", "1.10-android", "1.10-jre", "2.0.1", "10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(resolve.version_key(F.col("v"))).collect()] == order


@pytest.mark.parametrize("name,want", [("a.b.c", "x"), ("a.bc", None), ("a.b", "x"), ("q.r", "y")])
def test_raw_prefix_ends_at_segments(spark, name, want):
    table = spark.createDataFrame([("a.b", "x"), ("a", "w"), ("q.", "y")], "p string, v string").where("p <> 'a'")
    got = resolve.raw_prefix(spark.createDataFrame([(name,)], "n string"), "n", table, "p", "v").collect()
    assert (got[0].v if got else None) == want


def test_text_functions(spark):
    df = spark.createDataFrame([("lib/x/src/main/java/com/a/B.java", "a\nb", " x, ,y ")], "p string, t string, c string")
    r = df.select(
        T.java_fqn(F.col("p")).alias("a"), T.java_fqn(F.col("p"), True).alias("b"), T.line_count(F.col("t")).alias("c"), T.csv_list(F.col("c")).alias("d"), T.parent_name(F.lit("a.b.c")).alias("e"), T.parent_name(F.lit("a")).alias("f"),
        T.first_match(F.lit("k=v"), r"(\w)=").alias("g"), T.first_match(F.lit("kv"), r"(\w)=").alias("h"), T.is_type_variable(F.lit("T1")).alias("i"), T.percentage(F.lit(1), F.lit(0)).alias("j"),
        T.last_valid_json(F.lit('```json\n{"a": 1}\n```\n```\n{"a": 2}\n```\n```\n{"a": }\n```'), "a int")["a"].alias("k"), T.stripped(F.lit("//a/"), "/").alias("l"), T.token_estimate(F.lit("123456789")).alias("m"),
    ).first()
    assert tuple(r) == ("com.a.B", "com.a.B", 2, ["x", "y"], "a.b", None, "k", None, True, 0.0, 2, "a", 2)


def test_streams(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(path)
    schema = spark.read.parquet(path).schema
    q = incremental.windowed_counts(spark.readStream.schema(schema).parquet(path)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    want = spark.read.parquet(path).groupBy("event_type").count().orderBy("event_type").collect()
    assert [tuple(r) for r in spark.sql("SELECT event_type, sum(n) FROM counts GROUP BY 1 ORDER BY 1").collect()] == [tuple(r) for r in want]
    src, out = str(tmp_path / "src"), str(tmp_path / "graph")
    batches = [[("a", "b", "f1"), ("c", "d", "f2")], [("a", "z", "f1")]]
    for b in batches:
        spark.createDataFrame(b, "from_id string, to_id string, sourceFile string").coalesce(1).write.mode("append").parquet(src)
        incremental.replace_by_source(spark.readStream.schema("from_id string, to_id string, sourceFile string").option("maxFilesPerTrigger", 1).parquet(src), out + str(len(b))).awaitTermination()
    assert incremental.current(spark, str(tmp_path / "none")) is None
    assert rows(incremental.current(spark, out + "2").select("from_id", "to_id")) == [("a", "b"), ("c", "d")]
    got = rows(incremental.current(spark, out + "1").select("from_id", "to_id"))
    assert got == [("a", "z"), ("c", "d")]
