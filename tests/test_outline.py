"""The splittable reading of indented text against a sequential one."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.extract import build
from quillgraph.operators import outline
from quillgraph.sources import corpus


def sequential(lines):
    """(depth, name, opens) -> parent, by one stack; None for lines that close all."""
    stack, out = [], []
    for depth, name, opens in lines:
        if depth is None:
            stack.clear()
            continue
        if opens:
            while stack and stack[-1][0] >= depth:
                stack.pop()
        out.append(next((n for d, n in reversed(stack) if n is not None and d < depth), None))
        if opens:
            stack.append((depth, name))
    return out


@pytest.mark.parametrize("fan", [2, 64])
def test_equals_a_sequential_reader_on_random_cuts(spark, monkeypatch, fan):
    monkeypatch.setattr(outline, "FAN", fan)
    rng = random.Random(fan)
    rows, want = [], []
    for f in range(12):
        n = rng.choice([1, 5, 60])
        lines = [(None if rng.random() < 0.04 else rng.randint(0, rng.choice([1, 6])), rng.choice([None, f"n{k}"]), rng.random() < 0.8) for k in range(n)]
        cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.choice([0, 3, 30]))))
        chunk = [sum(c <= k for c in cuts) * 1000 for k in range(n)]
        rows += [(f"f{f}", c, d, name, o, k) for k, (c, (d, name, o)) in enumerate(zip(chunk, lines))]
        want += [(f"f{f}", k, p) for k, p in zip((k for k in range(n) if lines[k][0] is not None), sequential(lines))]
    df = spark.createDataFrame(rows, "path string, chunk long, depth int, name string, opens boolean, k int").coalesce(1)
    got = [(r.path, r.k, r.parent) for r in outline.parents(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_lines(spark):
    assert outline.parents(spark.createDataFrame([], "path string, chunk long, depth int, name string, opens boolean")).collect() == []


def test_a_large_text_is_read_in_splits(spark, tmp_path):
    rng = random.Random(1)
    text = ["runtimeClasspath"]
    depths = []
    for k in range(40_000):
        d = min(rng.randint(0, 5), (depths[-1] + 1) if depths else 0) if k else 0
        depths.append(d)
        text.append("|    " * d + f"+--- g{k % 7}:a{k}:1.{k}")
    (tmp_path / "deps").mkdir()
    (tmp_path / "deps" / "dependency-tree é.txt").write_text("\n".join(text))
    (tmp_path / "other.txt").write_text("+--- x:y:1\n     +--- x:z:1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = corpus.text_lines(spark, str(tmp_path), r"dependency-tree.*\.txt")
        assert lines.select("chunk").distinct().count() > 10
        known = spark.createDataFrame([], "coordinate string, group string, artifact string, latestVersion string, name string, catalogAlias string")
        found = build.dependency_trees(str(tmp_path))(lines, {"ExternalLibrary": known})
        got = sorted((r.from_id, r.to_id) for r in found["LIB_DEPENDS_ON"].collect())
        names = [f"g{k % 7}:a{k}" for k in range(40_000)]
        want = sequential([(d, n, True) for d, n in zip(depths, names)])
        assert got == sorted((p, n) for p, n in zip(want, names) if p) and found["ExternalLibrary"].count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sections(spark):
    df = spark.createDataFrame([("a", k // 3, f"[{k}]" if k % 5 == 2 else "x", k) for k in range(40)], "path string, chunk long, line string, k int").coalesce(1)
    got = outline.sections(df.withColumn("h", F.when(F.col("line").startswith("["), F.col("line"))), "h").select("k", "section").collect()
    assert {r.k: r.section for r in got} == {k: f"[{(k - 2) // 5 * 5 + 2}]" if k >= 2 else None for k in range(40)}


def test_only_the_files_asked_for_are_opened(spark, tmp_path):
    for name in ("a/x y.k", "a/b%20c+d.k", "m.java", "dé/t.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    files = corpus.tree(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["a/b%20c+d.k", "a/x y.k", "dé/t.java", "m.java"]
    picked = corpus.without(corpus.named(files, r".*\.k"), "x y")
    assert [r.content for r in picked.collect()] == ["text"]
    scan = picked._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numFiles").get().value() == 1
