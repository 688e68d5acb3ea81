"""Stored graphs: whole versions, touched buckets alone, writers that die and writers that meet."""

import os

import pytest

from quillgraph.graph import Graph
from quillgraph.sources import snapshots


def modules(spark, *rows):
    return spark.createDataFrame(list(rows), "gradlePath string, name string")


def depends(spark, *rows):
    return spark.createDataFrame(list(rows), "from_id string, to_id string, config string")


def content(graph):
    return sorted(map(tuple, graph.nodes("Module").collect())), sorted(map(tuple, graph.nodes("DEPENDS_ON").collect()))


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "g")
    first = {"Module": modules(spark, *[(f":m{k}", "old") for k in range(200)]), "DEPENDS_ON": depends(spark, (":m1", ":m2", "api"))}
    assert Graph(spark, first).write(path) == 1
    store = snapshots.Snapshots(spark, path)
    before = store.manifest()
    assert len(before["Module"]["folders"]) == snapshots.BUCKETS
    new = {"Module": modules(spark, (":m3", "new"), (":x", "new")).selectExpr("*", "1 AS size"), "DEPENDS_ON": depends(spark, (":m1", ":m2", "api"), (":m1", ":m2", "other"))}
    assert Graph(spark, new).write(path, "append") == 2
    after = store.manifest()
    changed = [b for b, f in after["Module"]["folders"].items() if before["Module"]["folders"].get(b) != f]
    assert 1 <= len(changed) <= 2
    got = Graph.read(spark, path)
    assert {r.gradlePath: (r.name, r["size"]) for r in got.nodes("Module").collect()} == {f":m{k}": ("old", None) for k in range(200)} | {":m3": ("new", 1), ":x": ("new", 1)}
    assert content(got)[1] == [(":m1", ":m2", "api"), (":m1", ":m2", "other")]
    assert content(Graph.read(spark, path, 1))[0] == sorted((f":m{k}", "old") for k in range(200))


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    Graph(spark, {"Module": modules(spark, (":a", "1")), "DEPENDS_ON": depends(spark, (":a", ":a", "api"))}).write(path)
    reader = Graph.read(spark, path)
    want = content(reader)
    whole = snapshots.Snapshots.merged

    def dies(self, name, *rest):
        if name == "DEPENDS_ON":
            raise KeyboardInterrupt
        return whole(self, name, *rest)

    monkeypatch.setattr(snapshots.Snapshots, "merged", dies)
    with pytest.raises(KeyboardInterrupt):
        Graph(spark, {"Module": modules(spark, (":a", "2"), (":b", "2")), "DEPENDS_ON": depends(spark, (":a", ":b", "api"))}).write(path, "append")
    monkeypatch.undo()
    assert content(Graph.read(spark, path)) == want == content(reader)
    Graph(spark, {"Module": modules(spark, (":c", "3"))}).write(path, "append")
    assert content(Graph.read(spark, path))[0] == [(":a", "1"), (":c", "3")] and content(reader) == want


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    Graph(spark, {"Module": modules(spark, (":a", "1"))}).write(path)
    commit, met = snapshots.Snapshots.commit, []

    def late(self, frames, after):
        if not met:
            met.append(1)
            Graph(spark, {"Module": modules(spark, (":b", "other"))}).write(path, "append")
        return commit(self, frames, after)

    monkeypatch.setattr(snapshots.Snapshots, "commit", late)
    assert Graph(spark, {"Module": modules(spark, (":c", "own"))}).write(path, "append") == 3
    assert [r.name for r in Graph.read(spark, path).nodes("Module").orderBy("gradlePath").collect()] == ["1", "other", "own"]


def test_overwrite_clear_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "g")
    assert Graph.read(spark, path).frames == {}
    Graph(spark, {"Module": modules(spark, (":a", "1")), "DEPENDS_ON": depends(spark)}).write(path)
    assert Graph.read(spark, path).nodes("DEPENDS_ON").count() == 0
    Graph(spark, {"Module": modules(spark, (":b", "2"))}).write(path)
    assert set(Graph.read(spark, path).frames) == {"Module"}
    Graph(spark, {"Module": modules(spark, (":c", "3"))}).write(path, "append")
    Graph.vacuum(spark, path, keep=1, retain=0)
    assert snapshots.Snapshots(spark, path).versions() == [3] and content_names(Graph.read(spark, path)) == ["2", "3"]
    assert "DEPENDS_ON" not in os.listdir(f"{path}/_data") or not os.listdir(f"{path}/_data/DEPENDS_ON")
    Graph.clear(spark, path)
    assert Graph.read(spark, path).frames == {}


def content_names(graph):
    return sorted(r.name for r in graph.nodes("Module").collect())
