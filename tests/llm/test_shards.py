from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import shards as S


def test_round_trip_and_tiers(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = S.ShardStore(spark, str(tmp_path / "store"), target_bytes=300_000, base_bytes=20_000)
    store.append(docs.where("doc_id % 2 = 0"), 40)
    store.append(docs.where("doc_id % 2 = 1"), 40)
    small = store.manifest().count()
    assert small >= 25 and store.versions() == [1, 2]
    assert store.compact() > 2 and store.versions()[:2] == [1, 2]
    assert store.read(2).count() == docs.count()  # versions that were just superseded are still there
    store.vacuum(0)
    got = store.read()
    version = store.versions()[-1]
    assert store.versions() == [version] and version > 2
    assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    m = store.manifest().collect()
    assert len(m) < small / 2 and sum(r.n_rows for r in m) == docs.count()
    assert not [t for t in {r.tier for r in m} if sum(r.tier == t and r.n_bytes < store.target // 2 for r in m) >= S.FAN_IN]
    assert max(r.n_bytes for r in m) < 1.3 * store.target
    assert {r.shard: r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {r.shard: r.n_rows for r in m}


def test_of_two_writers_one_wins(spark, tmp_path):
    """Writers that start from one version: one of them commits, the others fail, nothing is lost."""
    store = S.ShardStore(spark, str(tmp_path / "store"))
    store.append(spark.range(5))
    rows = store.manifest()

    def commit(_):
        try:
            return store._commit(rows, 1)
        except RuntimeError:
            return None

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(commit, range(6)))
    assert sorted(map(str, got)) == ["2"] + ["None"] * 5
    assert store.versions() == [1, 2] and store.read().count() == 5
    assert len(list((tmp_path / "store" / "_manifests").iterdir())) == 2


def test_merges_in_rounds(spark, tmp_path, monkeypatch):
    """However many shards a merge takes at a time, every tier ends with fewer than FAN_IN."""
    monkeypatch.setattr(S, "MERGE_SHARDS", 7)
    store = S.ShardStore(spark, str(tmp_path / "store"), target_bytes=4_000, base_bytes=200)
    store.append(spark.range(600).repartition(3), 10)
    assert store.manifest().count() == 60
    store.compact(retain=0)
    assert sorted(r.id for r in store.read().collect()) == list(range(600)) and store.manifest().count() < 12


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (3, "x" * 10**6, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string")
    docs.write.parquet(str(tmp_path / "d" / "documents.parquet"))
    got = S.query(spark, str(tmp_path / "d"))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 1, 3]
    store = S.ShardStore(spark, str(tmp_path / "store"))
    store.append(docs)
    assert sorted(store.read().columns) == ["doc_id", "shard", "shard_bytes", "shard_rows", "text", "tier", "tier_"]
    docs.limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert S.query(spark, str(tmp_path / "e")).count() == 0


def test_query(spark):
    got = S.query(spark, "/root/testdata/sf0.001").collect()
    assert len({r.doc_id for r in got}) == len(got) == 200


def test_writers_that_meet_lose_nothing(spark, tmp_path, monkeypatch):
    """An append and a merge that are overtaken start anew, and leave no folder behind that no version names."""
    store = S.ShardStore(spark, str(tmp_path / "store"), target_bytes=4_000, base_bytes=200)
    store.append(spark.range(300).repartition(3), 10)
    commit, met = S.ShardStore._commit, []

    def late(self, rows, after):
        if len(met) < 2:
            met.append(after)
            commit(self, self.manifest().unionByName(self._listed(other)), after)
        return commit(self, rows, after)

    other = str(tmp_path / "store" / "data" / "other")
    spark.range(1000, 1001).coalesce(1).write.parquet(other)
    monkeypatch.setattr(S.ShardStore, "_commit", late)
    store.append(spark.range(300, 310))
    store.compact(retain=0)
    monkeypatch.undo()
    got = [r.id for r in store.read().collect()]
    assert set(got) == {*range(310), 1000} and len(met) == 2
    named = {r.path.rpartition("/")[0].rpartition("/")[2] for v in store.versions() for r in store.manifest(v).collect()}
    assert {p.name for p in (tmp_path / "store" / "data").iterdir() if list(p.glob("*.parquet"))} == named
    monkeypatch.setattr(S.ShardStore, "_commit", lambda *_: (_ for _ in ()).throw(S.Conflict()))
    before = set((tmp_path / "store" / "data").iterdir())
    with pytest.raises(S.Conflict):
        store.append(spark.range(5))
    assert set((tmp_path / "store" / "data").iterdir()) == before
