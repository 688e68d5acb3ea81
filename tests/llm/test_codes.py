import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row

from quillgraph.llm import codes as C

SCHEMA = "vec_id long, embedding array<double>, label string, id string, V int"


def brute(rows):
    """By the definition, comparing every part with every entry in every round."""
    kept = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    if not kept:
        return []
    data = np.array([[math.floor(256 * x) for x in r.embedding] for r in kept], dtype=np.int64)
    first = sorted(range(len(kept)), key=lambda k: (kept[k].vec_id, kept[k].embedding))[:64]
    parts = np.split(data, 16, axis=1)
    books = [p[first].copy() for p in parts]
    for k in range(3):
        d = [((p[:, None] - b[None]) ** 2).sum(2) for p, b in zip(parts, books)]
        own = [x.argmin(1) for x in d]
        if k < 2:
            for p, b, a in zip(parts, books, own):
                for j in set(a.tolist()):
                    b[j] = np.floor_divide(p[a == j].sum(0), (a == j).sum())
    error = sum(x[np.arange(len(kept)), a] for x, a in zip(d, own))
    by = defaultdict(int)
    for r, e in zip(kept, error.tolist()):
        by[r.label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r.vec_id, "".join(f"{a[k]:02x}" for a in own), int(error[k]), by[r.label], sha) for k, r in enumerate(kept)]


def made(n, dims, seed, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dims)] for _ in range(12)]
    return [Row(vec_id=k, embedding=[x + rng.gauss(0, spread) for x in rng.choice(centres)], label=rng.choice([None, "", "hot", "hot", f"l{k % 40}"]), id="x", V=1) for k in rng.sample(range(n), n)]


def result(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    got = C.query(spark, str(folder))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("n, dims", [(1, 16), (40, 32), (700, 64), (3000, 16)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, n, dims):
    monkeypatch.setattr(C, "BLOCK_ROWS", 257)
    rows = made(n, dims, n)
    if n == 700:
        bad = [None, [None] * dims, [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [-math.inf]]
        rows += [Row(vec_id=-k, embedding=v, label="hot", id="x", V=1) for k, v in enumerate(bad)]
        rows += rows[:50] + [Row(vec_id=r.vec_id, embedding=[0.0] * dims, label=r.label, id="x", V=1) for r in rows[:9]]  # repeated rows, ties at zero
        rows += [Row(vec_id=5000, embedding=[900.5] * dims, label=None, id="x", V=1), Row(vec_id=5001, embedding=[-5000.5] * dims, label=None, id="x", V=1)]
    assert result(spark, tmp_path, rows) == sorted(brute(rows))


def test_salted_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    rows = made(300, 16, 1)
    assert result(spark, tmp_path, rows) == sorted(brute(rows))


def test_heaps_leave_parts_alone():
    """Parts that are far from all but their own entry are not compared again, and none is that should be."""
    rng = np.random.default_rng(1)
    books = rng.integers(-1000, 1000, (4, 8, 3))
    x = np.concatenate([books[p][rng.integers(0, 8, 500)] + rng.integers(-40, 40, (500, 3)) for p in range(4)], axis=1)
    heaps, lost, seen = C.first_heaps(x, books), np.zeros((4, 8)), []
    for _ in range(5):
        moved = books + rng.integers(-30, 30, books.shape)
        drift = np.sqrt(((moved - books) ** 2).sum(2)) * (1 + C.MARGIN)
        lost, books = lost + drift + C.others(drift), moved
        heaps, n = C.next_heaps(x, books, heaps, lost)
        seen.append(n)
        own = np.empty((500, 4), int)
        own[heaps.rows, heaps.codes() // 8] = heaps.codes() % 8
        for p in range(4):
            assert (own[:, p] == ((x[:, None, 3 * p : 3 * p + 3] - books[p]) ** 2).sum(2).argmin(1)).all()
    assert 0 < sum(seen) < 5 * 2000 / 2


def test_empty_and_uneven(spark, tmp_path):
    assert result(spark, tmp_path / "a", []) == []
    with pytest.raises(ValueError):
        result(spark, tmp_path / "b", [Row(vec_id=1, embedding=[0.0] * 17, label=None, id="", V=1)])


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    want = sorted(con.execute(C.ORACLE_SQL).fetchall())
    assert len(want) > 50 and sorted(map(tuple, C.query(spark, d).collect())) == want
