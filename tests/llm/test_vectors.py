import os

import numpy as np
import pytest

from quillgraph.llm import vectors as V
from quillgraph.llm.components import components, union_find

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int"


def brute(rows, threshold=0.9):
    ok = {i: V.unit(np.array(e, dtype=np.float32).astype(float).tobytes()) for i, (_, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e)}
    ok = {i: x for i, x in ok.items() if x is not None}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    n = {i: 0 for i in range(len(rows))}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    roots = union_find((rows[a][0], rows[b][0]) for a, b in links)
    return sorted((v, n[i], roots.get(v, v), roots.get(v, v) == v) for i, (v, _) in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(120, 16))
    rows = [(i, (base[i % 120] * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.06 * (i % 4)).tolist()) for i in range(400)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] * 8), (404, [float("nan")] * 16), (405, [float("inf")] * 16), (406, rows[5][1]), (407, rows[5][1]), (408, [1.0, 0.0]), (409, [2.0, 0.0]), (410, [-1.0, 0.0])]
    got = sorted(tuple(r) for r in V.near_duplicates(spark.createDataFrame([(i, e, None, "k", 1) for i, e in rows], SCHEMA)).collect())
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    odd = {r[0]: r for r in got}
    no_id = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<double>")
    assert sorted(map(repr, V.near_duplicates(no_id).collect())) == sorted(["Row(vec_id=None, n_links=0, component_id=None, kept=True)"] * 2 + ["Row(vec_id=3, n_links=0, component_id=3, kept=True)"])
    assert all(odd[i][1:] == (0, i, True) for i in range(400, 406))
    assert odd[407] == next(w for w in want if w[0] == 407) and odd[409] == (409, 1, 408, False)


def test_repeated_ids(spark):
    """Another vector of the same vec_id is another row: it links, and counts, by itself."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (0, [1.0, 1.0])]
    got = sorted(tuple(r) for r in V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_blocks_and_regions(spark, monkeypatch):
    """Small regions, blocks and products give the same links as large ones."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * 0.08).tolist(), None, "k", 1) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(tuple(r) for r in V.near_duplicates(docs).collect())
    assert want == brute([r[:2] for r in rows])
    for name, value in (("CELL", 20), ("BLOCK", 16), ("PRODUCTS", 64)):
        monkeypatch.setattr(V, name, value)
    got = sorted(tuple(r) for r in V.near_duplicates(docs).collect())
    assert sum(g[1] for g in got) >= 0.99 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("d", ["/root/testdata/sf0.1", "/root/testdata/check_s"])
def test_recall_on_tables(spark, d):
    if not os.path.isdir(d):
        pytest.skip("no such table here")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = {r.vec_id: r for r in V.query(spark, d).collect()}
    x = np.array([V.unit(np.array(e).tobytes()) for _, e in rows])
    true = sum((x[k : k + 1000] @ x.T >= 0.9).sum() for k in range(0, len(x), 1000)) - len(x)
    assert 0.99 * true <= sum(r.n_links for r in got.values()) <= true


def test_recall_outside_copy_groups():
    """Groups of near copies must not settle the visits for pairs near the threshold."""
    rng = np.random.default_rng(4)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    copies = norm(np.repeat(rng.normal(size=(8, 32)), 500, axis=0) + 0.002 * rng.normal(size=(4000, 32)))
    left = norm(rng.normal(size=(2000, 32)))
    noise = rng.normal(size=left.shape)
    noise = norm(noise - (noise * left).sum(1)[:, None] * left)
    cosine = rng.uniform(0.9, 0.92, size=(2000, 1))
    right = cosine * left + np.sqrt(1 - cosine**2) * noise
    index = V.MultiIndex(rng.permutation(np.concatenate([copies, left, right])), 32, 0.9, 0.995)
    found = [b[0] in a or a[0] in b for a, b in zip(index.cells(left), index.cells(right))]
    assert np.mean(found) >= 0.985
    needed = index._needed(left[:50], right[:50])
    for a, b, n in zip(left[:50], right[:50], needed.tolist()):
        near = lambda k: index.cells(b[None], 1)[0][0] in index.cells(a[None], k)[0] or index.cells(a[None], 1)[0][0] in index.cells(b[None], k)[0]  # noqa: E731, B023
        assert near(n)


def test_empty(spark):
    assert V.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    want = {k: v for k, v in union_find(edges).items() if k != v}
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "x long, y long").repartition(7)).collect()}
    assert got == want
