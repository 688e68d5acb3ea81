import random

import numpy as np
import pytest

from quillgraph.llm import neardup as N
from quillgraph.llm.components import union_find


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], (last + 1 if x == y else max(row[j + 1], row[j]))
    return row[-1]


def brute(texts, least=0.8):
    words = [tuple(N._WORD((t or "").lower())) for t in texts]
    seqs = [N.shingles(N.word_hashes(t or "")) for t in texts]
    links = []
    for i, a in enumerate(seqs):
        for j in range(i):
            b = seqs[j]
            if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
                continue
            if words[i] == words[j] or (len(np.intersect1d(a, b)) and (n := lcs(a.tolist(), b.tolist())) >= least * (len(a) + len(b) - n) - 1e-9):
                links.append((i, j))
    roots = union_find(links)
    return [roots.get(i, i) for i in range(len(texts))]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    bases = [text(rng.randint(1, 120)) for _ in range(n // 6)] + [["line", "of", "words", "here"] * 20]
    passage = text(40)
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1, 2])] = text(rng.choice([0, 1, 1]))
            w = w or ["w"]
        out.append(" ".join(w + passage * (rng.random() < 0.3)))
    return out


@pytest.mark.parametrize("band", [3, 10**6])
def test_common_subsequence(band):
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, size=rng.integers(0, 150)).astype(np.uint32) for _ in range(2))
        if band == 3:
            b = np.delete(a, rng.integers(0, len(a), 3)) if len(a) else a
        assert N.common_subsequence(a, b, band) == lcs(a.tolist(), b.tolist())


@pytest.mark.parametrize(("block", "stars"), [(1536, 8), (3, 8), (5, 1)])
def test_against_brute_force(spark, monkeypatch, block, stars):
    texts = [None, "", "?!", "...", *corpus(block, 150), "One, two", "one two", "ONE two three"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(5)
    monkeypatch.setattr(N, "STARS", stars)
    got = {r.doc_id: r for r in N.near_duplicates(docs, block=block).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_bucket_links_connect_what_pairs_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 50, size=90).astype(np.uint32)
    seqs = []
    for _ in range(60):
        s = base.copy()
        s[rng.integers(0, 90, size=rng.integers(0, 14))] = rng.integers(100, 10**6)
        seqs.append(s)
    exact = [[sum((np.unique(a, return_counts=True)[1][np.unique(a) == v][0] if v in a else 0) and min((a == v).sum(), (b == v).sum()) for v in np.unique(a)) for b in seqs[:8]] for a in seqs[:8]]
    got = N.overlaps(seqs)
    assert all(got[i, j] == exact[i][j] for i in range(8) for j in range(8) if i != j)
    for own in (np.zeros(60), np.arange(60) % 2):
        pairs = [(i, j) for i in range(60) for j in range(i) if N.similar(seqs[i], seqs[j]) and (not own.any() or own[i] != own[j])]
        assert union_find(N.bucket_links(seqs, own, np.arange(60), 0.8)) == union_find(pairs) and len(pairs) > 200


def test_crowded_bucket_of_chains(spark):
    """A crowded bucket with one large group, a second one, and a bridge between them that no star is."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for k in range(42):  # near copies of one text, and of one that is less alike
        w = base[:] if k < 28 else base[:176] + [f"c{j}" for j in range(24)]
        w[rng.randrange(150)] = f"x{k}"
        texts.append(" ".join(w))
    texts.append(" ".join(base[:188] + [f"c{j}" for j in range(12)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute(texts)
    for stars in (1, 8):
        N.STARS, kept = stars, N.STARS
        got = {r.doc_id: r.class_id for r in N.near_duplicates(docs, block=10).collect()}
        N.STARS = kept
        assert [got[i] for i in range(len(texts))] == want


def test_odd_rows(spark):
    long = " ".join(map(str, range(300)))
    rows = [(5, long), (5, long), (5, "other text"), (None, long), (3, long + " 300"), (None, None), (8, None)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.kept) for r in got) == [(-1, -1, True), (-1, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (8, 8, True)]
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()]
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in N.query(spark, d).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want)
