import zlib

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillgraph.llm import langid as L


def test_accuracy_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = L.query(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == docs[r.doc_id].lang for r in held]
    assert np.mean(right) > 0.97
    loss = -np.mean([np.log(max(r.score if ok else 1 - r.score, 1e-6)) for r, ok in zip(held, right)])
    assert loss < 0.2


def test_odd_rows(spark):
    rows = [Row(doc_id=i, text=t, lang=x, score="s", held_out=1, lang_pred=None) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 12 + [(None, None), ("", "en"), ("123 !!", "fr"), (None, "en"), ("the", None)])]
    docs = spark.createDataFrame(rows + rows[-2:], "doc_id long, text string, lang string, score string, held_out int, lang_pred string")
    got = L.identify_languages(docs).collect()
    assert len(got) == len(rows) + 2
    odd = {r.doc_id: r for r in got if r.doc_id >= 24}
    assert [odd[k].lang_pred for k in range(24, 28)] == ["und"] * 4 and odd[28].lang_pred == "en"
    assert L.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def ids_of(text, dims):
    return np.concatenate(list(L.id_blocks(text, dims)))


def test_block_scores_equal_single_texts(spark):
    labels, w = ["a", "b"], np.random.default_rng(0).normal(size=(1 << 10, 2)).astype(np.float32)
    texts = ["abc def", "x", "hello world " * 50, "é", "ab" * 200_000, "x" * (L.BLOCK - 1), "y" * (L.BLOCK + 1), "é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for r in L.predict(docs, labels, w).collect():
        ids = ids_of(texts[r.doc_id], 1 << 10)
        assert len(ids) == 3 * len(texts[r.doc_id]) + 3
        p = L.softmax(w[ids].sum(axis=0, dtype=float) / len(ids))
        assert abs(p.max() - r.score) < 1e-5 and labels[p.argmax()] == r.lang_pred


def test_blocks_do_not_change_ngrams(monkeypatch):
    texts = ["", "a", "abc", "the quick brown fox é", "x" * 7]
    whole = [sorted(ids_of(t, 1 << 12)) for t in texts]
    for block in (1, 2, 3, 5):
        monkeypatch.setattr(L, "BLOCK", block)
        assert [sorted(ids_of(t, 1 << 12)) for t in texts] == whole


def test_sample_bound(spark):
    """per_label rows of a label at most, whatever ids repeat or lack; the least hashes, all of a small label."""
    rows = [(1, f"text {k}", "a") for k in range(200)] + [(None, f"none {k}", "a") for k in range(200)] + [(k, f"b {k}", "b") for k in range(2000)] + [(k, "c", "c") for k in range(5)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = L.sampled(train, {"a": 400, "b": 2000, "c": 5}, 60).collect()
    assert {x: sum(r.lang == x for r in got) for x in "abc"} == {"a": 60, "b": 60, "c": 5}
    hashed = spark.createDataFrame([(k,) for k in range(2000)], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(60)
    assert {r.text for r in got if r.lang == "b"} == {f"b {r.doc_id}" for r in hashed.collect()}


def test_tf_idf_against_brute_force(spark):
    texts = ["abab", "b c", "abc abc", "c"]
    df, n_of = L.document_frequencies(spark.createDataFrame([(t, "xy"[k % 2]) for k, t in enumerate(texts)], "text string, lang string"), 1 << 12)
    assert n_of == {"x": 2, "y": 2}
    grams = [[f" {t} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)] for t in texts]
    one = {g: int(L.grams(np.array([*map(ord, g)], dtype=np.uint32), 1 << 12)[len(g) - 1, 0]) for row in grams for g in row}
    assert len(set(one.values())) == len(one)  # no two share an id here
    assert {i: int(n) for i, n in enumerate(df) if n} == {i: sum(g in row for row in grams) for g, i in one.items()}
    idf = L.inverse(df, 4)
    for text, row in zip(texts, grams):
        ids, counts = L.counted(text, 1 << 12)
        x = dict(zip(ids.tolist(), L.weighted(ids, counts, idf).tolist()))
        assert {one[g] for g in row} == set(x)
        for g in row:
            assert abs(x[one[g]] - L.SCALE * row.count(g) / len(row) * (np.log(5 / (1 + sum(g in r for r in grams))) + 1)) < 1e-9


def test_ftrl_against_brute_force_and_sparsity():
    """A coordinate at a time in plain Python gives the same weights; more l1 gives more zeros."""
    rng = np.random.default_rng(3)
    dims, labels = 40, 3
    samples = [(np.sort(rng.choice(dims, 6, replace=False)), rng.uniform(0, 2, size=6), int(rng.integers(labels))) for _ in range(30)]

    def plain(l1, l2):
        z, n = [[0.0] * labels for _ in range(dims)], [[0.0] * labels for _ in range(dims)]

        def weight(i, c):
            return 0.0 if abs(z[i][c]) <= l1 else -(z[i][c] - np.sign(z[i][c]) * l1) / ((L.BETA + n[i][c] ** 0.5) / L.ALPHA + l2)

        order = np.random.default_rng(7)
        for _ in range(2):
            for k in order.permutation(len(samples)):
                ids, x, y = samples[k]
                w = [[weight(i, c) for c in range(labels)] for i in ids]
                e = np.exp([sum(a * b[c] for a, b in zip(x, w)) for c in range(labels)])
                for a, i, old in zip(x, ids, w):
                    for c in range(labels):
                        g = a * (e[c] / e.sum() - (c == y))
                        z[i][c] += g - ((n[i][c] + g * g) ** 0.5 - n[i][c] ** 0.5) / L.ALPHA * old[c]
                        n[i][c] += g * g
        return np.array([[weight(i, c) for c in range(labels)] for i in range(dims)])

    zeros = []
    for l1 in (0.0, 0.5, 2.0, 50.0):
        got = L.train_ftrl(samples, dims, labels, 2, l1, 0.1)
        assert np.allclose(got, plain(l1, 0.1), atol=1e-9)
        zeros.append((got == 0).sum())
    assert zeros == sorted(zeros) and zeros[0] < zeros[2] < zeros[3] == dims * labels


def test_temperature_against_a_grid():
    rng = np.random.default_rng(6)
    labels = rng.integers(4, size=500)
    logits = rng.normal(size=(500, 4)) * 2
    logits[np.arange(500), labels] += 2
    loss = lambda t: -np.log(L.softmax(logits / t)[np.arange(500), labels]).mean()
    assert loss(L.temperature(logits, labels)) <= min(loss(t) for t in np.geomspace(0.1, 10, 400)) + 1e-6


def test_weights_are_sparse(spark):
    labels, w = L.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert len(labels) > 1 and (w == 0).mean() > 0.5
