import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import suffixes as S


def brute(texts, match):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + match] for r in raws for i in range(len(r) - match + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - match + 1):
            if seen[r[i : i + match]] > 1:
                gone[i : i + match] = True
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, gram string, rid int").repartition(3)
    return [tuple(r)[1:5] for r in S.remove_repeats(docs, **kw).orderBy("doc_id").collect()]


def corpus(seed, n=60, alphabet="ab cé"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(5, 90)) for _ in range(8)]
    texts = [None, "", "a", "aaaa" * 40, "aaaa" * 50, "abab" * 30]
    for _ in range(n):
        texts.append("".join(rng.choice([word(rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)[: rng.randint(1, 50)]]) for _ in range(rng.randint(0, 6))))
    return texts + texts[8:12]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts, match=30, gram=[8, 5, 30][seed]) == brute(texts, 30)


def test_hot_grams_and_blocks(spark, monkeypatch):
    texts = corpus(9, 30)
    assert run(spark, texts, match=30, gram=8, hot=0) == brute(texts, 30)
    monkeypatch.setattr(S, "BLOCK", 100)  # pieces of long texts; not seen by the workers, so tried here
    data = np.frombuffer(b"".join((t or "").encode() for t in texts), dtype=np.uint8)
    offsets = np.cumsum([0] + [len((t or "").encode()) for t in texts])
    windows = set()
    grams = S.Grams(30, 8)
    for a, b, inside in S._blocks(offsets, 30):
        row, first, last = (np.array(x) for x in zip(*inside))
        _, s, e = grams.segments(data[a:b], first - a, last - a)
        windows |= {a + k for i, j in zip(s, e) for k in range(i, j - 29)}
    assert windows == {k for i, j in zip(offsets, offsets[1:]) for k in range(i, j - 29)}


def test_two_stage_sort_is_a_suffix_sort():
    rng = np.random.default_rng(0)
    for sigma in (2, 3, 200):
        text = np.append(rng.integers(1, sigma + 1, size=300), 0).astype(np.uint8)
        got = S.two_stage_sort(text, np.ones(len(text), dtype=bool), 300)
        assert got.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tobytes())


def test_odd_rows(spark):
    rows = [(1, "x" * 250), (1, "x" * 250), (1, "y" * 10), (None, "z" * 210), (None, "q"), (7, None)]
    got = sorted(tuple(r)[1:4] for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(250, 250, 1), (250, 250, 1), (10, 0, 0), (210, 210, 1), (1, 0, 0), (0, 0, 0)])
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r)[1:] for r in S.query(spark, d).orderBy("doc_id").collect()]
    assert got == brute([r.text for r in rows], 200) and sum(g[1] for g in got)
