import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Row
from tokenizers import Tokenizer

from quillgraph.llm import packing as P


def naive(sizes, capacity):
    """Piece-by-piece: greedy pairs of large ones, then best fit."""
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    rooms = []
    while large:
        a = large.pop(0)
        k = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        rooms.append(capacity - a - (large.pop(k) if k is not None else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= s]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_plan_equals_piecewise_packing():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice([10, 30, 64])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 120))]
        bins = P.plan(Counter(sizes), cap)
        assert Counter(x for p, n in bins for x in p for _ in range(n)) == Counter(sizes)
        assert all(sum(p) <= cap and sum(3 * x > cap for x in p) <= 2 for p, _ in bins)
        assert sum(n for _, n in bins) == naive(sizes, cap)


def test_word_ids_equal_the_tokenizer():
    path = P.tokenizer_path()
    ids, t = P.WordIds(path, 20), Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["Hello", "l'été", "don't", "I'LL", "x", " ", "  ", "\n", "\t", "é", "É", "é", "ß", "ẞ", "İ", "12", "a1b2", "###", "!!", "'s", "'S", "''", "'re", "<|endoftext|>", "<", "|", ">", "日本", "_", "º", "½", " ", "\u0000", "😀", "ñ", "×", "÷", "Ǆ"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(ids(s), '<u4').tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def check(spark, docs, rows):
    t = Tokenizer.from_file(P.tokenizer_path())
    by_doc, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_doc) == sorted({d.doc_id for d in docs})
    for d in docs:
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.length for r in own] == [min(2048, len(ids) - k) for k in range(0, len(ids), 2048)]
        for r in own:
            assert r.start == r.piece * 2048 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(n for s in seqs.values() for _, n in s)
    assert len(seqs) >= -(-total // 2048)
    return len(seqs), -(-total // 2048)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    n, least = check(spark, spark.read.parquet(f"{d}/documents.parquet").collect(), P.query(spark, d).collect())
    assert n <= 1.02 * least + 1


def test_odd_tables(spark, tmp_path):
    rows = [Row(doc_id=1, text=None, length="x", rank=1), Row(doc_id=2, text="", length="x", rank=1), Row(doc_id=3, text="word " * 5000, length="x", rank=1)]
    spark.createDataFrame(rows, "doc_id long, text string, length string, rank int").write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, rows, P.query(spark, str(tmp_path)).collect())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert P.query(spark, str(tmp_path / "e")).count() == 0
