import hashlib
import random
import re

from quillgraph.llm import decontam as D


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(i, tuple(w[k : k + 13])) for k in range(max(1, len(w) - 12))] if w else []
    out = []
    for t in texts:
        w = words(t)
        hit, met = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    met.add(i)
        ids = ",".join(sorted(str(i) for i in met if i is not None))
        out.append((len(w), len(hit), len(met - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def run(spark, texts, items, limit=None):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, h int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = D.decontaminate(docs, bench) if limit is None else D.judged(docs, bench, 13, 20, limit).drop("h")
    return [tuple(r)[1:] for r in found.orderBy("doc_id").collect()]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "Étage", "étage", "K", "k", "K", "naïve", "x1", "ünder"] + [f"w{k}" for k in range(12)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", ", ", "-", "\n", "_"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 5, 13, 14, 30]))) for k in range(25)] + [(7, "the of"), (100, None), (101, ""), (102, "..."), (None, "w1 w2 w3")]
    texts = [None, "", "!!", "the"] + ["".join(rng.choice([text(rng.randint(0, 20)), rng.choice(items)[1] or ""]) for _ in range(rng.randint(0, 5))) for _ in range(60)]
    texts += [texts[6], "w5 " * 3000]
    want = brute(texts, items)
    assert run(spark, texts, items) == want
    assert run(spark, texts, items, limit=0) == want  # windows that are too many to be sent round


def test_long_text_and_many_owners(spark):
    """A passage that 300 items share, and a text of 50,000 words, on both sides of the size limit."""
    passage = " ".join(f"p{k}" for k in range(60))
    items = [(k, f"{passage} own{k}") for k in range(300)]
    texts = ["x " * 25_000 + passage + " y" * 25_000, passage, f"{passage} own7", "p1 p2"]
    got = run(spark, texts, items)
    assert got == run(spark, texts, items, limit=0)
    assert [g[:3] + g[4:] for g in got] == [(50_060, 60, 300, False), (60, 60, 300, True), (61, 61, 300, True), (2, 0, 0, False)]


def test_empty_tables(spark):
    assert run(spark, ["a b", None], []) == brute(["a b", None], [])
    assert run(spark, [], [(1, "a b")]) == []


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "z"), (None, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in D.decontaminate(docs, bench).collect())
    assert got == [(0, 2, 2), (1, 1, 0), (1, 3, 2), (1, 3, 2)]
