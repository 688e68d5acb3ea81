import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from quillgraph.llm import decontam, packing, surrogates
from quillgraph.llm.common import table
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check

D = "/root/testdata/sf0.001"


def windows(texts):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return words, [{tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set() for w in words]


def contaminated(texts, items):
    lengths = {len(w) for s in windows(items)[1] for w in s}
    wanted = set().union(*windows(items)[1])
    out = []
    for w in windows(texts)[0]:
        hit = {k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wanted for k in range(i, i + n)}
        out.append(bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    rows = docs.orderBy("doc_id").collect()

    kept = P.language_id(spark, docs, D)
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.text and any(map(str.isalpha, r.text))}

    roots = brute([r.text for r in rows])
    kept = P.near_dedup(spark, docs, D)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == sorted({rows[k].doc_id for k in roots})

    bad = contaminated([r.text for r in rows], [r.text for r in table(spark, D, "benchmark").collect()])
    kept = P.decontaminate(spark, docs, D)
    assert kept.columns == columns and sorted(r.doc_id for r in kept.collect()) == [r.doc_id for r, b in zip(rows, bad) if not b] and any(bad)

    done = {r.doc_id: r for r in P.pii(spark, docs, D).collect()}
    for r in rows:
        found, new = surrogates.find(r.text), done[r.doc_id]
        assert new.n_chars == len(new.text) and (bool(found) or new.text == r.text)
        for a, b, _, _ in found:
            assert r.text[a:b] not in new.text


def test_run(spark):
    left = P.run(spark, D)
    docs = table(spark, D, "documents")
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, D).cache()
    n, least = check(spark, docs.collect(), left.collect())
    assert n <= 1.05 * least + 1
    assert left.columns == packing.query(spark, D).columns


def test_repeated_and_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    bench = spark.createDataFrame([(1, " ".join(f"test{k}" for k in range(20)), "x")], "item_id long, text string, doc_id string")
    rows = [(1, text, "en"), (1, text, "en"), (1, bench.first().text, "en"), (None, text + " more", "fr"), (None, bench.first().text, None), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id string").withColumn("gone", F.lit(1)).withColumn("bad_h", F.lit(1))
    assert sorted((r.doc_id or 0, r.text or "") for r in P.near_dedup(spark, docs, D).collect()) == [(1, bench.first().text), (1, text), (2, "")]
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean_documents(docs, bench).collect()) == [(0, text + " more"), (1, text), (1, text), (2, "")]
