import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import Row

from quillgraph.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx string, G string, path int"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes):
    """Root and, for each node, its siblings by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            ways[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        at = [i // 3 for i in at]
        nodes = [H("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, ways


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    subs, out = [], []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(by[source], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        subs.append((own, *climb([leaf(r, r.text) for r in own])))
    root, tops = climb([s[1] for s in subs])
    for (own, sub, ways), top in zip(subs, tops):
        for r, way in zip(own, ways):
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            h = leaf(r, r.text.replace("\n", "") if even and r.text is not None else r.text)
            for a, b in (*way, *top):
                h = H(a + h + b)
            out.append((r.doc_id, leaf(r, r.text), sub, root, H("".join(a + b for a, b in (*way, *top))), h, h == root))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def made(n, sources, seed):
    rng = random.Random(seed)
    texts = [None, "", "a\nb", "\n", "é" * 5, "x" * 100_000 + "\n"]
    return [Row(doc_id=k, source=rng.choice(sources), lang=rng.choice([None, "en"]), n_chars=rng.choice([None, 3]), text=rng.choice(texts), idx="x", G="y", path=1) for k in rng.sample(range(n), n)]


@pytest.mark.parametrize("n, sources", [(1, ["a"]), (4, [None]), (70, [None, "", "ä", "z", "Z", "+"]), (1500, ["hot"] * 9 + [None, "one"]), (300, [f"s{k}" for k in range(120)])])
def test_equals_brute_force(spark, tmp_path, n, sources):
    rows = made(n, sources, n)
    if n == 70:  # repeated rows, repeated ids and null ids
        rows += rows[:9] + [Row(**(r.asDict() | {"text": "other"})) for r in rows[:5]] + [Row(**(r.asDict() | {"doc_id": None})) for r in rows[:4]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.query(spark, str(tmp_path))
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_copies_of_one_row_are_spread(spark, tmp_path):
    one = made(1, ["a"], 0)[0]
    spark.range(4000).selectExpr("1L AS doc_id", "'a' AS source", "'en' AS lang", "3L AS n_chars", "'a' AS text").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = M.query(spark, str(tmp_path)).collect()
    rows = [Row(**(one.asDict() | {"doc_id": 1, "source": "a", "lang": "en", "n_chars": 3, "text": "a"}))] * 4000
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert M.query(spark, str(tmp_path)).collect() == []


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.execute(M.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in M.query(spark, d).collect()]
    assert len(got) > 100 and sorted(got) == sorted(want) and {r[-1] for r in got} == {True, False}


def test_verify_names_the_changed_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").dropDuplicates(["doc_id"])
    manifest = M.build(docs)
    changed = docs.selectExpr("doc_id", "source", "lang", "n_chars", "if(doc_id = 3, concat(text, 'x'), text) AS text")
    assert [r.doc_id for r in M.verified(manifest, changed).where("NOT verified").collect()] == [3]
    assert manifest.root().count() == 1
