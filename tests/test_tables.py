"""Every table query against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillgraph.plans import forms, questions, tables, trees

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{D}/{f}'")
    return con


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


QUERIES, ORACLES = tables.QUERIES | trees.QUERIES | forms.QUERIES | questions.QUERIES, tables.ORACLES | trees.ORACLES | forms.ORACLES | questions.ORACLES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    sql = con.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == cols
    assert got == sorted(repr([norm(dict(zip(names, r))[c]) for c in cols]) for r in sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_partkey", "p_name", "p_size"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
