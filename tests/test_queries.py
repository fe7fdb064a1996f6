import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tilewise import queries as core

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        path = f"{DIR}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(df):
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{float(x):.5f}".replace("-0.00000", "0.00000") if not isinstance(x, str) else x

    return sorted(tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_its_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, DIR).toPandas(), con.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or abs(float(p) - float(q)) < 2e-4 for p, q in zip(x, y))


def test_pairs_without_sql(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r.doc_id: r.f1 for r in core.QUERIES["rouge_l_pairs"](spark, DIR).collect()}
    import re

    from tests.test_sequences_text import brute_lcs

    for d in list(got)[:20]:
        a, b = ([t for t in re.sub("[^a-z0-9]+", " ", docs[x].lower()).split(" ") if t] for x in (d, d + 1))
        n = brute_lcs(a, b)
        assert got[d] == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0, abs=1e-6)
    assert core.QUERIES["rouge_l_stem"](spark, DIR).count() == len(got)


def test_stems_of_whole_texts(spark, tmp_path):
    same = " ".join(f"same{i}" for i in range(150))
    texts = [(1, " ".join(f"a{i}" for i in range(120)) + " " + same), (2, " ".join(f"b{i}" for i in range(110)) + " " + same), (3, "walking dogs"), (4, "walked dog")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.f1 for r in core.QUERIES["rouge_l_stem"](spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(300 / 530, abs=1e-6), 2: 0.0, 3: 1.0}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
