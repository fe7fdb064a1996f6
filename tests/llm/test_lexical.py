import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tilewise.llm import arrays
from tilewise.llm import lexical as L

DIR = "/root/testdata/sf0.001"
KIND = "doc_id long, text string"


def words(text):
    return re.findall(L.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10, once=True):
    docs = [(d, words(t)) for d, t in docs]
    docs = [(d, len(w), Counter(w)) for d, w in docs if w]
    total = sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(words(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for d, n, c in docs:
            m = 100 - 90 + 90 * n * len(docs) // total
            s = sum((1 if once else often) * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, often in ts.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted([(r["item_id"], r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def test_query_equals_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", "text").collect()]
    got = rows(L.op12_lexical_search(spark, DIR))
    assert got == brute(docs, items) and len(got) > 10
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    assert sorted([tuple(r) for r in con.execute(L.OP12_SQL).fetchall()], key=str) == got


DOCS = [
    (3, "Alpha beta, ALPHA! gamma"), (2, "alpha beta alpha gamma"), (None, "alpha beta alpha gamma"), (2, "alpha beta alpha gamma"), (9, None), (8, ""), (7, " .,-_\t"),
    (5, "Élan élan Ｗｉｄｅ 日本 x1y2"), (6, "beta " * 250_000 + "tail"), (1, "delta"), (-4, "x" * 1_200_000 + " delta"),
]
ITEMS = [(1, "alpha gamma"), (1, "Beta"), (None, "delta delta TAIL"), (2, None), (3, ""), (4, "Élan 日本"), (5, "nowhere"), (6, "élan x1y2 alpha"), (7, "alpha alpha beta")]


@pytest.mark.parametrize("once,pairs", [(True, L.PAIRS), (False, 8)])
def test_odd_rows_ties_and_blocks(spark, once, pairs):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], KIND + ", item_id string, rank int").repartition(4)
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, score int")
    for k in (2, 10):
        assert rows(L.search(docs, items, k, once=once, pairs=pairs)) == brute(DOCS, ITEMS, k, once)


def test_many_copies_are_ranked_by_id(spark):
    docs = [(i * 37 % 6000, "same words here") for i in range(6000)] + [(10_000 + i, "same other") for i in range(50)]
    got = rows(L.search(spark.createDataFrame(docs, KIND).repartition(7), spark.createDataFrame([(1, "same here")], "item_id long, text string")))
    assert got == brute(docs, [(1, "same here")]) and sorted(r[2] for r in got) == list(range(10))


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], KIND), spark.createDataFrame([(1, "a b")], KIND)
    items = one.withColumnRenamed("doc_id", "item_id")
    assert rows(L.search(none, items)) == rows(L.search(one, items.limit(0))) == []
    assert rows(L.search(one, items)) == brute([(1, "a b")], [(1, "a b")])


def test_sizes_beyond_64_bits():
    n = np.array([0, 5, 10**9], np.int64)
    assert L.lengths(n, 10**12, 10**15).tolist() == [10 + 90 * int(x) * 10**12 // 10**15 for x in n]


def test_arrays_come_back():
    some = [np.arange(5, dtype=np.uint32), np.zeros(0, np.int64), np.array([2**40, 7], np.uint64), np.array([1, 2, 255], np.uint8)]
    for a, b in zip(some, arrays.unpack(arrays.pack(*some))):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
    assert arrays.narrow(np.array([300, 2])).dtype == np.uint16
