import numpy as np
import pytest

from tilewise.llm import ann as A
from tilewise.llm import embed_dedup as E
from tilewise.llm.components import hook

KIND = "vec_id long, embedding array<float>, n int"


def crowd(seed=0, n=400, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    x = np.concatenate([base[rng.integers(0, 40, n)] + 0.12 * rng.normal(size=(n, dim)), rng.normal(size=(n, dim))])
    x[10:25] = x[10]
    return x.astype(np.float32)


def links(x):
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    i, j = np.nonzero(y @ y.T >= 0.9)
    return np.bincount(i, minlength=len(x)) - 1, hook(np.arange(len(x)), i, j)


@pytest.mark.parametrize("tile, block", [(4096, 1024), (64, 16)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "BLOCK", block)
    x = crowd()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND).repartition(3)
    got = sorted(E.near_duplicates(df).collect())
    n, label = links(x)
    assert [r.n_links for r in got] == n.tolist() and [r.component_id for r in got] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_products_near_the_threshold_are_decided_in_double():
    x = np.array([[1.0, 0.0], [0.9, np.sqrt(1 - 0.81)], [0.9 - 1e-9, np.sqrt(1 - (0.9 - 1e-9) ** 2)]])
    i, j = (np.concatenate(c) for c in zip(*E.linked(x, x, x, x, 0.9)))
    want = np.nonzero((x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(w.tolist() for w in want)))


ODD = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0)]


def test_dedup_rows_of_all_kinds(spark):
    df = spark.createDataFrame(ODD, KIND)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    alone = {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 10)}
    assert got == alone | {(1, 4, 1, True), (2, 4, 1, False), (8, 4, 1, False), (9, 4, 1, False), (None, 0, None, False)}
    assert E.near_duplicates(df.limit(0)).count() == 0


def brute(x, ids, q, k):
    out = {}
    for i in q:
        s = x.astype(float) @ x[i].astype(float)
        order = [j for j in np.lexsort((ids, -np.round(s, 9))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_search_finds_most_and_scores_exactly(spark):
    x = crowd(3)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND)
    got = {}
    for r in A.search(df, df.where("vec_id % 20 = 0"), short=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(x[r.query_id].astype(float) @ x[r.vec_id].astype(float)))
    want = brute(x, ids, range(0, len(x), 20), 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[k]) & set(want[k])) for k in want) / (20 * len(want)) >= 0.95


def test_search_rows_of_all_kinds(spark):
    df = spark.createDataFrame(ODD, KIND)
    got = A.search(df, df.where("vec_id in (1, 4, 5, 9)"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(1, 1, 2, 2.0), (1, 2, 8, 1.0), (1, 3, 9, 1.0), (9, 1, 2, 2.0), (9, 2, 1, 1.0), (9, 3, 8, 1.0)]
    assert A.search(df.limit(0), df.limit(0)).count() == 0 and A.search(df, df.limit(0)).count() == 0


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(500, 8))
    c = A.fit(x, books=4, words=16)
    miss = [c.encode(x, beam)[1] for beam in (1, 8)]
    assert (miss[1] ** 2).mean() <= (miss[0] ** 2).mean()
    codes, missed = c.encode(x)
    decoded = sum(c.books[b][codes[:, b]] for b in range(4))
    assert missed == pytest.approx(np.linalg.norm(x - decoded, axis=1), abs=1e-2)
    assert c.tables(x)[3, 2, codes[3, 2]] == pytest.approx(float(x[3] @ c.books[2][codes[3, 2]]), rel=1e-4)


def test_query_recall(spark):
    d = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding.to_list()), p.vec_id.to_numpy()
    want = brute(x, ids, np.flatnonzero(ids % 20 == 0), 20)
    got = {}
    for r in A.op8_ann(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[k] & set(want[k])) for k in want) / (20 * len(want)) >= 0.9


def test_search_is_whole_in_a_crowd(spark):
    rng = np.random.default_rng(7)
    far, centre = rng.normal(size=(6000, 32)), rng.normal(size=32) * 1.5
    x = np.concatenate([far, centre + 0.05 * rng.normal(size=(3000, 32))]).astype(np.float32)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND)
    asked = [*range(0, 6000, 300), *range(6000, 9000, 150)]
    got = {}
    for r in A.search(df, df.where(f"vec_id in ({','.join(map(str, asked))})"), short=64, sample=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(x, ids, asked, 20)
