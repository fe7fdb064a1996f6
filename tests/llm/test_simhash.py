import re

import numpy as np
import pytest
import xxhash

from tilewise.llm import simhash as S
from tilewise.llm.components import components, hook


def plain(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t\n", "one", "One TWO", "a b c", "a b c d", "É é\u00a0x\u2003y z", "x " * 500, "the cat\x0bsat on\x0cthe mat " * 30, "ÀB Cd " * 7]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert S.simhash(text) == plain(text)


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000))
    want = S.simhash(text)
    monkeypatch.setattr(S, "TEXT_BLOCK", 50)
    assert S.simhash(text) == want == plain(text)


def crowd(n, rng):
    base = rng.integers(0, 2**63, max(1, n // 4), dtype=np.uint64)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(len(base))])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize("n", [1, 2, 5, 300, 2000])
@pytest.mark.parametrize("budget", [0, 3, 6])
def test_walk_finds_what_all_pairs_do(n, budget):
    a = crowd(n, np.random.default_rng(n))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= budget)
    assert (S.walk(a, None, budget) == hook(np.arange(len(a)), i, j)).all()
    h = len(a) // 2
    if h:
        across = (i < h) != (j < h)
        assert (S.walk(a[:h], a[h:], budget) == hook(np.arange(len(a)), i[across], j[across])).all()


def test_walk_in_a_dense_crowd_and_small_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    a = np.unique(np.array([int(np.bitwise_xor.reduce(1 << rng.integers(0, 20, 6))) for _ in range(3000)], dtype=np.uint64))
    monkeypatch.setattr(S, "BLOCK", 256)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    assert (S.walk(a, None, 3) == hook(np.arange(len(a)), i, j)).all()


def test_links_with_deep_cuts(spark):
    rng = np.random.default_rng(1)
    a = np.concatenate([crowd(400, rng), (np.uint64(0xABCDEF) << np.uint64(40)) | rng.integers(0, 64, 200, dtype=np.uint64)])
    a = np.unique(a)
    df = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(a)], "fp long, rep long")
    found = dict(map(tuple, components(S.links(df, 3, node=20)).collect()))
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    want = hook(np.arange(len(a)), i, j)
    assert [found.get(k, k) for k in range(len(a))] == want.tolist()


def test_rows_of_all_kinds(spark):
    rows = [(5, "same text here", 1), (3, "same text here", 2), (3, "same text here", 2), (None, "same text here", 3), (7, None, 4), (6, "", 5), (None, "only this one", 6), (9, "x " * 3000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    by = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert {(3, 3), (5, 3), (6, 6), (7, 6), (9, 9), (None, 3), (None, None)} == by


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(4, None)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    label = {x: x for e in edges for x in e if x is not None}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert {k: v for k, v in label.items() if k != v} == got


def test_query_against_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = sorted(texts)
    fp = np.array([plain(texts[i]) for i in ids], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    label = hook(np.arange(len(ids)), i, j)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, d).collect()}
    assert got == {k: (f"{int(f):016x}", ids[l]) for k, f, l in zip(ids, fp, label)}


def test_components_of_more_edges_than_a_task_holds(spark, monkeypatch):
    from tilewise.llm import components as K

    monkeypatch.setattr(K, "FOREST_EDGES", 1)
    edges = [(i, i + 1) for i in range(50) if i % 10 != 9]
    got = dict(map(tuple, K.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()))
    assert got == {i: i // 10 * 10 for i in range(50) if i % 10}
