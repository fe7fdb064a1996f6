import hashlib
import random

import numpy as np
import pytest

from tilewise.llm import suffix_dedup as S


def brute(docs, n):
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], d)
    out = {}
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = True
        out[d] = bytes(b for b, g in zip(t, gone) if not g)
    return out


def kept(spark, rows, n=50):
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").repartition(5)
    out = S.remove_repeats(df, length=n)
    assert out.columns == df.columns
    return {r.doc_id: r.text for r in out.collect()}


def test_cover():
    assert {(a - b) % S.V for a in S.COVER for b in S.COVER} == set(range(S.V))


@pytest.mark.parametrize("seed, n, letters", [(0, 50, "ab"), (1, 50, "abcdefgh \n"), (2, 16, "ab"), (3, 64, "xyzé"), (4, 50, "a")])
def test_against_brute_force(spark, monkeypatch, seed, n, letters):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(n - 5, 3 * n))) for _ in range(8)]
    docs = []
    for d in range(60):
        parts = [rnd.choice(shared) if rnd.random() < 0.6 else "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 2 * n))) for _ in range(rnd.randrange(0, 5))]
        docs.append((d * 7 % 61, "".join(parts)))
    got = kept(spark, [(d, t, "x") for d, t in docs], n)
    want = brute([(d, t.encode()) for d, t in docs], n)
    assert got == {d: w.decode("utf-8", "replace") for d, w in want.items()}


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(S, "SORTED", 64)
    rnd = random.Random(5)
    base = bytes(rnd.choice(b"abcdef ") for _ in range(4000))
    docs = [(1, base), (2, base[500:2500] + b"|" + base[:700]), (3, b"q" * 300), (4, b"z" + b"q" * 300)]
    blobs = {}
    for d, raw in docs:
        parts = [(d, raw[a : a + 1000 + 49], a) for a in range(0, len(raw), 1000)]
        for bucket, blob in S._parts(parts, 50, 3):
            blobs.setdefault(bucket, []).append(blob)
    gone = {d: np.zeros(len(t), bool) for d, t in docs}
    for b in blobs.values():
        for doc, s, e in zip(*S._bucket(b, 50)):
            gone[int(doc)][s:e] = True
    want = brute(docs, 50)
    assert {d: bytes(c for c, g in zip(t, gone[d]) if not g) for d, t in docs} == want


def test_rows_of_all_kinds(spark):
    line = "a passage of more than fifty bytes that stands in several of the documents"
    rows = [(1, line, "k"), (2, f"before {line} after", "l"), (2, f"before {line} after", "m"), (3, None, None), (4, "", ""), (None, line, "n"), (5, line[:49], "o"), (6, "é" * 60, "p"), (7, "xé" + "é" * 60, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text, r._id) for r in S.remove_repeats(df).collect())
    want = [((False, 1), line, "k"), ((False, 2), "before  after", "l"), ((False, 2), "before  after", "m"), ((False, 3), None, None), ((False, 4), "", ""), ((False, 5), line[:49], "o"), ((False, 6), "é" * 60, "p"), ((False, 7), "x", "q"), ((True, 0), line, "n")]
    assert got == sorted(want, key=lambda r: r[0])


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(docs, 50)
    got = {r.doc_id: r for r in S.op6_suffix_dedup(spark, d).collect()}
    for k, t in docs:
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(t), len(t) - len(want[k]), hashlib.sha256(want[k]).hexdigest())
        assert r.n_spans == want_spans(docs, 50)[k]


def want_spans(docs, n, _kept={}):
    """The number of maximal removed runs of each document, by brute force."""
    if not _kept:
        first = {}
        for d, t in sorted(docs):
            for i in range(len(t) - n + 1):
                first.setdefault(t[i : i + n], d)
        for d, t in docs:
            gone = np.zeros(len(t) + 1, bool)
            for i in range(len(t) - n + 1):
                if first[t[i : i + n]] < d:
                    gone[i : i + n] = True
            _kept[d] = int((gone[1:] < gone[:-1]).sum())
    return _kept


def test_a_text_longer_than_a_chunk(spark):
    rnd = np.random.default_rng(0)
    base = "".join(map(chr, rnd.integers(97, 123, S.CHUNK + 500_000)))
    tail = "".join(map(chr, rnd.integers(65, 91, 3000)))
    got = kept(spark, [(1, base, "a"), (2, "#" + base[1000 : S.CHUNK + 100_000] + tail, "b"), (3, base[S.CHUNK - 60 : S.CHUNK + 60], "c")])
    assert got == {1: base, 2: "#" + tail, 3: ""}


def test_a_passage_in_every_document_and_rows_without_id(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = word(120)
    rows = [(d, word(30) + passage + word(30), "x") for d in range(400)]
    df = spark.createDataFrame(rows + [(None, passage, "n")] * 50, "doc_id long, text string, _id string").repartition(5)
    got = S.remove_repeats(df).collect()
    want = brute([(d, t.encode()) for d, t, _ in rows], 50)
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == {d: w.decode() for d, w in want.items()}
    assert [r.text for r in got if r.doc_id is None] == [passage] * 50


@pytest.mark.parametrize("n", [100, 136, 200])
def test_long_strings_against_brute_force(spark, n):
    rnd = random.Random(n)
    shared = ["".join(rnd.choice("abcdefgh ") for _ in range(4 * n)) for _ in range(6)]
    rows = [(d, "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(n))) + rnd.choice(shared)[rnd.randrange(n) :] + rnd.choice(shared), "x") for d in range(40)]
    want = brute([(d, t.encode()) for d, t, _ in rows], n)
    assert kept(spark, rows, n) == {d: w.decode() for d, w in want.items()}


def by_row(rows, n):
    """The kept bytes of rows (id, text): what a smaller id has goes, whatever rows of the same id have."""
    first = {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        for i in range(len(t) - n + 1):
            first.setdefault(t[i : i + n], d)
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = True
        out.append((d, bytes(b for b, g in zip(t, gone) if not g).decode()))
    return sorted(out)


def test_rows_of_one_id_keep_what_is_theirs(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    p, v = word(120), word(150)
    df = spark.createDataFrame([(1, p), (2, p + "tail"), (2, v)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in S.remove_repeats(df).collect()) == sorted([(1, p), (2, "tail"), (2, v)])
    shared = [word(rnd.randrange(40, 160)) for _ in range(6)]
    rows = [(rnd.randrange(12), "".join(rnd.choice(shared) if rnd.random() < 0.5 else word(rnd.randrange(90)) for _ in range(rnd.randrange(5)))) for _ in range(70)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((r.doc_id, r.text) for r in S.remove_repeats(df).collect()) == by_row([(d, t.encode()) for d, t in rows], 50)
