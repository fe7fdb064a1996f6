import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.llm import ngram_lm as N
from tilewise.llm import ngram_trie as T

DIR = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def rounded(p):
    """To the nearest 28th of a power of ten, 1 at most."""
    return 10.0 ** -(min(254, max(0, round(-math.log10(p) * 28))) / 28)


def brute(docs, shards=None):
    """{row: (n_tokens, n_known, N, base, score)} by plain dictionaries; docs: (id, text, train)."""
    said = [tokens(t) for _, t, _ in docs]
    count = Counter(w for s, d in zip(said, docs) if d[2] for w in s)
    total, distinct = sum(count.values()), len(count)
    place = {}
    for b in range(N.LEAST):
        known = sorted((w for w in count if zlib.crc32(w.encode()) * N.LEAST >> 32 == b), key=lambda w: (-count[w], w.encode()))
        place |= {w: N.FIRST + r * N.LEAST + b for r, w in enumerate(known)}

    def context(u, v):
        """What a word is told apart by after v: its class, which goes by the word before."""
        if not shards:
            return v
        number = lambda w: N.BEFORE if w is None else place.get(w, N.UNKNOWN)
        often = count[""] if v is None else count[v]
        return v, int(N.shard_of(*(np.array([x]) for x in (number(v), number(u), often)), total, shards)[0])

    three, two = defaultdict(Counter), defaultdict(Counter)
    for s, d in zip(said, docs):
        if d[2]:
            for u, v, w in zip([None, None, *s], [None, *s], s):
                two[context(u, v)][w] += 1
                three[u, v][w] += 1
    out = []
    for s in said:
        base = score = 0.0
        for u, v, w in zip([None, None, *s], [None, *s], s):
            p = (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            for c in (two[context(u, v)], three[u, v]):
                n = sum(c.values())
                if n:
                    p = (rounded((c[w] - 0.75) / n) if c[w] else 0.0) + rounded(0.75 * len(c) / n) * p
            score += math.log10(min(1.0, p))
        out.append((len(s), sum(count[w] > 0 for w in s), total, base, score))
    return out


def close(got, want):
    assert got[:3] == want[:3]
    assert got[3] == pytest.approx(want[3], rel=1e-9, abs=1e-9) and got[4] == pytest.approx(want[4], rel=1e-6, abs=1e-6)


def scored(df, train, **more):
    return [(r.doc_id, r.train, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in N.score(df, train, **more).collect()]


@pytest.mark.parametrize("shards", [1, None, 40])
def test_query_equals_brute_force(spark, shards):
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    want = {d[0]: (d[2], b) for d, b in zip(docs, brute(docs, {1: None, None: N.LEAST}.get(shards, shards)))}
    if shards is None:
        got = [(r.doc_id, not r.held_out, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in N.op11_lm_score(spark, DIR).collect()]
    else:
        df = spark.read.parquet(f"{DIR}/documents.parquet").repartition(3)
        got = scored(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, shards=shards)
    assert sorted(g[0] for g in got) == sorted(want)
    for doc, train, x in got:
        assert train == want[doc][0]
        close(x, want[doc][1])


def test_held_out_texts_score_above_the_base(spark):
    rows = [r for r in N.op11_lm_score(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > 1.05 * sum(r.base_score for r in rows)  # both are below zero


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977} of" for i in range(600_000)) + "  "
    docs = [(1, "The cat  SAT on the\tmat"), (1, "the cat sat"), (None, "the dog sat"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "Ünï\x0bçode a.b\x1c c"), (7, "x" * 1_500_000 + " the cat"), (8, "unknown words only")]
    kind = "doc_id long, text string, uid string, n_tokens int, train boolean"
    df = spark.createDataFrame([(*d, "x", 1, True) for d in docs], kind).repartition(2)
    rows = [(*d, d[0] not in (4, 8)) for d in docs]
    got = sorted(scored(df, F.coalesce(~F.col("doc_id").isin(4, 8), F.lit(True)), shards=1), key=str)
    want = sorted([(d[0], d[2], b) for d, b in zip(rows, brute(rows))], key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(sorted(got, key=lambda x: (str(x[:2]), x[2][0], x[2][3])), sorted(want, key=lambda x: (str(x[:2]), x[2][0], x[2][3]))):
        close(g[2], w[2])


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(scored(df, F.lit(False))) == [(1, False, (3, 0, 0, 0.0, 0.0)), (2, False, (1, 0, 0, 0.0, 0.0))]
    assert scored(df.limit(0), F.lit(True)) == []


@pytest.mark.parametrize("n,universe", [(0, 1), (1, 1), (6, 100), (900, 10**12), (900, 40), (70_000, 10**9)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    x = np.sort(r.integers(0, universe, n))
    code = T.EliasFano(*T.EliasFano.encode(x, universe))
    assert (code[np.arange(n)] == x).all()
    asked = np.concatenate([x, r.integers(-2, universe + 3, 500)])
    at, there = code.find(asked), np.isin(asked, x)
    assert ((at >= 0) == there).all() and (x[at[there]] == asked[there]).all()


def test_trie_in_a_file(tmp_path):
    r = np.random.default_rng(1)
    rows = np.unique(r.integers(0, 30, (2000, 3)), axis=0)
    count = r.integers(1, 9, len(rows))
    path = tmp_path / "levels"
    path.write_bytes(T.Trie.build(*rows.T, count))
    with path.open("rb") as f:
        trie = T.Trie.open(f)
    asked = np.array([(v, u, w) for v in range(32) for u in range(0, 33, 4) for w in range(33)])
    share3, rest3, share2, rest2 = trie.probabilities(*asked.T)
    for i, (v, u, w) in enumerate(asked.tolist()):
        after = {}
        for (a, b, c), n in zip(rows.tolist(), count.tolist()):
            if a == v:
                after.setdefault(b, {})[c] = n
        pair = after.get(u, {})
        single = Counter()
        for d in after.values():
            single.update(d)
        for share, rest, c in ((share3[i], rest3[i], pair), (share2[i], rest2[i], single)):
            n = sum(c.values())
            assert T.VALUES[share] == pytest.approx(rounded((c[w] - 0.75) / n) if w in c else 0.0)
            assert T.VALUES[rest] == pytest.approx(rounded(0.75 * len(c) / n) if n else 1.0)
        if i > 1500:
            break
