import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewise.llm import mixing as M
from tilewise.llm import sharding as H


def filled(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by repeating the sharing until none is above its limit."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    out, free = {}, set(names)
    while True:
        level = (share * sum(sizes.values()) - sum(out.values())) / max(1e-300, sum(w[k] for k in free)) if free else 0
        over = [k for k in free if level * w[k] >= most * sizes[k]]
        if not over:
            return out | {k: level * w[k] for k in free}
        for k in over:
            out[k] = most * sizes[k]
            free.discard(k)


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_sums(spark, seed):
    rnd = random.Random(seed)
    names = ["b", "a", "Z", "é", "", None, "zz"]
    rows = [(i, " ".join(["w"] * int(rnd.lognormvariate(3, 1))), rnd.choices(names, [30, 3, 3, 3, 1, 2, 3])[0]) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = M.copies(df, seed=seed).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = filled(sizes)
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r["size"] * r.copies for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
        ratio = want[s] / sizes[s]
        assert all(int(ratio - 1e-9) <= r.copies <= int(ratio - 1e-9) + 1 for r in mine if r["size"])
    assert sorted(map(str, got)) == sorted(map(str, M.copies(df.repartition(5), seed=seed).collect()))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    sizes = Counter()
    for r in docs:
        sizes[r.source] += size[r.doc_id]
    want, source = filled(sizes), {r.doc_id: r.source for r in docs}
    got = M.op9_mixing(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r["size"], r.source_size) == (size[r.doc_id], sizes[s]) and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)


def test_a_large_document_is_settled_first(spark):
    rows = [(i, "w " * n, "s") for i, n in enumerate([5000, 4000, 1200, *range(1, 90)])] + [(1000 + i, "w " * 30, "t") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    picks = Counter()
    for seed in range(3):
        got = M.copies(df, weights=(1, 1), share=0.6, seed=seed).where("source = 's'").collect()
        assert abs(sum(r["size"] * r.copies for r in got) - got[0].target) <= 60
        picks += Counter(r.doc_id for r in got if r.doc_id < 2 and r.copies)
    assert 0 < sum(picks.values()) < 6


def test_units_of_very_many_rows(spark):
    df = spark.range(5_000_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("source"))
    got = M.copies(df, share=0.3, weights=(1,)).agg(F.count("*"), F.sum("copies"), F.max("copies")).first()
    assert tuple(got) == (5_000_000, 1_500_000, 1)
    some = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("source"), F.col("id").alias("n"))
    assert M.mix(some, share=0.3, weights=(1,)).agg(F.count("*"), F.countDistinct("n")).first()[:] == (90_000, 90_000)


def test_many_equal_rows_and_rows_without_id(spark):
    rows = [(None, "a b c", "x")] * 3000 + [(7, "d e", "x")] * 10_000 + [(i, "w " * (i % 9), "y") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = M.copies(df, share=0.9, weights=(1, 1)).collect()
    assert len(got) == len(rows)
    for s in "xy":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) <= 4.5
    hot = [r.copies for r in got if r.doc_id == 7 and r.source == "x"]
    assert max(hot) - min(hot) <= 1 and len(hot) == 10_000
    assert M.mix(df, share=0.9, weights=(1, 1)).count() == sum(r.copies for r in got)


def test_every_document_keeps_its_probability(spark):
    rows = [(i, "w " * (1 + i), "s" if i < 8 else "t") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [M.copies(df, weights=(1, 1), share=0.5, seed=s).where("source = 's'").collect() for s in range(12)]
    p = runs[0][0].target / runs[0][0].source_size
    mean = sum(r.copies for run in runs for r in run) / sum(map(len, runs))
    assert abs(mean - p) < 0.2


def test_words(spark):
    texts = [None, "", "  \t\n\x0b\x0c\r ", "a", " a  b\nc ", "é\u00a0x y", "x " * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(M.words("text")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_rows_of_all_kinds(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (1, "a b c d", "x", 2), (None, "q r s", None, 3), (2, None, "x", 4), (3, "", None, 5), (4, "w " * 5000, "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    assert M.copies(df).count() == len(rows)
    out = M.mix(df)
    assert out.columns == df.columns and set(out.collect()) <= set(df.collect())
    counts, taken = M.copies(df).collect(), out.collect()
    assert sum(r.copies for r in counts) == len(taken)
    assert M.copies(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0


def test_table_is_even_and_stable():
    a, b = H.fill(H.SHARDS), H.fill(H.SHARDS[:-1])
    n = Counter(a)
    assert max(n.values()) - min(n.values()) <= 1 and set(a) == set(range(64))
    moved = sum(x != y for x, y in zip(a, b) if x != 63)
    assert moved / len(a) < 0.1
    with pytest.raises(ValueError):
        H.fill(["a"], 4)


@pytest.mark.parametrize("names, slots", [(["a"], 7), (["a", "b", "c"], 31), ([f"n{i}" for i in range(13)], 211)])
def test_fill_by_whole_permutations(names, slots):
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    order = [[(number(f"start {n}") % slots + i * (number(f"skip {n}") % (slots - 1) + 1)) % slots for i in range(slots)] for n in names]
    assert all(sorted(o) == list(range(slots)) for o in order)
    owner, turn = {}, 0
    while len(owner) < slots:
        owner[next(s for s in order[turn % len(names)] if s not in owner)] = turn % len(names)
        turn += 1
    assert H.fill(names, slots) == [owner[s] for s in range(slots)]


def test_very_long_keys(spark):
    df = spark.createDataFrame([("k" * 300_000,), ("k" * 300_000,), ("k" * 299_999,)], "k string")
    rows = H.place(df, "k").collect()
    assert {(len(r.k), r.slot) for r in rows} == {(n, H._number("k" * n) % H.SLOTS) for n in (300_000, 299_999)}


def test_placement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k long, shard string")
    got = H.place(df, "k").collect()
    table = H.fill(H.SHARDS)
    for r in got:
        slot = H._number("" if r.k is None else str(r.k)) % H.SLOTS
        assert (r.slot, r.shard) == (slot, H.SHARDS[table[slot]])
    assert len(got) == 4 and H.place(df.limit(0), "k").count() == 0
