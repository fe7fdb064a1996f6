import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_sequences_text import brute_lcs
from tilewise.functions import text as T
from tilewise.operators import blocks, scan, sequences, serving, timing

HOT = dict(hot=50)


def queue(spark, n=4000):
    """A hot group of nearly all rows, some small ones and one without a name."""
    r = random.Random(1)
    rows = [(None if i % 97 == 0 else "hot" if i % 10 else f"q{i % 7}", r.randrange(n), i, r.choice([r.random(), 1.0, r.random() * 1e6])) for i in range(n)]
    return spark.createDataFrame(rows, "q string, at long, id long, v double").repartition(5)


def ranks(rows, keys):
    out = {}
    for r in sorted(rows, key=lambda r: [r[k] for k in keys]):
        out.setdefault(r.q, []).append(r.id)
    return {i: n for ids in out.values() for n, i in enumerate(ids)}


@pytest.mark.parametrize("size", [1 << 16, 64])
def test_ranks_equal_those_of_a_sort(spark, size):
    df = queue(spark)
    got = blocks.rank_in_groups(df, ["q"], ["at", "id"], hot=50, size=size).collect()
    assert {r.id: r["rank"] for r in got} == ranks(df.collect(), ["at", "id"]) and len(got) == 4000
    every = blocks.rank_in_groups(df, [], ["id"], hot=50, size=size).collect()
    assert sorted((r.id, r["rank"]) for r in every) == [(i, i) for i in range(4000)]


def test_blocks_are_small_and_tasks_even(spark):
    rows = blocks.in_blocks(queue(spark), ["q"], ["at", "id"], 64)
    sizes = [r["count"] for r in rows.groupBy("_block").count().collect()]
    assert max(sizes) <= 64 and sum(sizes) == 4000
    shares = [r["count"] for r in rows.groupBy(F.shiftright("_block", 33)).count().collect()]
    assert len(shares) == 4 and max(shares) < 2 * 4000 / 4  # the hot group is 88 % of the rows


def test_batches_of_a_hot_queue(spark):
    df = queue(spark)
    a = {r.id: r.batch for r in serving.assign_batches(df, 16, ["q"], ["at", "id"], **HOT).collect()}
    assert a == {r.id: r.batch for r in serving.assign_batches(df, 16, ["q"], ["at", "id"]).collect()}


def test_running_sums(spark):
    df = queue(spark)
    a, b = ({r.id: r.s for r in blocks.running_sum(df, ["q"], ["at", "id"], F.col("v"), "s", hot=h, size=32).collect()} for h in (50, 10**6))
    assert a == {k: pytest.approx(v, rel=1e-9) for k, v in b.items()}


ODD = [[1.0], [1.0, 2.0], [5.0] * 9000, [5.0] * 5000 + [6.0] * 5000, [-1.7e308, 1.7e308] * 3000 + [0.0], [float(2**i) for i in range(-1000, 1000)] * 4, [float("inf")] * 300 + [float("-inf")] * 5000 + [1.0] * 5000]


@pytest.mark.parametrize("values, p", [*[(v, 0.95) for v in ODD], (np.random.default_rng(0).lognormal(0, 4, 20_000).tolist(), 0.5)])
def test_percentiles_by_histograms(spark, values, p):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)] * 60 + [("c", 3.0)], "g string, v double").repartition(3)
    got = {r.g: r.x for r in blocks.percentiles(df, ["g"], {"x": F.col("v")}, p, hot=50).collect()}
    with np.errstate(all="ignore"):
        want = sorted(values)[int((len(values) - 1) * p)] if float("inf") in values else np.percentile(values, p * 100)
    assert got == {"a": pytest.approx(want), "b": None, "c": 3.0}


def test_metrics_of_a_hot_queue(spark):
    df = queue(spark).select("q", F.col("id").alias("req_id"), F.col("at").cast("double").alias("arrival_time"), (F.col("at") + F.col("v")).alias("first_token_time"), (F.col("at") + 2 * F.col("v")).alias("end_time"))
    for by in (["q"], []):
        a, b = (sorted([tuple(r) for r in serving.request_metrics(df, by, hot=h).collect()], key=str) for h in (50, 10**6))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert [pytest.approx(v) if isinstance(v, float) else v for v in y] == list(x)


def nested(n, seed):
    r = random.Random(seed)
    open_, rows = 0, []
    for i in range(n):
        push = open_ == 0 or r.random() < 0.5 + 0.3 * (i % 400 < 200) - 0.15
        open_ += 1 if push else -1
        rows.append((i, "push" if push else "pop", f"n{i}" if push else None))
    return rows


def test_spans_of_a_hot_trace(spark):
    rows = [("hot", *r) for r in nested(5000, 3)] + [(None, *r) for r in nested(300, 4)] + [("x", *r) for r in nested(20, 5)]
    rows += [("deep", i, "push" if i < 400 else "pop", f"d{i}" if i < 400 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "t string, ts long, op string, name string").repartition(6)
    got, want = (sorted([tuple(r) for r in timing.span_pairs(df, ["t"], ["ts"], hot=h, size=37).collect()], key=str) for h in (50, 10**6))
    assert got == want and len(got) == sum(r[2] == "push" for r in rows)


def loop(lengths, size):
    out, run, n, total = [], 0, 0, 0
    for x in lengths:
        run, n, total = run + x, n + 1, total + x
        if run >= size:
            out.append((n, run, total))
            run, n = 0, 0
    return [*out, (n, run, total)] if n else out


def test_chunks_of_a_long_sequence(spark):
    r = random.Random(2)
    rows = [(1, i, r.choice([0, 1, 2, 30, 64, 100, None])) for i in range(6000)] + [(2, i, 3) for i in range(20)] + [(None, i, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "seq_id long, pos long, len long").repartition(4)
    got = {}
    for x in sequences.greedy_chunks(df, 64, hot=50, block=41).orderBy("seq_id", "chunk").collect():
        got.setdefault(x.seq_id, []).append((x.n_items, x.len, x.cache_len))
    assert got == {s: loop([x[2] or 0 for x in rows if x[0] == s], 64) for s in (1, 2, None)}


@given(st.lists(st.integers(0, 12), max_size=60), st.lists(st.integers(0, 12), max_size=40), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_effects(a, b, size):
    one, two = (scan.effect(np.array(x, np.int64), size) for x in (a, b))
    both, whole = one.then(two), scan.effect(np.array(a + b, np.int64), size)
    for r in range(size):
        run, closed = r, 0
        for x in a + b:
            run += x
            if run >= size:
                run, closed = 0, closed + 1
        for e in (both, whole, scan.Effect.load(both.dump())):
            assert tuple(int(x[0]) for x in e(np.array([r]))) == (closed, run)


@given(st.lists(st.sampled_from("abcde"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90), st.integers(1, 20))
@settings(max_examples=150, deadline=None)
def test_lcs_in_blocks_and_steps(a, b, block):
    at = [0, 3, len(a) // 2, len(a), len(a) + 5]
    assert T.lcs_steps(b, a, at, block) == [brute_lcs(a[:n], b) for n in at]


def test_warm_ups_never_enter(spark):
    big = [1e17, float("inf"), float("nan"), None, -1e300]
    rows = [(f"r{i}", 0, w) for i, w in enumerate(big)] + [(f"r{i}", t, float(t)) for i in range(len(big)) for t in (1, 2)] + [("short", 0, 1.0), (None, 0, 5.0), (None, 1, 7.0)]
    rows += [("null", 0, 1.0), ("null", 1, None), ("null", 2, 4.0)] + [("one", t, float(t)) for t in range(3000)]
    df = spark.createDataFrame(rows, "run string, iter int, elapsed_s double").repartition(3)
    got = {r.run: (r.n, r.mean_ms) for r in timing.timing_summary(df, ["run"], ["iter"]).collect()}
    assert got == {**{f"r{i}": (2, 1500.0) for i in range(len(big))}, None: (1, 7000.0), "null": (2, 4000.0), "one": (2999, 1500_000.0)}


def test_warm_ups_that_tie(spark):
    df = spark.createDataFrame([("a", 0, 2.0)] * 4 + [("a", 1, 6.0)], "run string, iter int, elapsed_s double")
    assert [tuple(r) for r in timing.timing_summary(df, ["run"], ["iter"], warmup=3).collect()] == [("a", 2, 4000.0)]
    assert [tuple(r) for r in timing.timing_summary(df, ["run"], ["iter"], warmup=0).collect()] == [("a", 5, 2800.0)]


def test_numbers_as_text(spark):
    some = [0.125, 1.005, 2.675, -0.00001, -3.14159, 1234567.891, 0.0]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    got = [tuple(r) for r in df.select("x", T.fixed("x", 2), T.fixed("x", 4)).collect()]
    assert got == [(x, f"{x:.2f}", f"{x:.4f}") for x in some]
