import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewise.functions.vectors import cosine
from tilewise.operators import compare
from tilewise.plans.encoder import with_hidden_states


def states(spark, rows):
    return spark.createDataFrame(rows, "k int, layer int, b int, pos long, vec array<float>")


def test_cosine_is_that_of_numpy(spark):
    rng = np.random.default_rng(0)
    pairs = [(rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for _ in range(20)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").select(cosine("a", "b")).collect()]
    assert got == pytest.approx([np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for a, b in pairs])


def test_equal_states_have_similarity_1_and_a_zero_vector_0(spark):
    full = states(spark, [(0, 0, 0, p, [1.0, 2.0 + p]) for p in range(3)]).drop("k")
    same = compare.compare_layers(full.withColumn("k", F.lit(7)), full).first()
    assert same.sim == pytest.approx(1.0) and same.n == 3
    zero = compare.compare_layers(states(spark, [(1, 0, 0, p, [0.0, 0.0]) for p in range(3)]), full).first()
    assert zero.sim == 0.0


@pytest.mark.parametrize("have", [3, 5])
def test_other_shape_raises(spark, have):
    full = states(spark, [(0, 0, 0, p, [1.0]) for p in range(4)]).drop("k")
    with pytest.raises(Exception, match="shape"):
        compare.compare_layers(states(spark, [(1, 0, 0, p, [1.0]) for p in range(have)]), full).collect()


def test_a_variant_without_a_layer_raises(spark):
    full = states(spark, [(0, l, 0, 0, [1.0]) for l in range(2)]).drop("k")
    with pytest.raises(Exception, match="shape"):
        compare.compare_layers(states(spark, [(1, 0, 0, 0, [1.0])]), full).collect()


def test_each_step_against_the_one_before(spark):
    rows = compare.compare_incremental(states(spark, [(k, 0, 0, 0, [1.0, float(k)]) for k in (1, 2, 3)])).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3]
    assert compare.heatmap(compare.compare_incremental(states(spark, [(k, 0, 0, 0, [1.0]) for k in (1, 2)])), [0, 1]).first().asDict() == {"step": "1->2", "l0": 1.0, "l1": None}


def test_caches_are_cut_to_what_both_have(spark):
    kind = "k int, layer int, b int, head int, pos long, key array<float>, value array<float>"
    rows = [(1, l, 0, 0, p, [1.0, 0.0], [1.0, 1.0]) for l in (0, 1) for p in range(3)] + [(2, l, 0, 0, p, [1.0, 0.0], [0.0, 1.0]) for l in (0, 1, 2) for p in range(5)]
    got = compare.compare_kv(spark.createDataFrame(rows, kind)).orderBy("layer").collect()
    assert [(r.layer, r.n) for r in got] == [(0, 3), (1, 3)]
    assert got[0].key_sim == pytest.approx(1.0) and got[0].value_sim == pytest.approx(0.5**0.5)


def test_population_std_and_mean_of_means(spark):
    sims = spark.createDataFrame([(1, 0, x) for x in (1.0, 2.0, 3.0, 10.0)], "k int, layer int, sim double")
    s = compare.trial_stats(sims).first()
    assert s["mean"] == 4.0 and s["std"] == pytest.approx(3.535533905932738) and s.low == pytest.approx(4 - 3.535533905932738)
    kv = spark.createDataFrame([(2, 0, 1.0, 0.0), (2, 1, 0.5, 0.5)], "k int, layer int, key_sim double, value_sim double")
    assert tuple(compare.step_summary(kv).first()) == (2, 0.75, 0.25)


def test_encoder_boundary(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "vec array<float>")
    assert with_hidden_states(df).collect() == df.collect()
    got = with_hidden_states(df, lambda: lambda x: x * 2, width=2).collect()
    assert sorted(r.vec for r in got) == [[2.0, 4.0], [6.0, 8.0]]


def test_exploded_tables_are_not_broadcast(spark, tmp_path):
    """Spark doesn't count what explode adds, so it takes these tables for small ones."""
    from tilewise import queries as core

    spark.createDataFrame([(0, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = lambda name: core.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan("model_kv_similarity") and "BroadcastExchange" not in plan("model_kv_similarity")
    assert "SortMergeJoin" in plan("model_prefix_similarity")


def test_steps_that_a_cache_lacks(spark):
    row = lambda k, pos, x: (k, 0, 0, 0, pos, [x, 1.0], [1.0, x])
    rows = [row(1, 0, 1.0), row(2, 0, 1.0), row(2, 1, 5.0), row(4, 0, 2.0), row(5, 0, 2.0), row(5, 1, 5.0), (1, 0, None, 0, 0, [1.0], [1.0]), (2, 0, None, 0, 0, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "k int, layer int, b int, head int, pos long, key array<double>, value array<double>")
    assert {r.k: r.n for r in compare.compare_kv(df).collect()} == {2: 1, 5: 1}
