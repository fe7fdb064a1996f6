import pytest
from pyspark.sql import functions as F

from tilewise.operators import serving, timing


def test_batches_of_a_burst(spark):
    rows = serving.assign_batches(serving.build_requests(spark, 5, 1.0), 2).orderBy("req_id").collect()
    assert [r.batch for r in rows] == [0, 0, 1, 1, 2] and rows[0].start_time is None


def served(spark, rows):
    return spark.createDataFrame(rows, "req_id long, arrival_time double, start_time double, first_token_time double, end_time double")


def test_percentile_interpolates(spark):
    m = serving.request_metrics(served(spark, [(i, 0.0, 0.0, x, x) for i, x in enumerate((1.0, 2.0, 3.0, 10.0))])).first()
    assert m.ttft_p95 == pytest.approx(8.95) and m.ttft_avg == 4.0
    assert serving.request_metrics(served(spark, [(1, 0.0, 0.0, 3.0, 5.0)])).first().latency_p95 == 5.0


def test_nominal_throughput(spark):
    assert serving.request_metrics(served(spark, [(i, 0.0, 0.0, 1.0, 8.0) for i in range(4)])).first().throughput == 10.0
    assert serving.request_metrics(served(spark, [(1, 2.0, 2.0, 2.0, 2.0)])).first().throughput is None


def test_batches_run_one_after_another(spark):
    batched = serving.assign_batches(serving.build_requests(spark, 3, 0.0).select("req_id", "arrival_time"), 2).withColumn("q", F.lit(1)).withColumn("s", F.lit(2.0))
    rows = serving.serve(batched, F.max("s"), ["q"], overhead=1.0).orderBy("req_id").collect()
    assert [r.start_time for r in rows] == [0.0, 0.0, 2.0] and rows[2].first_token_time == pytest.approx(2.02) and rows[2].end_time == pytest.approx(4.02)


def test_warmup_is_left_out(spark):
    df = spark.createDataFrame([("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, 2.0), ("b", 0, 9.0)], "run string, iter int, elapsed_s double")
    assert [tuple(r) for r in timing.timing_summary(df, ["run"], ["iter"]).collect()] == [("a", 2, 1500.0)]


def test_peak_since_reset(spark):
    df = spark.createDataFrame([(1, 1, "m", 9.0), (1, 2, "reset", 0.0), (1, 3, "m", 4.0), (1, 4, "m", 6.0), (2, 1, "m", 3.0)], "p int, ts int, kind string, bytes double")
    assert {tuple(r) for r in timing.peak_since_reset(df, ["p"], F.col("kind") == "reset").collect()} == {(1, 6.0), (2, 3.0)}


def test_gate(spark):
    calls = spark.createDataFrame([(1, t) for t in (1, 2, 5, 6)], "p int, ts int")
    assert [r.ts for r in timing.first_after_enable(calls, F.lit(3), ["p"], ["ts"]).collect()] == [5]
    assert sorted(r.ts for r in timing.first_after_enable(calls, F.lit(3), ["p"], ["ts"], once=False).collect()) == [5, 6]


def test_spans(spark):
    trace = [(0, 1, "push", "A"), (0, 2, "push", "B"), (0, 3, "pop", None), (0, 4, "push", "C"), (0, 5, "pop", None), (0, 6, "pop", None), (1, 1, "push", "open")]
    got = timing.span_pairs(spark.createDataFrame(trace, "s int, ts int, op string, name string"), ["s"], ["ts"]).orderBy("s", "start").collect()
    assert [tuple(r)[1:] for r in got] == [("A", 1, 6, 1), ("B", 2, 3, 2), ("C", 4, 5, 2), ("open", 1, None, 1)]
