"""Request serving: bursts, batches, phases, latency metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewise.operators.blocks import HOT, join_on, percentiles, rank_in_groups, running_sum
from tilewise.sources import tables


def build_requests(spark: SparkSession, n: int, arrival: float) -> DataFrame:
    """A burst: ids 0..n-1 with one arrival; later phases haven't happened."""
    none = F.lit(None).cast("double")
    return spark.range(n).select(F.col("id").alias("req_id"), F.lit(float(arrival)).alias("arrival_time"), none.alias("start_time"), none.alias("first_token_time"), none.alias("end_time"))


def assign_batches(requests: DataFrame, size: int, by: Sequence[str] = (), order: Sequence[str] = ("arrival_time", "req_id"), hot: int = HOT) -> DataFrame:
    """Requests with ``batch``: slices of ``size`` in the given order, the last may be short. by: columns of a queue, each batched alone.

    A queue of more than ``hot`` requests is ranked in blocks.
    """
    return rank_in_groups(requests, by, order, "_rank", hot).withColumn("batch", F.floor(F.col("_rank") / size).cast("int")).drop("_rank")


def serve(batched: DataFrame, service: Column, by: Sequence[str], overhead: float = 1.01, prefill: float = 0.01, hot: int = HOT) -> DataFrame:
    """Times of serially run batches: start after all earlier ones, one first token and one end for each batch.

    service: a batch's seconds as an aggregate. The end covers a prefill and then a whole second call.
    """
    per = batched.groupBy(*by, "batch").agg(service.alias("_service"))
    per = running_sum(per, by, ["batch"], F.col("_service"), "_earlier", hot).withColumn("_wait", F.col("_earlier") * overhead).drop("_earlier")
    timed = join_on(batched, per, [*by, "batch"])
    start = F.col("arrival_time") + F.col("_wait")
    first = start + F.col("_service") * prefill
    return timed.select(*batched.columns, start.alias("start_time"), first.alias("first_token_time"), (first + F.col("_service")).alias("end_time"))


def request_metrics(requests: DataFrame, by: Sequence[str] = (), tokens: int = 20, hot: int = HOT) -> DataFrame:
    """Mean and 95th percentile of time to first token and latency, and throughput of nominal tokens; no time span: null.

    Percentiles are exact; those of a queue of more than ``hot`` requests are selected by histograms.
    """
    ttft = F.col("first_token_time") - F.col("arrival_time")
    latency = F.col("end_time") - F.col("arrival_time")
    rows = tables.save(requests.select(*by, ttft.alias("ttft"), latency.alias("latency"), "arrival_time", "end_time"), "requests")
    span = F.max("end_time") - F.min("arrival_time")
    means = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("ttft").alias("ttft_avg"), F.avg("latency").alias("latency_avg"), F.try_divide(F.count("*") * F.lit(float(tokens)), span).alias("throughput"))
    late = percentiles(rows, by, {"ttft_p95": F.col("ttft"), "latency_p95": F.col("latency")}, 0.95, hot)
    both = join_on(means, late, by) if by else means.crossJoin(late)  # a row each
    return both.select(*by, "n", "ttft_avg", "ttft_p95", "latency_avg", "latency_p95", "throughput")


def write_with_metrics(requests: DataFrame, path: str, tokens: int = 20, hot: int = HOT) -> dict[str, float | None]:
    """Write requests and return the metrics of the run: means and throughput come with the pass that writes, percentiles from what it wrote."""
    from pyspark.sql import Observation

    ttft, latency = F.col("first_token_time") - F.col("arrival_time"), F.col("end_time") - F.col("arrival_time")
    seen = Observation()
    span = F.max("end_time") - F.min("arrival_time")
    facts = [F.count("*").alias("n"), F.avg(ttft).alias("ttft_avg"), F.avg(latency).alias("latency_avg"), F.try_divide(F.count("*") * F.lit(float(tokens)), span).alias("throughput")]
    requests.observe(seen, *facts).write.parquet(path)
    late = percentiles(requests.sparkSession.read.schema(requests.schema).parquet(path), [], {"ttft_p95": ttft, "latency_p95": latency}, 0.95, hot).first()
    return {**seen.get, **late.asDict()}


#: The lines of a run's report, with the metric and digits of each.
BLOCK = (
    ("================ RESULTS ================", None, 0), ("TTFT AVG      : %s s", "ttft_avg", 4), ("TTFT P95      : %s s", "ttft_p95", 4), ("Latency AVG   : %s s", "latency_avg", 4),
    ("Latency P95   : %s s", "latency_p95", 4), ("Throughput    : %s tokens/s", "throughput", 2), ("=========================================", None, 0),
)


def metric_block(spark: SparkSession, metrics: dict[str, float | None]) -> DataFrame:
    """(no, line) of the report of a run's metrics; a metric that there is none of is told as null."""
    told = lambda m, digits: "null" if metrics[m] is None else f"{metrics[m]:.{digits}f}"
    return spark.createDataFrame([(i, text % told(m, digits) if m else text) for i, (text, m, digits) in enumerate(BLOCK)], "no int, line string")
