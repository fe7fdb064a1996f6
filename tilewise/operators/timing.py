"""Timing samples, gauges, trace spans and capture gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.operators.blocks import HOT, SIZE, before_blocks, in_blocks, join_on, split
from tilewise.sources import tables


def timing_summary(samples: DataFrame, by: Sequence[str], order: Sequence[str], warmup: int = 1, value: str = "elapsed_s") -> DataFrame:
    """(by, n, mean_ms) over the samples after each run's first ``warmup``. A run with no more than these has no row.

    Only the first samples are ranked, by limits that hold before the shuffle; the last of them is a run's border, and what
    is after it is added up. So warm-ups never enter a sum, whatever their size, and a hot run isn't sorted. Samples that
    tie with the border, in order and value, count as often as the warm-up leaves them. Null values count in n only.
    """
    by = list(by)
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))
    rows = samples.select(*by, at.alias("_at"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_at"))).where(F.col("_n") <= warmup)
    border = first.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("_at").alias("_border"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    v, after, tied = F.col("_at")["v"], F.col("_border").isNull() | (F.col("_at") > F.col("_border")), F.col("_at") == F.col("_border")
    sums = rows.join(border, same, "left").groupBy(*by).agg(
        F.count(F.when(after, 1)).alias("_after"), F.count(F.when(after, v)).alias("_m"), F.sum(F.when(after, v)).alias("_s"),
        F.count("*").alias("_all"), F.count(F.when(tied, 1)).alias("_tied"), F.max(F.col("_border")["v"]).alias("_v"),
    )
    left = F.when(F.col("_tied") > 0, F.col("_all") - warmup - F.col("_after")).otherwise(0)  # of the samples that tie with the border
    sums = sums.withColumn("n", F.col("_after") + left).withColumn("_left", F.when(F.col("_v").isNull(), 0).otherwise(left)).where("n > 0")
    total = F.coalesce("_s", F.lit(0.0)) + F.when(F.col("_left") > 0, F.col("_left") * F.col("_v")).otherwise(0.0)
    return sums.select(*by, "n", (F.try_divide(total, F.col("_m") + F.col("_left")) * 1000).alias("mean_ms"))


def gauge_readings(gauges: DataFrame, by: Sequence[str], order: Column, value: str = "bytes") -> DataFrame:
    """(by, current_gb, peak_gib): the last reading in decimal GB, the largest in GiB."""
    return gauges.groupBy(*by).agg((F.max_by(value, order) / 1e9).alias("current_gb"), (F.max(value) / 2**30).alias("peak_gib"))


def peak_since_reset(gauges: DataFrame, by: Sequence[str], is_reset: Column, ts: str = "ts", value: str = "bytes") -> DataFrame:
    """(by, peak): the largest value at or after the last reset of each group, of all values if there's none.

    Two aggregations that combine on the map side, so a hot group isn't gathered.
    """
    resets = gauges.where(is_reset).groupBy(*by).agg(F.max(ts).alias("_reset"))
    rest = gauges.where(~is_reset).join(resets, list(by), "left").where(F.col("_reset").isNull() | (F.col(ts) >= F.col("_reset")))
    return rest.groupBy(*by).agg(F.max(value).alias("peak"))


def first_after_enable(calls: DataFrame, enabled_at: Column, by: Sequence[str], order: Sequence[str], ts: str = "ts", once: bool = True) -> DataFrame:
    """Calls that a gate captures: of each process (by) the first at or after enabled_at, or with once=False all of them."""
    on = calls.where(F.col(ts) >= enabled_at)
    if not once:
        return on
    return on.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def span_pairs(trace: DataFrame, by: Sequence[str], order: Sequence[str], ts: str = "ts", hot: int = HOT, size: int = SIZE) -> DataFrame:
    """(by, name, start, end, depth) of nested ranges from push and pop events (op, name); an open range has no end.

    The depth is the number of open ranges; a push is closed by the next event of its depth. A trace of more than ``hot``
    events is worked on in blocks: inside a block pushes meet their pops; what is left, pops of earlier pushes and pushes
    without a pop yet, at most one of each for a block and depth, meets by depth.
    """
    cold, large = split(trace, by, hot)
    pairs = _pairs(cold, by, Window.partitionBy(*by).orderBy(*order), ts)
    if large is None:
        return pairs
    by = list(by)
    step = F.when(F.col("op") == "push", 1).otherwise(-1)
    rows = in_blocks(large, by, order, size)
    rows = join_on(rows, before_blocks(rows, by, F.sum(step), "_open"), [*by, "_block"])
    inside = Window.partitionBy(*by, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    after = F.col("_open") + F.sum(step).over(inside)
    deep = rows.withColumn("depth", F.when(F.col("op") == "push", after).otherwise(after + 1).cast("int"))
    level = Window.partitionBy(*by, "_block", "depth").orderBy("_place")
    deep = tables.save(deep.withColumn("_before", F.lag("op").over(level)).withColumn("_ts", F.lead(ts).over(level)), "events")
    push = F.col("op") == "push"
    met = deep.where(push & F.col("_ts").isNotNull())
    edges = deep.where(push & F.col("_ts").isNull() | ~push & F.col("_before").isNull())
    edges = edges.withColumn("_ts", F.lead(ts).over(Window.partitionBy(*by, "depth").orderBy("_block", "_place"))).where("op = 'push'")
    found = met.unionByName(edges).select(*by, "name", F.col(ts).alias("start"), F.col("_ts").alias("end"), "depth")
    return pairs.unionByName(found)


def _pairs(trace: DataFrame, by: Sequence[str], seq, ts: str) -> DataFrame:
    """Ranges of traces that each fit a window; seq: a trace in order."""
    up = F.col("op") == "push"
    deep = trace.withColumn("_after", F.sum(F.when(up, 1).otherwise(-1)).over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    deep = deep.withColumn("_at", F.row_number().over(seq)).withColumn("depth", F.when(up, F.col("_after")).otherwise(F.col("_after") + 1))
    level = Window.partitionBy(*by, "depth").orderBy("_at")
    closed = deep.withColumn("_op", F.lead("op").over(level)).withColumn("_ts", F.lead(ts).over(level))
    end = F.when(F.col("_op") == "pop", F.col("_ts"))
    return closed.where(up).select(*by, "name", F.col(ts).alias("start"), end.alias("end"), F.col("depth").cast("int").alias("depth"))


def named_parts(df: DataFrame, layer: str, parts: dict[str, str]) -> DataFrame:
    """(layer, name): a range's name for each layer and each part that df has a column for; parts: names, with the layer as {}.

    A part without a column is left out, as a model may lack it; with none of them there are no rows.
    """
    have = [name for column, name in parts.items() if column in df.columns]
    each = df.select(F.col(layer).alias("layer")).distinct()
    names = [F.concat(*[x for i, piece in enumerate(name.split("{}")) for x in ([F.col("layer")] if i else []) + [F.lit(piece)]]) for name in have]
    return each.select("layer", F.explode(F.array(*names)).alias("name")) if names else each.select("layer", F.lit("").alias("name")).limit(0)
