"""Comparison of layer-wise vectors: to a baseline, to the step before, key and value caches.

Hidden states are long tables (k, layer, b, pos, vec), caches (k, layer, b, head, pos, key, value): a row a vector.
Similarity is the mean of cosines of aligned vectors, by (k, layer).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.functions.vectors import cosine


def compare_layers(variants: DataFrame, full: DataFrame, check: bool = True) -> DataFrame:
    """(k, layer, sim, n) of each variant against the baseline by equal (layer, b, pos).

    A variant that lacks a position of the baseline, or has one more, raises. Both sides are shuffled by position once;
    the check counts rows of aggregates only.
    """
    base = full.select("layer", "b", "pos", F.col("vec").alias("full_vec"))
    joined = variants.join(base.hint("merge"), ["layer", "b", "pos"], "left")  # Spark takes exploded tables for small ones
    sim = joined.groupBy("k", "layer").agg(F.avg(cosine("vec", "full_vec")).alias("sim"), F.count("full_vec").alias("n"), F.count("*").alias("have"))
    if not check:
        return sim.select("k", "layer", "sim", "n")
    need = full.groupBy("layer").agg(F.count("*").alias("need"))
    steps = variants.select("k").distinct()
    both = steps.crossJoin(F.broadcast(need)).join(sim, ["k", "layer"], "full_outer")  # a row for each step and layer
    fits = F.coalesce((F.col("need") == F.col("n")) & (F.col("need") == F.col("have")), F.lit(False))
    sim_ = F.when(fits, F.col("sim")).otherwise(F.raise_error(F.lit("variant and baseline differ in shape")).cast("double"))
    return both.select("k", "layer", sim_.alias("sim"), "n")


def compare_incremental(states: DataFrame) -> DataFrame:
    """(k, layer, sim, n) of each step against the one before it; the first step has none."""
    order = Window.partitionBy("layer", "b", "pos").orderBy("k")
    pairs = states.select("k", "layer", "vec", F.lag("vec").over(order).alias("before")).where("before is not null")
    return pairs.groupBy("k", "layer").agg(F.avg(cosine("before", "vec")).alias("sim"), F.count("*").alias("n"))


def compare_kv(cache: DataFrame) -> DataFrame:
    """(k, layer, key_sim, value_sim, n) of step k against k - 1 over the positions and layers that both have.

    Steps of a position meet in a window, which has a row a step: a cache is shuffled once and never broadcast.
    """
    at = ["layer", "b", "head", "pos"]
    order = Window.partitionBy(*at).orderBy("k")
    known = cache.where(" and ".join(f"{c} is not null" for c in at))
    steps = known.select("k", "layer", "key", "value", *[F.lag(c).over(order).alias(f"{c}0") for c in ("k", "key", "value")])
    pairs = steps.where("k0 = k - 1")
    return pairs.groupBy("k", "layer").agg(F.avg(cosine("key0", "key")).alias("key_sim"), F.avg(cosine("value0", "value")).alias("value_sim"), F.count("*").alias("n"))


def last_layer(sims: DataFrame) -> DataFrame:
    """(k, sim): similarity of the last layer of each k."""
    return sims.groupBy("k").agg(F.max_by("sim", "layer").alias("sim"))


def step_summary(kv: DataFrame) -> DataFrame:
    """(k, key_sim, value_sim): means over layers of layer means."""
    return kv.groupBy("k").agg(F.avg("key_sim").alias("key_sim"), F.avg("value_sim").alias("value_sim"))


def trial_stats(sims: DataFrame) -> DataFrame:
    """(k, layer, mean, std, low, high) over trials; std is the population's."""
    stats = sims.groupBy("k", "layer").agg(F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"))
    return stats.select("k", "layer", "mean", "std", (F.col("mean") - F.col("std")).alias("low"), (F.col("mean") + F.col("std")).alias("high"))


def heatmap(sims: DataFrame, layers: Sequence[int] | None = None, value: str = "sim", prefix: str = "l") -> DataFrame:
    """(step, l0, l1, ...): a row for each step, labelled 'k-1->k', a column for each layer, in order.

    Without a list of layers they are those of sims: a model's layers, a name each on the driver, as columns are.
    """
    if layers is None:
        layers = sorted(r[0] for r in sims.select("layer").distinct().where("layer is not null").collect())
    named = sims.select(F.concat_ws("->", F.col("k") - 1, F.col("k")).alias("step"), F.concat(F.lit(prefix), F.col("layer")).alias("layer"), value)
    return named.groupBy("step").pivot("layer", [f"{prefix}{x}" for x in layers]).agg(F.first(value))


def series(sims: DataFrame, by: str = "layer", key: str = "k", value: str = "sim") -> DataFrame:
    """(by, series): a map from each key to its value, in the order of the keys; look-ups of other keys give null."""
    return sims.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("series"))
