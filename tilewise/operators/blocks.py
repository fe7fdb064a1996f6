"""Order within groups of any size: ranks, running sums and exact percentiles without a window over a whole group.

Groups of up to ``HOT`` rows are windows as usual. The rows of larger ones are sorted by range over group and order and
written in blocks; a block's rows are worked on together, and what has gone before it is a sum over blocks. A range holds
an even share of the rows, whatever the groups are, as long as their order has distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.sources import tables

#: Rows of a group that one task may sort; rows of a block; bins of a histogram; rows of a bin that are sorted.
HOT, SIZE, BINS, FEW = 1 << 20, 1 << 16, 1024, 4096


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null equals null; right's other columns are added."""
    named = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = left.join(named, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_of_{k}" for k in keys])


def split(df: DataFrame, by: Sequence[str], hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """df's rows of groups of at most ``hot`` rows, and those of larger groups; None if there are none. Groups are counted."""
    large = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    if large.isEmpty():
        return df, None
    if not by:
        return df.limit(0), df
    large = tables.save(large.drop("_n"), "large")
    return join_on(df, large, by, "left_anti"), join_on(df, large, by, "left_semi")


def in_blocks(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], size: int = SIZE) -> DataFrame:
    """df, written, with ``_block``, which grows along the order, and ``_place``, the row's place in its block.

    A block has at most ``size`` rows; where groups meet it has rows of several, so a group's blocks are named by both.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*by, *order]
    row = F.monotonically_increasing_id()
    rows = df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).withColumn("_row", row)
    at = F.col("_row").bitwiseAND((1 << 33) - 1)
    block = F.shiftleft(F.shiftright("_row", 33), 33) + F.floor(at / size)
    return tables.save(rows.withColumn("_block", block.cast("bigint")).withColumn("_place", (at % size).cast("int")).drop("_row"), "blocks")


def before_blocks(blocked: DataFrame, by: Sequence[str], total: Column, name: str) -> DataFrame:
    """(by, _block, name): the sum of an aggregate over a group's earlier blocks; a row for each of its blocks."""
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(*by, "_block").agg(total.alias("_total"), F.min("_place").alias("_first"))
    return sums.withColumn(name, F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")


def rank_in_groups(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str = "rank", hot: int = HOT, size: int = SIZE) -> DataFrame:
    """df with each row's place in its group, from 0; rows that tie in the order have some order."""
    cold, large = split(df, by, hot)
    ranked = cold.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("bigint"))
    if large is None:
        return ranked
    rows = in_blocks(large, by, order, size)
    known = join_on(rows, before_blocks(rows, by, F.count("*"), "_before"), [*by, "_block"])
    return ranked.unionByName(known.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first")).select(ranked.columns))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, name: str, hot: int = HOT, size: int = SIZE) -> DataFrame:
    """df with the sum of a value over the rows of its group before each row; 0 for the first."""
    cold, large = split(df, by, hot)
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cold.withColumn(name, F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    if large is None:
        return summed
    rows = in_blocks(large.withColumn("_value", value), by, order, size)
    known = join_on(rows, before_blocks(rows, by, F.sum("_value"), "_before"), [*by, "_block"])
    inside = Window.partitionBy(*by, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return summed.unionByName(known.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).select(summed.columns))


def percentiles(df: DataFrame, by: Sequence[str], values: dict[str, Column], p: float, hot: int = HOT) -> DataFrame:
    """(by, a column for each name of values): exact percentiles that interpolate linearly, nulls aside. A row for each group.

    Groups of more than ``hot`` rows are selected from by histograms: counts of bins between the least and the largest
    value show the bin that has the rank; its own least and largest value bound the next histogram, until few rows are
    left. A task sums rows to bins before they are shuffled, and the driver sees how many groups are undecided.
    """
    cold, large = split(df, by, hot)
    out = cold.groupBy(*by).agg(*[F.percentile(v.cast("double"), p).alias(n) for n, v in values.items()])
    if large is None:
        return out
    if not by:  # one row for all rows, not one more for none
        out = out.limit(0)
    large = tables.save(large.select(*by, *[v.cast("double").alias(n) for n, v in values.items()]), "large")
    groups = large.select(*by).distinct() if by else large.sparkSession.range(1).drop("id")
    for n in values:
        found = _selected(large.select(*by, F.col(n).alias("_v")).where("_v is not null"), by, p, n)
        groups = join_on(groups, found, by, "left") if by else groups.join(found, how="left")
    return out.unionByName(groups.select(out.columns))


def _selected(rows: DataFrame, by: Sequence[str], p: float, name: str) -> DataFrame:
    """(by, name): the percentile of _v in each group of rows (by, _v)."""
    low, high = F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    state = rows.groupBy(*by).agg(F.count("*").alias("_inside"), low, high).where("_inside > 0")
    state = tables.save(state.withColumn("_rank", F.floor((F.col("_inside") - 1) * p)).withColumn("_rest", (F.col("_inside") - 1) * p - F.col("_rank")).withColumn("_below", F.lit(0).cast("bigint")), "ranks")
    known, undecided = [*by, "_rank", "_rest"], (F.col("_lo") < F.col("_hi")) & (F.col("_inside") > FEW)
    while not state.where(undecided).isEmpty():
        held = join_on(rows, state.where(undecided), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves don't overflow
        inner = F.when(share.between(0, 1), F.least(F.lit(BINS - 1), F.floor(share * BINS))).otherwise(BINS // 2)
        bin_ = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), BINS - 1).otherwise(inner).cast("int")
        bins = held.groupBy(*known, "_below", bin_.alias("_bin")).agg(F.count("*").alias("_inside"), low, high)
        upto = Window.partitionBy(*by).orderBy("_bin")
        bins = bins.withColumn("_upto", F.col("_below") + F.sum("_inside").over(upto)).withColumn("_below", F.col("_upto") - F.col("_inside"))
        chosen = bins.where((F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto")))
        state = tables.save(state.where(~undecided).unionByName(chosen.select(state.columns)), "ranks")
    held = join_on(rows, state, by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_v"))
    few = held.where((F.col("_lo") < F.col("_hi")) & (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).withColumn("_n", place)
    at = few.where(F.col("_n") == F.col("_rank") - F.col("_below") + 1).select(*known, F.col("_v").alias("_x"))
    at = tables.save(at.union(state.where(F.col("_lo") == F.col("_hi")).select(*known, F.col("_lo").alias("_x"))), "ranks")
    after = join_on(rows, at, by).groupBy(*known, "_x").agg(F.count(F.when(F.col("_v") <= F.col("_x"), 1)).alias("_upto"), F.min(F.when(F.col("_v") > F.col("_x"), F.col("_v"))).alias("_next"))
    second = F.when(F.col("_upto") > F.col("_rank") + 1, F.col("_x")).otherwise(F.col("_next"))
    return after.select(*by, F.when(F.col("_rest") == 0, F.col("_x")).otherwise(F.col("_x") * (1 - F.col("_rest")) + second * F.col("_rest")).alias(name))
