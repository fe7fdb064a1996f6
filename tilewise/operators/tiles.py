"""Tiles of images: boxes, samples of tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tile_grid(images: DataFrame, rows: int = 5, cols: int = 5, id_col: str = "image_id", width: str = "width", height: str = "height") -> DataFrame:
    """Boxes of the rows x cols tiles of each image in row-major order; what integer sizes leave over is in no tile."""
    each = images.select(id_col, F.floor(F.col(width) / cols).cast("int").alias("tw"), F.floor(F.col(height) / rows).cast("int").alias("th"), F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("idx"))
    r, c = F.floor(F.col("idx") / cols).cast("int"), F.col("idx") % cols
    return each.select(
        id_col, "idx", r.alias("r"), c.alias("c"), (c * F.col("tw")).alias("left"), (r * F.col("th")).alias("upper"),
        ((c + 1) * F.col("tw")).alias("right"), ((r + 1) * F.col("th")).alias("lower"),
    )


def tile_sample(spark: SparkSession, ks: Sequence[int], trials: int = 10, tiles: int = 25) -> DataFrame:
    """(k, trial, idx): k of the tiles without replacement for each k and trial, the same on every run."""
    base = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    base = base.select("k", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).select("k", "trial", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("idx"))
    order = Window.partitionBy("k", "trial").orderBy(F.md5(F.concat_ws("-", "k", "trial", "idx")), "idx")
    return base.withColumn("n", F.row_number().over(order)).where("n <= k").select("k", "trial", "idx")


def tile_sets(sample: DataFrame) -> DataFrame:
    """(k, trial, tiles): a sample's tiles as a sorted array; as many rows as k's and trials."""
    return sample.groupBy("k", "trial").agg(F.array_sort(F.collect_list("idx")).alias("tiles"))


def sample_grid(images: DataFrame, k: int, tiles: int = 25, id_col: str = "image_id") -> DataFrame:
    """(id_col, idx): k of the tiles of each image without replacement, those with the least MD5 of image and tile; the same on every run.

    Tiles are ordered within the image's row, so nothing is sorted but rows of an array; images are counted, as of one
    that is there twice each tile is two rows of its group.
    """
    counted = images.groupBy(id_col).agg(F.count("*").alias("_n"))
    each = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda i: F.struct(F.md5(F.concat_ws("-", F.col(id_col), i).cast("binary")), i.alias("idx")))
    place = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i / F.col("_n")) < tiles)
    chosen = F.transform(place, lambda i: F.get("_order", F.floor(i / F.col("_n")).cast("int"))["idx"])
    return counted.select(id_col, "_n", F.array_sort(each).alias("_order")).select(id_col, F.explode(chosen).alias("idx"))


def sample_rows(df: DataFrame, by: Sequence[str], k: int, key: Column | str) -> DataFrame:
    """k rows of each group without replacement, those with the least MD5 of a key; all rows of a group that has no more.

    The same on every run. Each task keeps k rows a group before they are shuffled, so a hot group costs k rows a task.
    """
    text = F.col(key) if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(text.cast("string")), text))
    return df.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")
