"""Experiments as plans over embeddings read as 8 x 8 rasters: layer is the label, position the vec_id.

Masked variants of a row are compared within the row, so these plans shuffle aggregates only; the operators in
``operators.compare`` do the same for states that are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.functions.vectors import EPS, cosine, every_other, keep_prefix, tile_sums
from tilewise.operators.tiles import tile_sample, tile_sets

PREFIXES, SAMPLED = (1, 5, 10, 15, 20, 25), (1, 5, 10, 15, 20)


def _steps(df: DataFrame, ks: Sequence[int]) -> DataFrame:
    return df.select(F.col("label").alias("layer"), F.col("vec_id").alias("pos"), F.col("embedding").alias("full"), F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))


def hidden_states(embeddings: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, layer, b, pos, vec): states of the first k tiles."""
    return _steps(embeddings, ks).select("k", "layer", F.lit(0).alias("b"), "pos", keep_prefix("full", "k").alias("vec"))


def prefix_experiment(embeddings: DataFrame, ks: Sequence[int] = PREFIXES) -> DataFrame:
    """(k, layer, sim, n): states of the first k tiles against the full ones."""
    return _steps(embeddings, ks).groupBy("k", "layer").agg(F.avg(cosine(keep_prefix("full", "k"), "full")).alias("sim"), F.count("*").alias("n"))


def random_experiment(embeddings: DataFrame, ks: Sequence[int] = SAMPLED, trials: int = 10) -> DataFrame:
    """(k, trial, layer, sim): states of sampled tiles against the full ones. Samples are k's times trials rows: broadcast.

    A masked vector's product with the full one is the sum of squares over its tiles, so each row has 25 sums, and a set
    adds up its tiles' sums.
    """
    sets = tile_sets(tile_sample(embeddings.sparkSession, ks, trials))
    squares = tile_sums("embedding", lambda x: x * x)
    whole = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    each = embeddings.select(F.col("label").alias("layer"), squares.alias("squares"), whole.alias("whole")).crossJoin(F.broadcast(sets))
    kept = F.aggregate("tiles", F.lit(0.0), lambda s, t: s + F.get(F.col("squares"), t))
    return each.withColumn("kept", kept).groupBy("k", "trial", "layer").agg(F.avg(F.col("kept") / F.greatest(F.sqrt("kept") * F.sqrt("whole"), F.lit(EPS))).alias("sim"))


def incremental_experiment(embeddings: DataFrame, last: int = 25) -> DataFrame:
    """(k, layer, sim, n): states of k tiles against those of k - 1, for k from 2."""
    rows = _steps(embeddings, range(2, last + 1))
    return rows.groupBy("k", "layer").agg(F.avg(cosine(keep_prefix("full", F.col("k") - 1), keep_prefix("full", "k"))).alias("sim"), F.count("*").alias("n"))


def _positions(embeddings: DataFrame, last: int) -> DataFrame:
    """(layer, pos, full, first): the step from which on a cache of growing length has a position.

    Step k has all positions of a layer but the last ``last`` - k. Only a layer's last positions are ranked; there are
    fewer than layers times ``last``, so they are broadcast.
    """
    back = F.row_number().over(Window.partitionBy("label").orderBy(F.col("vec_id").desc()))
    tail = embeddings.select("label", "vec_id", back.alias("back")).where(F.col("back") < last)
    rows = embeddings.select("label", "vec_id", "embedding").join(F.broadcast(tail), ["label", "vec_id"], "left")
    first = F.greatest(F.lit(1), F.lit(last + 1) - F.coalesce("back", F.lit(last)))
    return rows.select(F.col("label").alias("layer"), F.col("vec_id").alias("pos"), F.col("embedding").alias("full"), first.alias("first"))


def kv_experiment(embeddings: DataFrame, last: int = 25) -> DataFrame:
    """(k, layer, key_sim, value_sim, n): caches of step k against those of k - 1 over the positions of both, within the row."""
    rows = _positions(embeddings, last).where(F.col("first") < last)
    rows = rows.select("layer", "full", F.explode(F.sequence(F.col("first") + 1, F.lit(last))).alias("k"))
    rows = rows.select("k", "layer", keep_prefix("full", F.col("k") - 1).alias("before"), keep_prefix("full", "k").alias("now"))
    sim = lambda odd: F.avg(cosine(every_other("before", odd), every_other("now", odd)))
    return rows.groupBy("k", "layer").agg(sim(False).alias("key_sim"), sim(True).alias("value_sim"), F.count("*").alias("n"))


def kv_cache(embeddings: DataFrame, last: int = 25, batch: int = 1, heads: int = 1) -> DataFrame:
    """(k, layer, b, head, pos, key, value): keys and values are the even and odd elements of the masked vector, a part of them each head.

    Rows are dealt to ``batch`` sequences by their id.
    """
    rows = _positions(embeddings, last).withColumn("k", F.explode(F.sequence(F.col("first"), F.lit(last))))
    rows = rows.withColumn("vec", keep_prefix("full", "k")).select("k", "layer", "pos", every_other("vec", False).alias("keys"), every_other("vec", True).alias("values"))
    rows = rows.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1)))).withColumn("n", F.floor(F.size("keys") / heads).cast("int"))
    part = lambda c: F.slice(c, F.col("head") * F.col("n") + 1, F.col("n"))
    return rows.select("k", "layer", (F.col("pos") % batch).cast("int").alias("b"), "head", "pos", part("keys").alias("key"), part("values").alias("value"))
