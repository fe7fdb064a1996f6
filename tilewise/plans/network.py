"""A small fixed network for the model boundary: what a model returns, without a model's weights.

Inputs are 8 x 8 rasters, read as 8 positions of 8 numbers. Each layer is self-attention of two heads and a bounded
mixing, with weights from a formula; it returns, for each layer and position, the state, and for each layer, head and
position the key and the value. So masked inputs give other states at other positions too, as in a model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAYERS, HEADS, POSITIONS, WIDTH = 3, 2, 8, 8
_HEAD = WIDTH // HEADS
#: Numbers that a layer returns: states, keys and values of all positions.
_PER = 3 * POSITIONS * WIDTH


def _weights(layer: int, which: int) -> np.ndarray:
    i, j = np.mgrid[:WIDTH, :WIDTH]
    return np.sin(1.7 * i + 0.9 * j * (which + 1) + 2.3 * layer + which) / np.sqrt(WIDTH)


def forward(x: np.ndarray) -> np.ndarray:
    """(rows, 64) to (rows, LAYERS * 192): by layer its states, keys and values, each (8 positions, 8)."""
    h, out = np.asarray(x, np.float64).reshape(-1, POSITIONS, WIDTH), []
    for layer in range(LAYERS):
        q, k, v, o = (h @ _weights(layer, n) for n in range(4))
        split = lambda a: a.reshape(len(a), POSITIONS, HEADS, _HEAD).transpose(0, 2, 1, 3)
        score = split(q) @ split(k).transpose(0, 1, 3, 2) / np.sqrt(_HEAD)
        p = np.exp(score - score.max(-1, keepdims=True))
        mixed = (p / p.sum(-1, keepdims=True)) @ split(v)
        h = h + np.tanh(mixed.transpose(0, 2, 1, 3).reshape(h.shape) + o)
        out += [h, k, v]
    return np.concatenate([a.reshape(len(h), POSITIONS * WIDTH) for a in out], axis=1).astype(np.float32)


def run(df: DataFrame, vec: str = "vec", batch_size: int = 256) -> DataFrame:
    """df with ``_out``: what the network returns for each vector, in batches."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    model = predict_batch_udf(lambda: forward, return_type=ArrayType(FloatType()), batch_size=batch_size, input_tensor_shapes=[[POSITIONS * WIDTH]])
    return df.withColumn("_out", model(F.col(vec)))


def _part(what: int, head: bool):
    """A slice of a row's output: 0 the state, 1 the key, 2 the value, of a layer and position, or of a head there."""
    start = F.col("layer") * _PER + what * POSITIONS * WIDTH + F.col("pos") * WIDTH + (F.col("head") * _HEAD if head else F.lit(0)) + 1
    return F.slice("_out", start.cast("int"), _HEAD if head else WIDTH)


def _axis(name: str, n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)


def hidden_states(df: DataFrame, b: str = "b", k: str = "k") -> DataFrame:
    """(k, layer, b, pos, vec) of rows (k, b, vec): a row for each layer and position."""
    rows = run(df).select(F.col(k).alias("k"), F.col(b).alias("b"), "_out").select("*", _axis("layer", LAYERS)).select("*", _axis("pos", POSITIONS))
    return rows.select("k", "layer", "b", F.col("pos").cast("bigint").alias("pos"), _part(0, False).alias("vec"))


def kv_cache(df: DataFrame, length: str | None = None, b: str = "b", k: str = "k") -> DataFrame:
    """(k, layer, b, head, pos, key, value) of rows (k, b, vec); with a length column, only so many positions."""
    many = F.sequence(F.lit(0), F.least(F.col(length), F.lit(POSITIONS)) - 1) if length else F.sequence(F.lit(0), F.lit(POSITIONS - 1))
    rows = run(df).select(F.col(k).alias("k"), F.col(b).alias("b"), "_out", F.explode(many).alias("pos"))
    rows = rows.select("*", _axis("layer", LAYERS)).select("*", _axis("head", HEADS))
    return rows.select("k", "layer", "b", "head", F.col("pos").cast("bigint").alias("pos"), _part(1, True).alias("key"), _part(2, True).alias("value"))
