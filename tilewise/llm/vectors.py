"""What the operators on embeddings share: rows that take part, copies, and vectors as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vec: str) -> Column:
    """Whether a vector is there, has only finite components and isn't all zeros."""
    c = F.col(vec)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(c.isNotNull() & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))


def distinct(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec, rep, n): each vector that takes part once, its smallest id, and its rows; rows with a null id are left out."""
    rows = df.where(takes_part(vec_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("vec"))
    return rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows of ``dim`` doubles; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
