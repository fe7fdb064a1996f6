"""Connected components of an edge table, all of it distributed.

Every partition first replaces its edges by a spanning forest. Alternating large-star and small-star rounds
(Kiveris et al., 2014) then turn what is left into stars around the smallest id; what is left of few edges, one more
forest. Each round is written to the shared folder; the driver sees one row of checksums a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch

#: Edges that a task holds at once while it builds a forest.
FOREST_EDGES = 1_000_000


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's is a node of its component, with itself as label) after edges a-b; the smallest index wins."""
    while True:
        x, y = label[a], label[b]
        live = x != y
        if not live.any():
            return label
        x, y = x[live], y[live]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges a-b: every other node, and the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    label = hook(np.arange(len(ids)), at[: len(a)], at[len(a) :])
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[other], ids[label[other]]


def _forests(batches):
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            u, v = forest(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held, n = [], 0
    if n:
        u, v = forest(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that isn't itself the smallest of its component; edges: two bigint columns.

    Edges with a null end and loops say nothing and are left out. No edges: no rows.
    """
    e = edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v")
    e = scratch.save(e.mapInArrow(_forests, "u bigint, v bigint").distinct(), "forest")
    if e.count() < FOREST_EDGES:  # no more than any task holds, so one may finish them
        stars = scratch.save(e.coalesce(1).mapInArrow(_forests, "u bigint, v bigint"), "star")
        scratch.drop(e)
        return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.union(least).distinct(), "star")
        scratch.drop(e)
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
