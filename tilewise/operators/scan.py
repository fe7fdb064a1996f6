"""Chunks of a sequence over many tasks: blocks as maps of lengths, composed by a prefix scan.

What a block of items does to an open chunk of length r is a map: with a first item that closes the chunk everything
after it goes its own way, whatever r was; without one the block's length is added. As r grows the first closing item
comes earlier, so the map is a list of lengths from which on an item is the first, with what follows from it.
Blocks are composed in groups, the groups' maps are walked in order, and then each group's blocks are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tilewise.operators.blocks import join_on
from tilewise.sources import tables

#: Blocks that are composed to one map.
FAN = 256


class Effect:
    """least: open lengths from which on something is the first to close, in order; closed, rest: chunks closed and length left open then; total: what is added below them."""

    __slots__ = ("closed", "least", "rest", "total")

    def __init__(self, least: np.ndarray, closed: np.ndarray, rest: np.ndarray, total: int):
        self.least, self.closed, self.rest, self.total = least, closed, rest, total

    def __call__(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks closed, length left open) for open lengths."""
        at = np.searchsorted(self.least, r, side="right") - 1
        if not len(self.least):
            return np.zeros(len(r), np.int64), r + self.total
        some = at >= 0
        return np.where(some, self.closed[at], 0), np.where(some, self.rest[at], r + self.total)

    def then(self, other: Effect) -> Effect:
        """The effect of this and another one after it."""
        more, rest = other(self.rest)
        edge = int(self.least[0]) if len(self.least) else None
        low = other.least - self.total  # where only the other one closes
        keep = low < edge if edge is not None else np.ones(len(low), bool)
        low, closed, left = low[keep], other.closed[keep], other.rest[keep]
        last = max(0, int((low <= 0).sum()) - 1)  # lengths aren't below 0
        low, closed, left = np.maximum(low[last:], 0), closed[last:], left[last:]
        return Effect(np.concatenate([low, self.least]), np.concatenate([closed, self.closed + more]), np.concatenate([left, rest]), self.total + other.total)

    def dump(self) -> bytes:
        return np.concatenate([[self.total], self.least, self.closed, self.rest]).astype(np.int64).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> Effect:
        x = np.frombuffer(raw, np.int64)
        return cls(*x[1:].reshape(3, -1), int(x[0]))


def _closings(lengths: np.ndarray, size: int) -> np.ndarray:
    """For a chunk that begins at each item, the item that closes it; how many there are, if none does."""
    upto = np.cumsum(lengths)
    return np.maximum(np.searchsorted(upto, upto - lengths + size, side="left"), np.arange(len(lengths)))


def effect(lengths: np.ndarray, size: int) -> Effect:
    """The effect of items on an open chunk."""
    n, upto, next_ = len(lengths), np.cumsum(lengths), _closings(lengths, size)
    closed, rest = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    total = int(upto[-1]) if n else 0
    for i in range(n - 1, -1, -1):
        if next_[i] < n:
            closed[i], rest[i] = closed[next_[i] + 1] + 1, rest[next_[i] + 1]
        else:
            rest[i] = total - upto[i] + lengths[i]
    first = np.flatnonzero(upto - lengths < size)[::-1] if size > 0 else np.arange(min(n, 1))  # items that may be the first to close
    least = np.maximum(size - upto[first], 0)
    # Of those that are first from the same length on, the earliest is; that is the last in this order.
    keep = np.append(np.diff(least) != 0, True) if len(least) else np.zeros(0, bool)
    first, least = first[keep], least[keep]
    return Effect(least, closed[first + 1] + 1, rest[first + 1], total)


def pieces(lengths: np.ndarray, size: int, open_: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """(first item, chunk) of the parts of chunks that a block has, of which the first goes on with a chunk of length open_."""
    upto, next_ = np.cumsum(lengths), _closings(lengths, size)
    starts, at = [0], int(np.searchsorted(upto, size - open_, side="left")) + 1
    while at < len(lengths):
        starts.append(at)
        at = int(next_[at]) + 1
    return np.array(starts), chunk + np.arange(len(starts))


def chunks(blocked: DataFrame, seq: str, size: int) -> DataFrame:
    """(seq, chunk, n_items, len, cache_len) of items in blocks (seq, _len, _block, _place)."""
    kind = blocked.schema[seq].dataType
    of = lambda *fields: StructType([StructField(seq, kind), *StructType.fromDDL(", ".join(fields)).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    name = to_arrow_schema(of("x int")).field(0)

    def lengths(table: pa.Table) -> np.ndarray:
        table = table.sort_by("_place")
        return table.column("_len").to_numpy()

    def mapped(table: pa.Table) -> pa.Table:
        x = lengths(table)
        return pa.table({seq: table.column(seq)[:1], "_block": table.column("_block")[:1], "_sum": [int(x.sum())], "_map": [effect(x, size).dump()]})

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("_nth")
        out = None
        for raw in table.column("_map"):
            e = Effect.load(raw.as_py())
            out = e if out is None else out.then(e)
        return pa.table({seq: table.column(seq)[:1], "_group": table.column("_group")[:1], "_map": [out.dump()]})

    def walk(at: str, begin: str | None):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(at)
            open_, chunk = (table.column("_open")[0].as_py(), table.column("_chunk")[0].as_py()) if begin else (0, 0)
            opens, firsts = [], []
            for raw in table.column("_map"):
                opens.append(open_)
                firsts.append(chunk)
                more, rest = Effect.load(raw.as_py())(np.array([open_]))
                open_, chunk = int(rest[0]), chunk + int(more[0])
            key = "_block" if begin else "_group"
            return pa.table({seq: table.column(seq), key: table.column(key), "_open": pa.array(opens, pa.int64()), "_chunk": pa.array(firsts, pa.int64())})

        return run

    def cut(table: pa.Table) -> pa.Table:
        x = lengths(table)
        starts, chunk = pieces(x, size, table.column("_open")[0].as_py(), table.column("_chunk")[0].as_py())
        ends = np.append(starts[1:], len(x))
        upto = table.column("_before")[0].as_py() + np.cumsum(x)
        owner = pa.array([table.column(seq)[0].as_py()] * len(starts), name.type)
        return pa.table({seq: owner, "chunk": pa.array(chunk, pa.int64()), "n": pa.array(ends - starts), "l": pa.array(np.add.reduceat(x, starts)), "u": pa.array(upto[ends - 1])})

    maps = blocked.groupBy(seq, "_block").applyInArrow(mapped, of("_block bigint", "_sum bigint", "_map binary"))
    order = Window.partitionBy(seq).orderBy("_block")
    before = F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    maps = maps.withColumn("_nth", F.row_number().over(order) - 1).withColumn("_before", before).withColumn("_group", F.floor(F.col("_nth") / FAN).cast("bigint"))
    maps = tables.save(maps, "maps")
    groups = maps.groupBy(seq, "_group").applyInArrow(composed, of("_group bigint", "_map binary"))
    begin = groups.groupBy(seq).applyInArrow(walk("_group", None), of("_group bigint", "_open bigint", "_chunk bigint"))
    inner = join_on(maps.select(seq, "_group", "_nth", "_block", "_map"), begin, [seq, "_group"])
    entry = inner.groupBy(seq, "_group").applyInArrow(walk("_nth", "_open"), of("_block bigint", "_open bigint", "_chunk bigint"))
    entry = join_on(entry, maps.select(seq, "_block", "_before"), [seq, "_block"])
    parts = join_on(blocked, entry, [seq, "_block"]).groupBy(seq, "_block").applyInArrow(cut, of("chunk bigint", "n bigint", "l bigint", "u bigint"))
    return parts.groupBy(seq, "chunk").agg(F.sum("n").alias("n_items"), F.sum("l").alias("len"), F.max("u").alias("cache_len"))
