"""Sequences of items: chunks bounded in size, ordered concatenation, padding, lookup, tokens to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewise.operators import scan
from tilewise.operators.blocks import SIZE, in_blocks, split

#: Items of a sequence that are folded as one array.
HOT = 1 << 16


def greedy_chunks(items: DataFrame, size: int, seq: str = "seq_id", pos: str = "pos", length: str = "len", hot: int = HOT, block: int = SIZE) -> DataFrame:
    """(seq, chunk, n_items, len, cache_len): items in order, a chunk closed as soon as it has ``size`` or more; the tail stays.

    An item is never split; a null length is 0. cache_len is the length up to and with the chunk. A sequence of up to
    ``hot`` items is folded as one array. A longer one is cut into blocks, each of which is a map from the length that is
    open when it begins to the chunks that it closes and the length that it leaves open; see ``tilewise.operators.scan``.
    """
    rows = items.select(seq, F.col(pos).alias("_pos"), F.coalesce(F.col(length).cast("bigint"), F.lit(0)).alias("_len"))
    cold, large = split(rows, [seq], hot)
    ordered = cold.groupBy(seq).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("p"), F.col("_len").alias("l")))).alias("items"))
    chunk = "struct<n_items:bigint,len:bigint,cache_len:bigint>"
    fold = F.expr(f"""
        aggregate(items, named_struct('done', cast(array() as array<{chunk}>), 'n', 0L, 'len', 0L, 'all', 0L),
          (s, x) -> if(s.len + x.l >= {size},
            named_struct('done', array_append(s.done, named_struct('n_items', s.n + 1, 'len', s.len + x.l, 'cache_len', s.all + x.l)), 'n', 0L, 'len', 0L, 'all', s.all + x.l),
            named_struct('done', s.done, 'n', s.n + 1, 'len', s.len + x.l, 'all', s.all + x.l)),
          s -> if(s.n > 0, array_append(s.done, named_struct('n_items', s.n, 'len', s.len, 'cache_len', s.all)), s.done))
    """)
    folded = ordered.select(seq, F.posexplode(fold).alias("chunk", "c")).select(seq, F.col("chunk").cast("bigint").alias("chunk"), "c.n_items", "c.len", "c.cache_len")
    return folded if large is None else folded.unionByName(scan.chunks(in_blocks(large, [seq], ["_pos"], block), seq, size))


def concat_ordered(parts: DataFrame, by: Sequence[str], order: str, values: str) -> DataFrame:
    """(by, values): arrays joined end to end in an order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))))
    return parts.groupBy(*by).agg(F.flatten(F.transform(listed, lambda s: s.v)).alias(values))


def pad_batch(rows: DataFrame, batch: Sequence[str], tokens: str = "tokens", pad: str = "<pad>") -> DataFrame:
    """rows with tokens filled to the longest of their batch, and ``mask``: 1 for a token, 0 for filling."""
    n = F.size(tokens)
    longest = F.max(n).over(Window.partitionBy(*batch))
    fill = longest - n
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill))
    return rows.withColumn("mask", mask).withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(pad), fill)))


def embedding_lookup(tokens: DataFrame, table: DataFrame, token: str = "token_id", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """tokens with the vector of each; an unknown token raises nothing and has null."""
    return tokens.join(table.select(F.col(key).alias(token), vec), token, "left")


def penultimate(states: DataFrame, by: Sequence[str], layer: str, value: str) -> DataFrame:
    """(by, value): the value of the last layer but one; null with fewer than two."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(layer).desc()))
    last = states.select(*by, F.col(value).alias("_v"), back.alias("_n")).where("_n <= 2")  # limited below the shuffle
    return last.groupBy(*by).agg(F.max(F.when(F.col("_n") == 2, F.col("_v"))).alias(value))


def decode(tokens: Column | str, special: Sequence[str], limit: int | None = None, sep: str = " ") -> Column:
    """Text of the first ``limit`` tokens that aren't special."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    kept = F.filter(c, lambda t: ~t.isin(*special)) if special else c
    return F.array_join(F.slice(kept, 1, limit) if limit is not None else kept, sep)


def require(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has these columns; else an error that names the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
