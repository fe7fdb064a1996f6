"""A vocabulary with dense ids, and texts to ids and back.

Ids are the places of the tokens in order: a range of tokens is numbered within, and the ranges before it are counted, so
no task sees all tokens. Looking ids up is an equi-join of a sequence's distinct tokens, each once a sequence. What is
found comes back as arrays and is put in its places by a dictionary of the row, as a look-up in a map of Spark is a scan
of its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from tilewise.functions.text import by_rows
from tilewise.operators.blocks import HOT, rank_in_groups
from tilewise.sources import tables


def build(sequences: DataFrame, tokens: str = "tokens", special: Sequence[str] = ("<pad>",), hot: int = HOT) -> DataFrame:
    """(token, id, special) of all distinct tokens of arrays: special ones have the first ids, the others follow by code point.

    Null tokens have no id. What is special may not be a token of the texts too: it then keeps its first id.
    """
    spark = sequences.sparkSession
    words = sequences.select(F.explode(F.array_distinct(tokens)).alias("token")).distinct().where(F.col("token").isNotNull() & ~F.col("token").isin(*special))
    ranked = rank_in_groups(words, [], ["token"], "id", hot).select("token", (F.col("id") + len(special)).alias("id"), F.lit(False).alias("special"))
    first = spark.createDataFrame([(t, i, True) for i, t in enumerate(special)], "token string, id bigint, special boolean")
    return tables.save(first.union(ranked), "vocabulary")


def _looked_up(df: DataFrame, keys: Sequence[str], values: str, table: DataFrame, key: str, found: str) -> DataFrame:
    """(keys, _seen): for each row of df its distinct values that the table has, with their column ``found``."""
    each = df.select(*keys, F.explode(F.array_distinct(values)).alias(key)).join(table.select(key, found), key)
    return each.groupBy(*keys).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(found).alias("v"))).alias("_seen"))


def _placed(values, known, found) -> list:
    table = dict(zip(known or (), found or ()))
    return [table.get(x) for x in values]


@F.arrow_udf(ArrayType(LongType()))
def _ids(values: pa.Array, known: pa.Array, found: pa.Array) -> pa.Array:
    """For each value what was found for it, or null."""
    return by_rows(_placed, pa.list_(pa.int64()), values, known, found)


@F.arrow_udf(ArrayType(StringType()))
def _tokens(values: pa.Array, known: pa.Array, found: pa.Array) -> pa.Array:
    """As _ids, without nulls."""
    return by_rows(lambda *row: [x for x in _placed(*row) if x is not None], pa.list_(pa.string()), values, known, found)


def _of(udf, values: str) -> Column:
    return F.when(F.col(values).isNotNull(), udf(F.coalesce(F.col(values), F.array()), F.col("_seen.k"), F.col("_seen.v")))


def encode(df: DataFrame, vocabulary: DataFrame, keys: Sequence[str], tokens: str = "tokens", ids: str = "ids") -> DataFrame:
    """df with the ids of its tokens, null for a token that the vocabulary doesn't have. keys name a row and aren't null."""
    both = df.join(_looked_up(df, keys, tokens, vocabulary, "token", "id"), list(keys), "left")
    return both.withColumn(ids, _of(_ids, tokens)).drop("_seen")


def decode(df: DataFrame, vocabulary: DataFrame, keys: Sequence[str], ids: str = "ids", text: str = "text", limit: int | None = None, sep: str = " ") -> DataFrame:
    """df with the text of its ids: those that aren't special, the first ``limit`` of them. Unknown and null ids are left out."""
    both = df.join(_looked_up(df, keys, ids, vocabulary.where(~F.col("special")), "id", "token"), list(keys), "left")
    words = _of(_tokens, ids)
    return both.withColumn(text, F.coalesce(F.array_join(F.slice(words, 1, limit) if limit is not None else words, sep), F.lit(""))).drop("_seen")
