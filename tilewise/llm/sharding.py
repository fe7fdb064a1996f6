"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards take turns; on its turn a shard claims
the first slot of its permutation that is still free (Eisenbud et al., 2016). A key's slot is a hash, so placement is
one lookup; shards get equal shares within one slot, and adding or removing a shard moves few other keys.

The table is made on the driver (its size is a parameter, whatever the keys are), becomes a DataFrame of one row a
slot, and is broadcast. Keys are neither grouped nor shuffled, so a hot key costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewise.llm import scratch

#: Slots (a prime, much above the number of shards), and shards of the registered query.
SLOTS, SHARDS = 65537, tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in shards) that holds each slot."""
    if not shards or len(set(shards)) < len(shards) or slots < len(shards):
        raise ValueError("shards must be named, distinct and no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number")
    start = [_number(f"start {s}") % slots for s in shards]
    skip = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    table, claimed = [-1] * slots, 0
    while True:
        for k in range(len(shards)):
            while table[start[k]] >= 0:
                start[k] = (start[k] + skip[k]) % slots
            table[start[k]] = k
            claimed += 1
            if claimed == slots:
                return table


def slot_of(key: str | Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text. A null key hashes as the empty text."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % slots


def place(df: DataFrame, key: str | Column, shards: Sequence[str] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row; columns of these names are replaced.

    Equal keys and repeated rows go to one shard; null and empty keys to one as well. An empty table stays empty.
    """
    own = scratch.prefix(df)
    slot, shard = f"{own}slot", f"{own}shard"
    filled = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")).alias(slot, "k"))
    names = F.array(*[F.lit(s) for s in shards])
    filled = filled.select(F.col(slot).cast("bigint").alias(slot), F.element_at(names, F.col("k").cast("int") + 1).alias(shard))
    rest = scratch.others(df, (slot_col, shard_col))
    keyed = df.select(*[df[f"`{c}`"] for c in rest], slot_of(key, slots).alias(slot))
    return keyed.join(F.broadcast(filled), slot).select(*[f"`{c}`" for c in rest], F.col(slot).alias(slot_col), F.col(shard).alias(shard_col))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id")


def op2_sql() -> str:
    table = ",".join(map(str, fill(SHARDS)))
    return f"""
        WITH filled AS (SELECT [{table}] AS t),
        keyed AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(t[slot + 1] AS VARCHAR), 3, '0') AS shard FROM keyed, filled
    """
