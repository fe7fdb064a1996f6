"""Chat messages and the prompt that is rendered from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"


def messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", image_roles: tuple[str, ...] = ()) -> DataFrame:
    """(conv, messages): a conversation's turns in order as nested messages. Turns of image_roles also carry an image item."""
    item = F.struct(F.lit("text").alias("type"), F.col(text).alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))
    content = F.when(F.col(role).isin(*image_roles), F.array(image, item)).otherwise(F.array(item)) if image_roles else F.array(item)
    rows = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), content.alias("content"))
    listed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(rows)).alias("m"))
    return listed.select(conv, F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))


def prompt(column: str = "messages", generate: bool = True) -> Column:
    """The prompt: a header for each role, image items as <image>, and the assistant's header for what is to come."""
    part = lambda c: F.when(c["type"] == "image", F.lit("<image>")).otherwise(F.coalesce(c["text"], F.lit("")))
    one = lambda m: F.concat(F.lit("<|"), m.role, F.lit("|>\n"), F.array_join(F.transform(m.content, part), "\n"), F.lit("\n"))
    text = F.array_join(F.transform(column, one), "")
    return F.concat(text, F.lit("<|assistant|>\n")) if generate else text


def prefill_items(conversations: DataFrame, conv: str = "conv_id", image_len: int = 24) -> DataFrame:
    """(conv, pos, is_image, len): the content items of a conversation's messages in order; an image is one item of a fixed length, a text has its words."""
    flat = conversations.select(conv, F.posexplode(F.flatten(F.transform("messages", lambda m: m.content))).alias("pos", "item"))
    words = F.size(F.filter(F.split(F.coalesce("item.text", F.lit("")), " "), lambda t: t != ""))
    is_image = F.col("item.type") == "image"
    return flat.select(conv, "pos", is_image.alias("is_image"), F.when(is_image, image_len).otherwise(words).alias("len"))
