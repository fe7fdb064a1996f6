"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewise.llm import ann, bpe, conversations, embed_dedup, langid, lexical, mixing, ngram_lm, sharding, simhash, suffix_dedup, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_sharding": sharding.op2_sharding,
        "op3_warc": warc.op3_warc,
        "op4_embedding_dedup": embed_dedup.op4_embedding_dedup,
        "op5_url_filter": urlfilter.op5_url_filter,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_ann": ann.op8_ann,
        "op9_mixing": mixing.op9_mixing,
        "op10_langid": langid.op10_langid,
        "op11_lm_score": ngram_lm.op11_lm_score,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_conversation_repair": conversations.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.op2_sql(), "op4_embedding_dedup": embed_dedup.OP4_SQL, "op12_lexical_search": lexical.OP12_SQL}
