"""Queries of the training-data operators, and SQL for those that SQL can express."""
from __future__ import annotations

from . import jaccard, language, licences, mixing, packing, quality, quotes, tokencount, topk, toxicity


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokencount(spark, sf_dir):
    return tokencount.count_documents(_read(spark, sf_dir, "documents"))


def op2_topk(spark, sf_dir):
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op5_language(spark, sf_dir):
    return language.language(_read(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op7_jaccard(spark, sf_dir):
    return jaccard.join(_read(spark, sf_dir, "documents"))


def op8_licenses(spark, sf_dir):
    return licences.licenses(_read(spark, sf_dir, "documents")).drop("detections")


def op9_chat(spark, sf_dir):
    return quotes.link(_read(spark, sf_dir, "conversations"))


def op10_quality(spark, sf_dir):
    return quality.quality(_read(spark, sf_dir, "documents"))


#: Each message quoted by a reply, and both by a reply to that: quotes of two levels over the whole table.
QUOTED = r"""
select conv_id, turn, role, text from conversations
union all select conv_id, turn + 1000, 'user', '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || 'I see that ' || turn from conversations
union all select conv_id, turn + 2000, 'user', '>> ' || replace(text, chr(10), chr(10) || '>> ') || chr(10) || '> I see that ' || turn || chr(10) || 'Right ' || turn from conversations
"""


def chat_quotes(spark, sf_dir):
    """``op9_chat`` where messages quote each other, as those of the tables do not."""
    return quotes.link(spark.sql(QUOTED.replace("from conversations", "from {c}"), c=_read(spark, sf_dir, "conversations")))


STRICT = {"least": 1, "share": 0.0, "lost": 0.2}


def quality_strict(spark, sf_dir):
    """``op10_quality`` with limits that many lines and documents of the small tables are over."""
    return quality.quality(_read(spark, sf_dir, "documents"), **STRICT)


QUERIES = {
    "op1_tokencount": op1_tokencount,
    "op2_topk": op2_topk,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_jaccard": op7_jaccard,
    "op8_licenses": op8_licenses,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    "chat_quotes": chat_quotes,
    "quality_strict": quality_strict,
}
ORACLES: dict[str, str] = {"op2_topk": topk.ORACLE, "op4_mixing": mixing.ORACLE, "op7_jaccard": jaccard.ORACLE, "op9_chat": quotes.ORACLE, "op10_quality": quality.oracle(), "chat_quotes": quotes.ORACLE.replace("from conversations)", f"from ({QUOTED}))"), "quality_strict": quality.oracle(**STRICT)}
