"""Aggregates over documents and chunks."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .order import numbered


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """char_count, word_count and line_count beside the other columns, of the text as it is."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("char_count", F.length(t)).withColumn("word_count", F.size(T.words(t))).withColumn("line_count", F.size(T.lines(t)))


def token_histogram(docs: DataFrame, width: int = 50, text: str = "text") -> DataFrame:
    return docs.groupBy(F.floor(T.tokens(F.coalesce(F.col(text), F.lit(""))) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def line_frequency(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, line, n of the lines of 11 to 99 characters that a document holds ``least`` times or more, counted in its row."""
    found = T.let(F.col("text"), lambda t: T.let(T.lines(t), lambda ordered: F.transform(T.repetitive_lines(t, least), lambda x: F.struct(x.alias("line"), F.size(F.filter(ordered, lambda y: y == x)).cast("long").alias("n")))))
    return docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.line", "x.n")


def chunk_validation(chunks: DataFrame, min_size: int = 100) -> DataFrame:
    """One row; none for no chunks."""
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.round(F.avg("char_count"), 6).alias("avg_char_count"), F.round(F.avg("token_count"), 6).alias("avg_token_count"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.count_if(F.col("token_count") > 512).alias("chunks_over_limit"),
        F.count_if(F.col("token_count") < min_size).alias("chunks_under_min"), F.count_if("has_multimodal").alias("multimodal_chunks"),
        F.coalesce(F.sum(F.size("multimodal_refs")), F.lit(0)).alias("total_multimodal_refs"), F.count_if("is_table_chunk").alias("table_chunks"),
    ).where("total_chunks > 0")


def pipeline_stats(chunks: DataFrame) -> DataFrame:
    """One row of totals, token moments (population deviation, exact median) and reference counts; none for no chunks."""
    refs = F.when(F.col("has_multimodal"), F.size("multimodal_refs"))
    return chunks.agg(
        F.countDistinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"), F.sum("char_count").alias("total_characters"), F.sum("token_count").alias("total_tokens"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.round(F.stddev_pop("token_count"), 6).alias("std_tokens"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        F.median("token_count").alias("median_tokens"), F.round(F.avg("char_count"), 6).alias("avg_chars"), F.count_if(F.col("token_count") > 512).alias("chunks_over_512"),
        F.count_if(F.col("token_count") < 100).alias("chunks_under_100"), F.count_if("has_multimodal").alias("chunks_with_multimodal"), F.round(F.avg(refs), 6).alias("avg_refs_per_chunk"), F.max(refs).alias("max_refs_per_chunk"),
    ).where("total_chunks > 0").withColumn("avg_chunks_per_doc", F.round(F.col("total_chunks") / F.col("total_documents"), 6))


def by_document(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, chunks, multimodal_chunks, avg_tokens of every document; a document without chunks has no mean."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("has_multimodal").alias("multimodal_chunks"), F.round(F.avg("token_count"), 6).alias("avg_tokens"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("multimodal_chunks", F.lit(0)).alias("multimodal_chunks"), "avg_tokens")


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def totals(docs: DataFrame) -> DataFrame:
    """Sums over document statistics."""
    return document_stats(docs).agg(F.count("*").alias("documents"), F.sum("word_count").alias("total_words"), F.sum("char_count").alias("total_chars"))


def store_stats(store: DataFrame, sample: int = 100) -> DataFrame:
    """count, dimension and the distinct metadata keys of the first ``sample`` rows by id."""
    keys = store.orderBy("id").limit(sample).select(F.explode(F.map_keys("metadata")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("metadata_keys"))
    return store.agg(F.count("*").alias("count"), F.max(F.size("embedding")).alias("dimension")).join(keys, F.lit(True))


def consolidated_order(docs: DataFrame) -> DataFrame:
    """Documents with their statistics and ``place``: PDFs first, longest first, ties in order of id."""
    return numbered(document_stats(docs).select("doc_id", "file_type", "word_count", "char_count"), F.col("file_type") != "pdf", F.desc("word_count"), "doc_id")
