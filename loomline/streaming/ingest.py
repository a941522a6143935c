"""Streaming ingest: new documents are cleaned, chunked and appended to a chunk table as they arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking


def chunk_stream(docs: DataFrame, strategy: str = "semantic", cfg: chunking.Config | None = None) -> DataFrame:
    """A stream of documents (doc_id, text, ...) into a stream of chunks: stateless, as chunks end with their document."""
    return chunking.chunk(docs.withColumn("text", T.processor_clean(F.coalesce("text", F.lit("")), compose=False)), strategy, cfg)


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, strategy: str = "semantic"):
    """Start (or resume) the query that turns parquet files under ``source`` into chunks under ``target``, each once."""
    docs = spark.readStream.schema(schema).parquet(source)
    return chunk_stream(docs, strategy).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def counts_by_source(docs: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Documents and tokens by source and event-time window (column ``ts``), late rows bounded by a watermark."""
    return docs.withWatermark("ts", late).groupBy(F.window("ts", window), "source").agg(F.count("*").alias("n"), F.sum(T.tokens(F.col("text"))).alias("tokens"))
