"""The preprocessing plan: extract, describe elements, clean, order and write one consolidated text with its manifests."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats
from ..operators.order import numbered
from ..scratch import materialise
from ..sources import files, sinks


@dataclass
class Preprocessing:
    recursive: bool = True
    aggressive: bool = False
    images: bool = True
    tables: bool = True
    doc_type: str = "generic"

    def documents(self, spark: SparkSession, path: str) -> DataFrame:
        """Extracted and cleaned documents: marks become descriptions of their elements, statistics are those of the text
        before cleaning, unreadable files are left out."""
        loader = files.Loader(self.images, self.tables, mode="extractor")
        d = files.load(files.scan_directory(spark, path, self.recursive, content=True), loader).where(~F.col("failed"))
        d = d.withColumn("doc_id", F.xxhash64("path")).withColumnRenamed("path", "source_path").withColumnRenamed("type", "file_type")
        # Written here: parsers run once, and neither plan holds the other's expressions.
        d = materialise(d, "extracted")
        d = stats.document_stats(d.withColumn("text", T.describe_elements(F.col("text"), F.col("images"), F.col("tables"))))
        clean = lambda kind: T.extractor_clean(F.col("text"), kind, self.aggressive)
        return d.withColumn("text", F.when(F.col("file_type") == "pdf", clean("pdf")).otherwise(clean(self.doc_type)))

    def run(self, spark: SparkSession, path: str, out: str) -> DataFrame:
        """Writes ``documents``, ``consolidated`` (text), ``metadata``, ``elements``, ``manifest`` and ``images`` under
        ``out``; returns the totals. Files are parsed once, for ``documents``."""
        ordered = numbered(self.documents(spark, path), F.col("file_type") != "pdf", F.desc("word_count"), "source_path")
        ordered.withColumn("place", F.col("place").cast("int")).write.mode("overwrite").parquet(f"{out}/documents")
        placed = spark.read.parquet(f"{out}/documents")
        sinks.write_consolidated(placed, f"{out}/consolidated")
        size = lambda c: F.size(c).cast("long")
        per = placed.select("place", "title", F.col("source_path").alias("source"), F.col("file_type").alias("type"), F.col("word_count").alias("words"), F.col("char_count").alias("chars"), size("images").alias("images"), size("tables").alias("tables"), size("sections").alias("sections_count"))
        per.write.mode("overwrite").json(f"{out}/metadata")
        files.elements(placed).write.mode("overwrite").parquet(f"{out}/elements")
        sinks.write_preprocess_manifest(spark.read.parquet(f"{out}/elements"), f"{out}/manifest")
        sinks.write_images(placed.select("doc_id", F.explode("images").alias("i")).select("doc_id", "i.*"), f"{out}/images")
        return placed.agg(F.count("*").alias("total_documents"), F.sum("word_count").alias("total_words"), F.sum("char_count").alias("total_chars"), F.sum(size("images")).alias("total_images"), F.sum(size("tables")).alias("total_tables"))
