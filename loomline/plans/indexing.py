"""The indexing plan: manifest, documents, cleaned text, chunks, links, statistics, artefacts."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, linking, stats, vectors
from ..sources import files, sinks


@dataclass
class Indexing:
    strategy: str = "multimodal_aware"
    chunker: chunking.Config = field(default_factory=chunking.Config)
    loader: files.Loader = field(default_factory=files.Loader)
    keyword: str = "\x00"
    limit: int | None = None
    model: str = "hashing"

    def documents(self, spark: SparkSession, path: str) -> DataFrame:
        """Loaded documents; a limit is applied to the manifest, before contents are read."""
        manifest = files.scan_directory(spark, path, keyword=self.keyword, content=True)
        if self.limit:
            first = files.by_priority(files.scan_directory(spark, path, keyword=self.keyword), self.limit)
            manifest = manifest.join(F.broadcast(first.select("path")), "path", "left_semi")  # ``limit`` rows
        return files.load(manifest, self.loader).withColumn("doc_id", F.xxhash64("path"))

    def chunks(self, docs: DataFrame) -> DataFrame:
        pdf = T.processor_clean(F.col("text"), "pdf")
        clean = T.processor_clean(F.col("text"))
        kept = [c for c in ("doc_id", "path", "name", "type", "extension", "size", "modified", "priority", "title", "file_hash", "encoding", "page_count", "has_images", "text") if c in docs.columns]
        body = docs.where(F.col("text").isNotNull()).select(*kept).withColumn("text", F.when(F.col("type") == "pdf", pdf).otherwise(clean))
        return chunking.chunk(body, self.strategy, self.chunker)

    def run(self, spark: SparkSession, path: str, out: str) -> DataFrame:
        """Index a directory into ``out``; returns the one-row statistics. Later artefacts read what was written: files are
        parsed once for ``documents``, which also holds images and tables."""
        sinks.write_manifest(files.by_priority(files.scan_directory(spark, path, keyword=self.keyword)), f"{out}/manifest")
        self.documents(spark, path).write.mode("overwrite").parquet(f"{out}/documents")
        docs = spark.read.parquet(f"{out}/documents")
        sinks.write_chunks(self.chunks(docs), f"{out}/chunks")
        files.elements(docs).write.mode("overwrite").parquet(f"{out}/elements")
        chunks, elements = spark.read.parquet(f"{out}/chunks"), spark.read.parquet(f"{out}/elements")
        linked = linking.with_links(chunks, elements)
        sinks.write_element_manifest(linked, elements, f"{out}/multimodal_manifest")
        sinks.indexing_metadata(chunks, self.model, path, self.chunker, self.loader, elements).write.mode("overwrite").json(f"{out}/metadata")
        sinks.retrieval_index(linked).write.mode("overwrite").parquet(f"{out}/retrieval_index")
        sinks.element_lookup(chunks).write.mode("overwrite").parquet(f"{out}/element_lookup")
        stats.by_document(chunks, docs).write.mode("overwrite").parquet(f"{out}/document_statistics")
        sinks.examples(chunks).write.mode("overwrite").json(f"{out}/examples")
        return stats.pipeline_stats(chunks)


def chunks_with_metadata(chunks: DataFrame) -> DataFrame:
    """id, text, metadata, has_multimodal and the references of every chunk, split into images, tables and all."""
    bare = lambda kind: F.transform(F.filter("multimodal_refs", lambda r: r.contains(f"{kind}_")), lambda r: F.regexp_extract(r, rf"{kind}_([^\]]+)", 1))
    meta = [c for c in chunks.columns if c not in ("content", "multimodal_refs", "has_multimodal", "linked")]
    return chunks.select(sinks.chunk_key(chunks).alias("id"), F.col("content").alias("text"), F.create_map(*[x for c in meta for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("metadata"), "has_multimodal", F.struct(bare("IMMAGINE").alias("images"), bare("TABELLA").alias("tables"), F.col("multimodal_refs").alias("all_refs")).alias("multimodal"))


def index_collection(spark: SparkSession, index: str, collection: str, embed=None, reset: bool = False) -> int:
    """Put the chunks of a written index into a vector collection, with character and token counts among their metadata;
    how many rows the collection then has. Ids come from the content, so a second run without ``reset`` adds the same ids."""
    chunks = spark.read.parquet(f"{index}/chunks").drop("multimodal_refs", "overlap_with_previous", "overlap_with_next").withColumnRenamed("name", "file_name")
    vectors.write_collection(vectors.store(chunks, embed or vectors.hashing_embedding()), collection, reset)
    return vectors.open_collection(spark, collection).count()
