"""Links between chunks and the images and tables they mention.

Inputs: chunks(doc_id, chunk_index, multimodal_refs array), elements(doc_id, element_id, element_type).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# How references name images and tables.
_OF = {"image": "IMMAGINE", "table": "TABELLA"}


def _mentions(chunks: DataFrame) -> DataFrame:
    refs = chunks.select("doc_id", "chunk_index", F.posexplode("multimodal_refs").alias("nth", "ref"))
    kind = F.when(F.col("ref").contains("IMMAGINE_"), "image").when(F.col("ref").contains("TABELLA_"), "table")
    bare = F.replace(F.replace(F.replace(F.col("ref"), F.lit("[IMMAGINE_"), F.lit("")), F.lit("[TABELLA_"), F.lit("")), F.lit("]"), F.lit(""))
    return refs.withColumn("element_type", kind).withColumn("element_id", bare)


def link_elements(chunks: DataFrame, elements: DataFrame, per_document: bool = True) -> DataFrame:
    """doc_id, chunk_index, element_type, element_id of mentions whose element exists, in the document or anywhere."""
    on = ["element_type", "element_id", *(["doc_id"] if per_document else [])]
    return _mentions(chunks).join(elements.select(*on).distinct(), on, "left_semi").select("doc_id", "chunk_index", "nth", "element_type", "element_id")


def with_links(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """chunks with ``linked``: the (element_type, element_id) that it mentions and its document has, in order of mention."""
    found = link_elements(chunks, elements).groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(F.struct("nth", "element_type", "element_id"))).alias("l"))
    found = found.select("doc_id", "chunk_index", F.transform("l", lambda x: F.struct(x["element_type"].alias("element_type"), x["element_id"].alias("element_id"))).alias("linked"))
    return chunks.join(found, ["doc_id", "chunk_index"], "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<struct<element_type:string,element_id:string>>")))


def inverted_index(chunks: DataFrame) -> DataFrame:
    """element_type, element_id, chunks: the chunk indexes that mention it, in order."""
    m = _mentions(chunks).where("element_type is not null")
    return m.groupBy("doc_id", "element_type", "element_id").agg(F.sort_array(F.collect_set("chunk_index")).alias("chunks"))


def chunks_of_element(chunks: DataFrame, element_id: str, exact: bool = True) -> DataFrame:
    """Chunks that mention an element; without ``exact`` by part of a reference, so p1_t1 finds p1_t10 too."""
    m = _mentions(chunks)
    return m.where(F.col("element_id") == element_id if exact else F.col("ref").contains(element_id)).select("doc_id", "chunk_index").distinct()


def lookup(elements: DataFrame, element_id: str, element_type: str = "auto") -> DataFrame:
    """An element by id; the type follows from the id if not given: "img" is an image, else "t" a table, else nothing."""
    kind = element_type if element_type != "auto" else "image" if "img" in element_id else "table" if "t" in element_id else ""
    return elements.where((F.col("element_id") == element_id) & (F.col("element_type") == kind))


def source_of(elements: DataFrame, owners: DataFrame, per_document: bool = True) -> DataFrame:
    """elements with ``source_doc``: its own document's name, or (ids taken as unique) that of the first owner by order."""
    if per_document:
        named = owners.select("doc_id", F.col("name").alias("source_doc"))
        return elements.join(named, "doc_id", "left")
    first = owners.join(elements.select("doc_id", "element_id", "element_type"), "doc_id").groupBy("element_id", "element_type").agg(F.min_by("name", "doc_id").alias("source_doc"))
    return elements.join(first, ["element_id", "element_type"], "left")


def overlaps(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_index, overlap: distinct words shared by the last 20 of the chunk before and the first 20 of this one."""
    from ..functions import text as T

    before = F.lag("content").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    c = chunks.select("doc_id", "chunk_index", "content", before.alias("before"))
    return c.select("doc_id", "chunk_index", F.when(F.col("before").isNull(), 0).otherwise(T.shared_words(F.col("before"), F.col("content"))).alias("overlap"))
