"""Sinks: manifests, chunks, element manifests, metadata, retrieval index, consolidated text, exports.

All write through Spark, so a path may be on any file system it knows. Timestamps become ISO text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import linking, stats

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _iso(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, _ISO) for c, t in df.dtypes if t == "timestamp"})


def write_manifest(manifest: DataFrame, path: str) -> None:
    _iso(manifest.drop("content")).write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, json: bool = False) -> None:
    chunks.write.mode("overwrite").parquet(path)
    if json:
        chunks.drop("overlap_with_previous", "overlap_with_next").write.mode("overwrite").json(path + "_json")


def write_element_manifest(linked: DataFrame, elements: DataFrame, path: str) -> None:
    """Images, tables and the chunks that mention any, each as JSON rows with the date; nothing where there are no elements."""
    if elements.isEmpty():
        return
    date = F.date_format(F.current_timestamp(), _ISO).alias("creation_date")
    image = elements.where("element_type = 'image'").select(date, F.col("element_id").alias("image_id"), "page", "width", "height", "format", "path", "source_doc")
    table = elements.where("element_type = 'table'").select(date, F.col("element_id").alias("table_id"), "page", "content", "rows", "cols", "source_doc")
    chunk = linked.where("has_multimodal").select(date, "doc_id", "chunk_index", "multimodal_refs", F.col("linked").alias("linked_elements"))
    for name, rows in (("images", image), ("tables", table), ("chunks_with_multimodal", chunk)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_preprocess_manifest(elements: DataFrame, path: str) -> None:
    """Images and tables of preprocessed documents by ``id``, with the date."""
    date, e = F.date_format(F.current_timestamp(), _ISO).alias("creation_date"), elements.withColumnRenamed("element_id", "id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    e.where("element_type = 'image'").select(date, "id", "path", zero("width"), zero("height"), "source_doc").write.mode("overwrite").json(f"{path}/images")
    e.where("element_type = 'table'").select(date, "id", zero("rows"), zero("cols"), "source_doc").write.mode("overwrite").json(f"{path}/tables")


def indexing_metadata(chunks: DataFrame, model: str, source: str, config, loader=None, elements: DataFrame | None = None) -> DataFrame:
    """One row: timestamp, model, source, statistics and configuration."""
    s = stats.pipeline_stats(chunks)
    shown = lambda c: F.to_json(F.create_map(*[x for k, v in vars(c).items() for x in (F.lit(k), F.lit(str(v)))])) if c is not None else F.lit(None).cast("string")
    out = s.select(F.date_format(F.current_timestamp(), _ISO).alias("timestamp"), F.lit(model).alias("embedding_model"), F.lit(source).alias("documents_dir"), F.struct(*s.columns).alias("statistics"), shown(config).alias("chunker_config"), shown(loader).alias("multimodal_config"))
    if elements is None:
        return out
    n = elements.agg(F.count_if(F.col("element_type") == "image").alias("total_images"), F.count_if(F.col("element_type") == "table").alias("total_tables"), F.count("*").alias("total_elements"))
    return out.join(n.select(F.struct(*n.columns).alias("multimodal_statistics")), F.lit(True))  # one row each


def examples(chunks: DataFrame, n: int = 3, cut: int = 300) -> DataFrame:
    """The first chunks without and with references, contents cut."""
    shown = F.when(F.length("content") > cut, F.concat(F.substring("content", 1, cut), F.lit("..."))).otherwise(F.col("content"))
    pick = lambda yes: chunks.where(F.col("has_multimodal") == yes).orderBy("doc_id", "chunk_index").limit(n)
    return pick(False).unionByName(pick(True)).select("doc_id", "chunk_index", "has_multimodal", shown.alias("example"))


def chunk_key(chunks: DataFrame):
    """First 8 of the document's hash, and the chunk's number."""
    own = F.sha2(F.col("doc_id").cast("string"), 256)
    return F.concat(F.substring(F.coalesce("file_hash", own) if "file_hash" in chunks.columns else own, 1, 8), F.lit("_"), F.col("chunk_index").cast("string"))


def retrieval_index(chunks: DataFrame) -> DataFrame:
    """id, index, content, metadata, references and links of every chunk."""
    used = ("content", "token_count", "has_multimodal", "multimodal_refs", "linked", "overlap_with_previous", "overlap_with_next")
    meta = [c for c in chunks.columns if c not in used]
    more = [F.col("linked").alias("linked_elements")] if "linked" in chunks.columns else []
    return chunks.select(chunk_key(chunks).alias("id"), F.col("chunk_index").alias("index"), "content", F.create_map(*[x for c in meta for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("metadata"), "token_count", "has_multimodal", "multimodal_refs", *more)


def element_lookup(chunks: DataFrame) -> DataFrame:
    """doc_id, element_type, element_id, chunks: for images and tables, the chunks that mention them, in order."""
    return linking.inverted_index(chunks)


def write_export(store: DataFrame, path: str, collection: str = "collection", model: str = "hashing") -> None:
    """All rows without their vectors under ``documents``, and one row about them under ``header``."""
    store.select("id", F.col("document").alias("text"), "metadata").write.mode("overwrite").json(f"{path}/documents")
    store.agg(F.count("*").alias("total_documents")).select(F.lit(collection).alias("collection_name"), F.lit(model).alias("embedding_model"), F.date_format(F.current_timestamp(), _ISO).alias("timestamp"), "total_documents").write.mode("overwrite").json(f"{path}/header")


# How elements of a document are listed, at most so many of each.
_LISTED = 10


def _counted(images, tables, before: str):
    """" | Immagini: n | Tabelle: n" for those there are."""
    return F.concat(F.when(images > 0, F.concat(F.lit(f"{before}Immagini: "), images.cast("string"))).otherwise(""), F.when(tables > 0, F.concat(F.lit(" | Tabelle: "), tables.cast("string"))).otherwise(""))


def consolidated_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, place, block of every document, ready to be written in order: heading, source, statistics, content, elements.

    docs: doc_id, title, source_path, file_type, text, place (number in the consolidated order), images and tables.
    """
    from .files import IMAGE, TABLE

    d = stats.document_stats(docs) if "word_count" not in docs.columns else docs
    for c, kind in (("images", IMAGE), ("tables", TABLE)):
        d = d if c in d.columns else d.withColumn(c, F.array().cast(f"array<{kind}>"))
    rule = F.lit("=" * 80)
    number = F.col("place").cast("string")
    told = F.concat(F.lit("Statistiche: Parole: "), F.format_number("word_count", 0), F.lit(" | Caratteri: "), F.format_number("char_count", 0))
    n_images, n_tables = F.size("images"), F.size("tables")
    count = F.when(n_images + n_tables > 0, F.concat(F.lit("Elementi multimodali: Immagini: "), n_images.cast("string"), F.lit(" | Tabelle: "), n_tables.cast("string")))
    some = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    image = F.transform(F.slice("images", 1, _LISTED), lambda i: F.concat(F.lit("  - "), i["image_id"], F.lit(": "), some(i["width"]), F.lit("x"), some(i["height"]), F.lit("px")))
    table = F.transform(F.slice("tables", 1, _LISTED), lambda t: F.concat(F.lit("  - "), t["table_id"], F.lit(": "), t["rows"].cast("string"), F.lit("x"), t["cols"].cast("string")))
    listed = lambda head, n, rows: F.when(n > 0, F.concat(F.lit(f"\n{head}\n"), F.array_join(rows, "\n")))
    block = F.concat_ws("\n", F.lit(""), rule, F.concat(F.lit("DOCUMENTO "), number, F.lit(": "), F.col("title")), F.concat(F.lit("Fonte: "), F.element_at(F.split("source_path", "/"), -1)), F.concat(F.lit("Tipo: "), F.col("file_type")), told, count, rule, F.lit(""), F.lit("CONTENUTO:"), F.lit("-" * 40), F.col("text"), F.lit(""), listed("IMMAGINI NEL DOCUMENTO:", n_images, image), listed("TABELLE NEL DOCUMENTO:", n_tables, table), F.lit(""), F.concat(F.lit("[Fine documento "), number, F.lit("]")), F.lit(""))
    return d.select("doc_id", F.col("place").cast("long").alias("place"), block.alias("block"))


def consolidated_index(docs: DataFrame) -> DataFrame:
    """place, line: a document's entry in the index of the consolidated text."""
    n_images, n_tables = F.size("images"), F.size("tables")
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.col("title"), F.lit("\n   Tipo: "), F.col("file_type"), F.lit(" | Parole: "), F.format_number("word_count", 0), _counted(n_images, n_tables, " | "))
    return docs.select(F.col("place").cast("long").alias("place"), line.alias("block"))


def write_consolidated(docs: DataFrame, path: str) -> None:
    """Header, index, documents and totals as text files, in order over and within the files: no document leaves its task.

    docs: as in ``consolidated_blocks``, with word_count and char_count of the texts before cleaning, if they have them.
    """
    from .files import IMAGE, TABLE

    d = stats.document_stats(docs) if "word_count" not in docs.columns else docs
    for c, kind in (("images", IMAGE), ("tables", TABLE)):
        d = d if c in d.columns else d.withColumn(c, F.array().cast(f"array<{kind}>"))
    rule, n = F.lit("=" * 80), lambda c: F.col(c).cast("string")
    sums = d.agg(F.count("*").alias("n"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("w"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("c"), F.coalesce(F.sum(F.size("images")), F.lit(0)).alias("i"), F.coalesce(F.sum(F.size("tables")), F.lit(0)).alias("t"))
    head = F.concat_ws("\n", rule, F.lit("DOCUMENTI CONSOLIDATI CON ELEMENTI MULTIMODALI"), F.concat(F.lit("Data: "), F.date_format(F.current_timestamp(), _ISO)), F.concat(F.lit("Totale documenti: "), n("n")), F.concat(F.lit("Totale immagini: "), n("i")), F.concat(F.lit("Totale tabelle: "), n("t")), rule, F.lit(""), F.lit("INDICE DEI DOCUMENTI:"), F.lit("-" * 40))
    foot = F.concat_ws("\n", F.lit(""), rule, F.lit("RIEPILOGO FINALE"), F.concat(F.lit("Documenti: "), n("n")), F.concat(F.lit("Parole totali: "), F.format_number("w", 0)), F.concat(F.lit("Caratteri totali: "), F.format_number("c", 0)), F.concat(F.lit("Immagini totali: "), n("i")), F.concat(F.lit("Tabelle totali: "), n("t")), rule)
    part = lambda df, k: df.withColumn("part", F.lit(k))
    rows = part(sums.select(F.lit(0).cast("long").alias("place"), head.alias("block")), 0).unionByName(part(consolidated_index(d), 1)).unionByName(part(consolidated_blocks(d).drop("doc_id"), 2)).unionByName(part(sums.select(F.lit(0).cast("long").alias("place"), foot.alias("block")), 3))
    rows.repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("block").write.mode("overwrite").text(path)


def write_images(images: DataFrame, path: str) -> None:
    """image_id, data: one binary row each; a reader picks any image without listing files."""
    images.where("data is not null").select("doc_id", "image_id", F.unbase64("data").alias("data")).write.mode("overwrite").parquet(path)
