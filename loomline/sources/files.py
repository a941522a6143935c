"""File sources: directory scans, text, JSON, office and PDF files, all over Spark's own readers."""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Supported extensions and their types.
TYPES = {".pdf": "pdf", ".txt": "text", ".md": "markdown", ".docx": "word", ".html": "html", ".json": "json"}


def _type_of(ext):
    return F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[ext]


def scan_directory(spark: SparkSession, path: str, recursive: bool = True, keyword: str = "\x00", content: bool = False) -> DataFrame:
    """Manifest of supported files: path, name, type, extension, size, modified, priority (and content on demand).

    Spark's listing has no creation time: ``created`` is the file's last change, the nearest that every store has.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    out = files.select(F.col("path"), name.alias("name"), ext.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    out = out.where(F.col("extension").isin(*TYPES))
    return out.withColumn("type", _type_of(F.col("extension"))).withColumn("created", F.col("modified")).withColumn("priority", T.priority(F.col("name"), F.col("extension"), keyword))


def by_priority(manifest: DataFrame, limit: int | None = None) -> DataFrame:
    """high, medium, low, other; ties by path. A limit of 0 or None is none."""
    out = manifest.orderBy(T.priority_rank(F.col("priority")), "path")
    return out.limit(limit) if limit else out


# Byte order marks and their encodings, the longer first where one begins another.
_MARKED = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]


@T.arrow_function("struct<text:string,encoding:string>")
def _decoded(content: pd.Series) -> pd.DataFrame:
    def one(b):
        if b is None:
            return "", None
        for mark, enc in _MARKED:
            if b.startswith(mark):
                return b[len(mark) :].decode(enc, "replace"), enc
        for enc in ("utf-8", "latin-1"):
            try:
                return b.decode(enc), enc
            except UnicodeDecodeError:
                pass
        return "", None

    return pd.DataFrame([one(b) for b in content], columns=["text", "encoding"])


@T.arrow_function("struct<text:string,json_keys:array<string>,json_structure:string>")
def _pretty_json(content: pd.Series) -> pd.DataFrame:
    import json

    def one(b):
        try:
            v = json.loads(b)
        except (ValueError, TypeError):
            return None, None, None
        return json.dumps(v, indent=2, ensure_ascii=False), list(v) if isinstance(v, dict) else None, type(v).__name__

    return pd.DataFrame([one(b) for b in content], columns=["text", "json_keys", "json_structure"])


IMAGE = "struct<image_id:string,page:int,width:int,height:int,format:string,src:string,alt:string,data:string,ocr_text:string>"
TABLE = "struct<table_id:string,page:int,content:array<array<string>>,rows:int,cols:int,text_representation:string>"
SECTION = "struct<title:string,level:int,style:string,page:int>"


def _image(**known):
    """An image's fields; data are base64. What is not known is null, as is text, which nothing here reads."""
    import base64

    out = dict.fromkeys(("image_id", "page", "width", "height", "format", "src", "alt", "data", "ocr_text")) | known
    return out | {"data": base64.b64encode(out["data"]).decode() if out["data"] is not None else None}


@T.arrow_function(f"struct<text:string,title:string,sections:array<{SECTION}>,images:array<{IMAGE}>,grids:array<array<array<string>>>>")
def _docx(content: pd.Series) -> pd.DataFrame:
    """Paragraphs, headings, pictures and tables of office documents, by the standard library alone."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    words = lambda e: "".join(t.text or "" for t in e.iter(ns + "t")).strip()

    def pictures(z):
        """Targets of the document's image relations, in their order."""
        try:
            links = ET.fromstring(z.read("word/_rels/document.xml.rels"))
        except KeyError:
            return []
        names = [r.get("Target", "") for r in links if r.get("Type", "").endswith("/image") and r.get("TargetMode") != "External"]
        names = ["word/" + x if not x.startswith("/") else x[1:] for x in names]
        return [x for x in names if x in z.namelist()]

    def one(b):
        try:
            z = zipfile.ZipFile(io.BytesIO(b))
            body = ET.fromstring(z.read("word/document.xml")).find(ns + "body")
        except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
            return (None,) * 5
        parts, sections, tables = [], [], []
        for p in body.findall(ns + "p"):
            t = words(p)
            style = p.find(f"{ns}pPr/{ns}pStyle")
            if t:
                parts.append(t)
                if style is not None and style.get(ns + "val", "").startswith("Heading"):
                    sections.append({"title": t, "level": None, "style": style.get(ns + "val"), "page": None})
        for i, tbl in enumerate(body.findall(ns + "tbl"), 1):
            tables.append([[words(c) for c in r.findall(ns + "tc")] for r in tbl.findall(ns + "tr")])
            parts.append(f"[TABELLA_table_{i}]")
        images = [_image(image_id=f"img_{i}", format=x.rsplit(".", 1)[-1].upper(), src=x, data=z.read(x)) for i, x in enumerate(pictures(z), 1)]
        parts += [f"[IMMAGINE_{x['image_id']}]" for x in images]
        return "\n\n".join(parts), sections[0]["title"] if sections else None, sections, images, tables

    return pd.DataFrame([one(b) for b in content], columns=["text", "title", "sections", "images", "grids"])


def _pdf(images: bool):
    @T.arrow_function(f"struct<pages:array<struct<page:int,text:string>>,images:array<{IMAGE}>,info:map<string,string>>")
    def read(content: pd.Series) -> pd.DataFrame:
        from . import pdf

        def one(b):
            try:
                found = pdf.read(b or b"", images)
            except Exception:  # noqa: BLE001  a broken file is a null row, not a failed job
                return None, None, None
            made = [_image(image_id=f"p{p['page']}_img{n}", page=p["page"], **i) for p in found["pages"] for n, i in enumerate(p["images"], 1)]
            return [{"page": p["page"], "text": p["text"]} for p in found["pages"]], made, {k: v for k, v in found["info"].items() if v}

        return pd.DataFrame([one(b) for b in content], columns=["pages", "images", "info"])

    return read


def _grid_table(grid, table_id, page):
    return F.struct(table_id.alias("table_id"), page.cast("int").alias("page"), grid.alias("content"), F.size(grid).alias("rows"), F.size(F.get(grid, 0)).alias("cols"), T.table_to_text(grid).alias("text_representation"))


def page_tables(pages, mode: str = "loader"):
    """Tables of pages (page, text): blocks that look like one, by page and running number. The loader keeps those of two
    rows or more, the extractor of one or more."""
    def of(p):
        blocks = F.filter(F.split(p["text"], "\n\n"), lambda b: T.looks_like_table(b, mode))
        grids = F.filter(F.transform(blocks, lambda b: T.parse_table(b, mode)), lambda g: F.size(g) > (1 if mode == "loader" else 0))
        return F.transform(grids, lambda g, i: _grid_table(g, F.concat(F.lit("p"), p["page"].cast("string"), F.lit("_t"), (i + 1).cast("string")), p["page"]))

    return F.flatten(F.transform(pages, of))


@dataclass(frozen=True)
class Loader:
    """What a load takes from files. ``mode``: "loader" or "extractor", which differ in tables and in the order of marks.
    ``placeholders``: a mark in a page's text for each of its images and tables, so that chunks can refer to them."""

    images: bool = True
    tables: bool = True
    placeholders: bool = True
    mode: str = "loader"


def load(manifest: DataFrame, options: Loader | None = None) -> DataFrame:
    """Documents of a manifest read with ``content=True``: text by type, title, sections, images, tables, file hash and so on.

    A file that cannot be read has a null text and ``failed`` true; nothing stops.
    """
    from . import markup

    o = options or Loader()
    none = lambda kind: F.array().cast(f"array<{kind}>")
    m = manifest.withColumn("file_hash", F.sha2("content", 256))
    m = m.withColumn("_d", F.when(F.col("type").isin("text", "markdown", "html"), _decoded("content"))).withColumn("_j", F.when(F.col("type") == "json", _pretty_json("content"))).withColumn("_w", F.when(F.col("type") == "word", _docx("content"))).withColumn("_p", F.when(F.col("type") == "pdf", _pdf(o.images)("content")))
    m = m.withColumn("_h", F.when(F.col("type") == "html", markup.page_of(F.col("_d.text"))))
    md = F.col("type") == "markdown"
    m = m.withColumn("_s", F.when(md, F.transform(markup.markdown_sections(F.col("_d.text")), lambda x: F.struct(x["title"].alias("title"), x["level"].alias("level"), F.lit(None).cast("string").alias("style"), F.lit(None).cast("int").alias("page")))))
    m = m.withColumn("_i", F.when(md, F.transform(markup.markdown_images(F.col("_d.text")), lambda x: F.struct(x["image_id"].alias("image_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("width", "int"), ("height", "int"), ("format", "string"))], x["path"].alias("src"), x["alt"].alias("alt"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("string").alias("ocr_text")))))
    word_tables = F.transform("_w.grids", lambda g, i: _grid_table(g, F.concat(F.lit("table_"), (i + 1).cast("string")), F.lit(None)))
    tables = F.coalesce(F.when(F.col("type") == "pdf", page_tables(F.col("_p.pages"), o.mode)).when(F.col("type") == "word", word_tables).when(F.col("type") == "html", F.col("_h.tables")), none(TABLE)) if o.tables else none(TABLE)
    images = F.coalesce(F.col("_p.images"), F.col("_w.images"), F.col("_h.images"), F.col("_i"), none(IMAGE)) if o.images else none(IMAGE)
    m = m.withColumn("images", images).withColumn("tables", tables)

    def marked(p):
        """A page's text with its marks after it: images first for the loader, tables first for the extractor."""
        on = lambda kind, key, rows: F.transform(F.filter(rows, lambda x: x["page"] == p["page"]), lambda x: F.concat(F.lit(f"\n[{kind}_"), x[key], F.lit("]\n")))
        marks = [on("IMMAGINE", "image_id", F.col("images")), on("TABELLA", "table_id", F.col("tables"))]
        return F.concat(p["text"], F.array_join(F.concat(*(marks if o.mode == "loader" else marks[::-1])), "")) if o.placeholders else p["text"]

    m = m.withColumn("pages", F.transform("_p.pages", lambda p: F.struct(p["page"].alias("page"), marked(p).alias("text"), F.length(p["text"]).alias("char_count"))))
    pdf_text = F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")
    text = F.when(F.col("type") == "html", F.col("_h.text")).when(F.col("type") == "json", F.col("_j.text")).when(F.col("type") == "word", F.col("_w.text")).when(F.col("type") == "pdf", pdf_text).otherwise(F.col("_d.text"))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    title = F.when(md, markup.markdown_title(F.col("_d.text"), stem)).otherwise(F.coalesce("_h.title", "_w.title", F.try_element_at("_p.info", F.lit("title")), stem))
    page_sections = F.transform("_p.pages", lambda p: F.struct(F.concat(F.lit("Pagina "), p["page"].cast("string")).alias("title"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("style"), p["page"].alias("page")))
    out = m.withColumn("text", text).withColumn("title", title).withColumn("sections", F.coalesce("_s", "_h.sections", "_w.sections", page_sections, none(SECTION)))
    out = out.withColumn("encoding", F.col("_d.encoding")).withColumn("page_count", F.when(F.col("pages").isNotNull(), F.size("pages"))).withColumn("pdf_metadata", F.col("_p.info")).withColumn("json_keys", F.col("_j.json_keys")).withColumn("json_structure", F.col("_j.json_structure"))
    out = out.withColumn("failed", F.col("text").isNull()).withColumn("has_images", F.size("images") > 0).withColumn("source", F.lit("local"))
    return out.drop("_d", "_j", "_w", "_p", "_h", "_s", "_i", "content")


def elements(docs: DataFrame) -> DataFrame:
    """One row an image or table of loaded documents: doc_id, element_id, element_type, page, its sizes, content and owner."""
    image = F.col("images")
    i = docs.select("doc_id", F.col("name").alias("source_doc"), F.explode(image).alias("x")).select("doc_id", F.col("x.image_id").alias("element_id"), F.lit("image").alias("element_type"), "x.page", "x.width", "x.height", "x.format", F.coalesce("x.src", F.lit("")).alias("path"), "x.data", F.lit(None).cast("int").alias("rows"), F.lit(None).cast("int").alias("cols"), F.lit(None).cast("array<array<string>>").alias("content"), "source_doc")
    t = docs.select("doc_id", F.col("name").alias("source_doc"), F.explode("tables").alias("x")).select("doc_id", F.col("x.table_id").alias("element_id"), F.lit("table").alias("element_type"), "x.page", *[F.lit(None).cast(k).alias(c) for c, k in (("width", "int"), ("height", "int"), ("format", "string"))], F.lit("").alias("path"), F.lit(None).cast("string").alias("data"), "x.rows", "x.cols", "x.content", "source_doc")
    return i.unionByName(t)


def preprocessed_directory(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a directory of consolidated texts and JSON files with ``documents``: name, text, type; empty texts dropped."""
    from . import markup

    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    texts = markup.documento_blocks(files.where(F.col("path").endswith(".txt")).select(F.xxhash64("path").alias("file_id"), "text"))
    rows = json_documents(files.where(F.col("path").endswith(".json")).select(F.xxhash64("path").alias("file_id"), "text"))
    return texts.select("name", "text", F.lit("text").alias("type")).unionByName(rows.select("name", F.col("content").alias("text"), F.lit("json").alias("type"))).where("text <> ''")


def preprocessed_file(spark: SparkSession, path: str) -> DataFrame:
    """One document from a preprocessing plan's output folder: its consolidated text, with counts and elements from the
    metadata and the manifest beside it. Priority high, type "preprocessed"."""
    text = spark.read.text(f"{path}/consolidated", wholetext=False).withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    # One text is one row by its nature: its lines meet here in their order.
    one = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_file", "_at", "value"))), lambda x: x["value"]), "\n").alias("text"))
    told = spark.read.json(f"{path}/metadata").agg(F.count("*").alias("total_documents"), F.sum("words").alias("total_words"), F.sum("images").alias("total_images"), F.sum("tables").alias("total_tables"))
    listed = spark.read.parquet(f"{path}/elements").agg(F.collect_list(F.when(F.col("element_type") == "image", F.struct(F.col("element_id").alias("image_id"), "page", "width", "height", "path", "source_doc"))).alias("images"), F.collect_list(F.when(F.col("element_type") == "table", F.struct(F.col("element_id").alias("table_id"), "page", "rows", "cols", "source_doc"))).alias("tables"))
    return one.join(told, F.lit(True)).join(listed, F.lit(True)).select(F.lit(0).cast("long").alias("doc_id"), F.lit(path).alias("path"), F.lit("consolidated").alias("name"), F.lit("preprocessed").alias("type"), F.lit("high").alias("priority"), "*")


def json_documents(files: DataFrame) -> DataFrame:
    """file_id, nth, name, content of the ``documents`` of JSON texts; no name is "document_n", no content empty."""
    parsed = files.withColumn("d", F.from_json("text", "documents array<struct<name:string,content:string>>"))
    rows = parsed.select("file_id", F.posexplode("d.documents").alias("nth", "x"))
    return rows.select("file_id", "nth", F.coalesce("x.name", F.concat(F.lit("document_"), F.col("nth").cast("string"))).alias("name"), F.coalesce("x.content", F.lit("")).alias("content"))
