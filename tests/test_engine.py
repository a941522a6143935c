"""Sources, sinks, plans, links, vectors and streaming on small files."""
import io
import json
import zipfile

import pytest
from pdfs import sample
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import linking, stats, vectors
from loomline.plans.indexing import Indexing, chunks_with_metadata, index_collection
from loomline.plans.rag import BAD_CALL, BAD_STATUS, NOTHING_FOUND, Answering, HttpModel
from loomline.sources import files, markup, sinks
from loomline.streaming import ingest


def docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p>{s}<w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Head", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("Body text.") + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        z.writestr("word/media/one.png", b"img")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/one.png"/></Relationships>')
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "sub").mkdir()
    (d / "a.txt").write_text("Plain text. It has two sentences.", encoding="utf8")
    (d / "latin.TXT").write_bytes("caffè".encode("latin-1"))
    (d / "wide.txt").write_bytes("wide à".encode("utf-16"))
    (d / "b.md").write_text("# Title\n\nBody ![x](i.png)", encoding="utf8")
    (d / "sub/key.html").write_text("<html><title>T</title><script>no()</script><p>Hello</p><table><tr><td>row</td></tr></table></html>", encoding="utf8")
    (d / "c.json").write_text('{"k": 1, "documents": [{"name": "n", "content": "inside"}]}', encoding="utf8")
    (d / "d.docx").write_bytes(docx())
    (d / "e.bin").write_bytes(b"x")
    (d / "f.pdf").write_bytes(sample())
    (d / "bad.pdf").write_bytes(b"no")
    (d / "bad.json").write_text("{", encoding="utf8")
    return str(d)


def test_scan_and_load(spark, folder):
    m = files.scan_directory(spark, folder, keyword="key")
    assert {r.name: r.priority for r in m.collect()} == {"wide.txt": "low", "f.pdf": "medium", "bad.pdf": "medium", "a.txt": "low", "latin.TXT": "low", "b.md": "low", "key.html": "high", "c.json": "low", "d.docx": "low", "bad.json": "low"}
    assert files.by_priority(m, 1).first()["name"] == "key.html"
    assert files.scan_directory(spark, folder, recursive=False).count() == 9
    d = {r.name: r for r in files.load(files.scan_directory(spark, folder, content=True)).collect()}
    assert d["a.txt"].text.startswith("Plain") and d["a.txt"].encoding == "utf-8" and len(d["a.txt"].file_hash) == 64
    assert d["wide.txt"].text == "wide à" and d["wide.txt"].encoding == "utf-16-le"
    assert d["latin.TXT"].text == "caffè" and d["latin.TXT"].encoding == "latin-1"
    assert d["key.html"].text == "T\nHello\nrow\n" and d["key.html"].title == "T" and d["bad.json"].failed and d["c.json"].json_keys == ["k", "documents"]
    assert [t.content for t in d["key.html"].tables] == [[["row"]]] and d["b.md"].images[0].src == "i.png" and d["b.md"].sections[0].title == d["b.md"].title == "Title"
    assert d["d.docx"].tables[0].content == [["a", "b"]] and d["d.docx"].sections[0].style == "Heading1" and d["d.docx"].images[0].data == "aW1n"
    assert d["f.pdf"].page_count == 3 and d["f.pdf"].title == "Made" and d["f.pdf"].pdf_metadata == {"title": "Made", "author": "È"} and d["bad.pdf"].failed
    assert [(i.image_id, i.width, i.height, i.format) for i in d["f.pdf"].images] == [("p1_img1", 2, 1, "PNG"), ("p1_img2", 1, 1, "PNG"), ("p2_img1", 7, 9, "JPEG")]
    assert [(t.table_id, t.rows, t.cols, t.content[1]) for t in d["f.pdf"].tables] == [("p1_t1", 3, 2, ["a", "1"])]
    assert "\n[IMMAGINE_p1_img2]\n\n[TABELLA_p1_t1]\n\n\nAfibd" in d["f.pdf"].text and d["f.pdf"].sections[2].title == "Pagina 3"
    bare = files.load(files.scan_directory(spark, folder, content=True), files.Loader(images=False, tables=False)).where("name = 'f.pdf'").first()
    assert bare.images == bare.tables == [] and "[" not in bare.text and not bare.has_images
    assert json.loads(d["c.json"].text)["k"] == 1 and '\n  "k"' in d["c.json"].text
    assert d["d.docx"].text == "Head\n\nBody text.\n\n[TABELLA_table_1]\n\n[IMMAGINE_img_1]"


def test_indexing_writes_artefacts(spark, folder, tmp_path):
    s = Indexing().run(spark, folder, str(tmp_path)).first()
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    assert s.total_chunks == chunks.count() and s.total_documents == 8
    told = spark.read.json(f"{tmp_path}/metadata").first()
    assert told.statistics.total_chunks == s.total_chunks and (told.multimodal_statistics.total_images, told.multimodal_statistics.total_tables) == (5, 3)
    assert json.loads(told.multimodal_config)["placeholders"] == "True"
    index = spark.read.parquet(f"{tmp_path}/retrieval_index")
    assert index.where("id rlike '^[0-9a-f]{8}_[0-9]+$'").count() == s.total_chunks and index.where("metadata['name'] = 'f.pdf'").count() > 0
    linked = {(x.element_type, x.element_id) for r in index.where("metadata['name'] = 'f.pdf'").collect() for x in r.linked_elements}
    assert linked >= {("image", "p1_img1"), ("image", "p1_img2"), ("image", "p2_img1")}
    images = spark.read.json(f"{tmp_path}/multimodal_manifest/images")
    assert {r.image_id for r in images.where("source_doc = 'f.pdf'").collect()} == {"p1_img1", "p1_img2", "p2_img1"}
    assert spark.read.json(f"{tmp_path}/multimodal_manifest/tables").where("table_id = 'p1_t1'").first()["rows"] == 3
    assert spark.read.parquet(f"{tmp_path}/element_lookup").where("element_id = 'p2_img1'").count() == 1
    per = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/document_statistics").collect()}
    assert len(per) == 10 and sum(r.chunks for r in per.values()) == s.total_chunks and {r.avg_tokens for r in per.values() if not r.chunks} == {None}
    assert Indexing(limit=2).documents(spark, folder).count() == 2
    n = index_collection(spark, str(tmp_path), f"{tmp_path}/collection", vectors.hashing_embedding(16))
    assert n == s.total_chunks == index_collection(spark, str(tmp_path), f"{tmp_path}/collection", vectors.hashing_embedding(16), reset=True)
    held = vectors.open_collection(spark, f"{tmp_path}/collection").where("metadata['file_name'] = 'f.pdf'").first()
    assert held.metadata["token_count"] and held.metadata["char_count"] and vectors.open_collection(spark, f"{tmp_path}/none").count() == 0
    m = chunks_with_metadata(chunks).where("has_multimodal and metadata['name'] = 'f.pdf'").collect()
    assert {x for r in m for x in r.multimodal.images} == {"p1_img1", "p1_img2", "p2_img1"} and all("title" in r.metadata for r in m)


def test_html_parser(spark):
    html = "<title>My <b>t</b></title><style>p{}</style><h2>Sec</h2><img src=a alt=b><table><tr><th>H1</th><th>H2</th></tr><tr><td>1</td><td>2</td></tr></table><script>x</script>tail &amp; end"
    r = markup.parse_html(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert [tuple(s) for s in r[0].sections] == [("Sec", 2)] and r[0].images[0].src == "a" and r[0].images[0].image_id == "html_img_1"
    assert r[0].tables[0].content == [["H1", "H2"], ["1", "2"]] and "tail & end" in r[0].content and "p{}" not in r[0].content
    assert r[1].content == r[2].content == "" and r[2].title is None


_HEADINGS = [
    '<h1>token = &quot;0b96&quot; &amp; &lt;b&gt;</h1>',
    "<H2 class=a\nid=b> \t<i>Two\nlines</i> &amp;lt; &ampx &#38; </H2>text<h3>\x0bthird\u00a0</h3>",
    "<script>s = '<h4>in a script</h4>'</script><!-- <h5>in a comment</h5> --><h6></h6><h1><>x</h1>",
    "<h1>left open <h2>other end</h3><h1 <b>odd</b></h1><header>no</header><h7>no</h7><h1>no end",
    "<h1</h1>", "<h1></h1>\n", "<h2>$1 \\ &gt</h2>", "", None,
]


def test_html_sections_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(list(enumerate(_HEADINGS)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()["html_sections"]).fetchall()
    got = [(r.page_id, r.level, r.title) for r in entry.queries()["html_sections"](spark, str(tmp_path)).collect()]
    assert (0, 1, "token = &quot;0b96&quot; & <b>") in got and len(got) > 10
    assert sorted(got) == sorted(want)


def test_html_parser_holds_no_batch_of_pages(spark):
    import pyarrow as pa

    page = "<title>é &amp; t</title><h1>a <b>c</b></h1><p>" + "x y " * 50_000 + "</p><img src=s><table><tr><td>1</td></tr></table>"
    pages = [page, None, "", "<p>"] * 50
    parts = list(markup._parsed(iter([pa.RecordBatch.from_pydict({"k": list(range(200)), "h": pages}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "h": pa.array([], pa.string())})]), "k", "h"))
    assert max(p.nbytes for p in parts) < 3 << 20 < sum(p.nbytes for p in parts) / 2
    got = [r for p in parts for r in p.to_pylist()]
    assert [r["k"] for r in got] == list(range(200)) and {r["title"] for r in got} == {"é & t", None}
    d = spark.createDataFrame([(None if i == 8 else i, h) for i, h in enumerate(pages)], "k long, h string").coalesce(1)
    kept = [r.asDict(recursive=True) for r in markup.parse_html(d, "k", "h").collect()]
    assert [r | {"k": i} for i, r in enumerate(kept)] == got and kept[8]["k"] is None and kept[0]["tables"][0]["content"] == [["1"]]


def test_preprocessed_directory(spark, tmp_path):
    (tmp_path / "x.txt").write_text("DOCUMENTO 1: One\n====\ncontent\n", encoding="utf8")
    (tmp_path / "y.json").write_text('{"documents": [{"name": "n", "content": "c"}, {"name": "empty"}]}', encoding="utf8")
    assert sorted((r.name, r.text) for r in files.preprocessed_directory(spark, str(tmp_path)).collect()) == [("One", "content"), ("n", "c")]


def test_consolidated_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(1, "A", "x/a.txt", "text", "body one", 2), (2, "B", "b.pdf", "pdf", "body two", 1)], "doc_id long, title string, source_path string, file_type string, text string, place int")
    sinks.write_consolidated(d, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    back = markup.documento_blocks(spark.createDataFrame([(1, text)], "file_id long, text string"))
    assert {r.name for r in back.collect()} == {"A", "B"} and "body two" in back.where("name = 'B'").first()["text"]


def test_cleaners_keep_references(spark):
    d = spark.createDataFrame([("See  [IMMAGINE_a  b].Next\n\n\n\nﬁne­ [TABELLA_t]",)], "t string")
    r = d.select(T.processor_clean(F.col("t")).alias("p"), T.extractor_clean(F.col("t")).alias("e")).first()
    assert "[IMMAGINE_a  b]. Next\n\nfine" in r.p and "[TABELLA_t]" in r.p and r.e.startswith("See [IMMAGINE_a  b]. Next\n\nfine")


def test_describe_elements(spark):
    d = spark.sql("select '[IMMAGINE_i] and [TABELLA_t]' c, array(named_struct('image_id','i','width',3,'height',cast(null as int),'ocr_text','seen')) i, array(named_struct('table_id','t','rows',1,'cols',2,'text_representation','a | b')) t")
    assert d.select(T.describe_elements(F.col("c"), F.col("i"), F.col("t")).alias("o")).first()["o"] == "[Immagine: i - Dimensioni: 3xpx - Testo OCR: seen...] and [Tabella t: 1 righe x 2 colonne]\na | b"


def test_search_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.id, r.score) for r in vectors.search(v, q, 3).orderBy("query_id", "rank").collect()] == [(1, 1, 1, 1.0), (1, 2, 4, 1.0), (1, 3, 2, 0.0)]
    assert vectors.search(v.limit(0), q).count() == 0 and vectors.search(v, q.limit(0)).count() == 0
    assert vectors.search_with_threshold(v, q, 4, 0.0).count() == 3


def test_answering(spark):
    chunks = spark.createDataFrame([("the red fox runs", "a.txt", 0), ("blue whales swim deep", "b.txt", 1)], "content string, file_name string, chunk_index int")
    a = Answering(vectors.store(chunks, vectors.hashing_embedding(1024)), embed=vectors.hashing_embedding(1024), threshold=0.3)
    r = a.answer("red fox")
    assert "the red fox runs" in r.answer and r.sources[0]["metadata"]["file_name"] == "a.txt" and 0.3 <= r.confidence <= 1
    assert r.answer.endswith("\n\n📚 Fonti utilizzate:\n1. a.txt - Chunk #0 (Rilevanza: %.2f%%)" % (100 * r.sources[0]["relevance_score"]))
    assert r.sources[0]["text_preview"] == "the red fox runs..." and "Fonti" not in a.answer("red fox", include_sources=False).answer
    assert a.answer("zzz qqq").answer == NOTHING_FOUND and a.answer("zzz qqq").sources == []
    q = spark.createDataFrame([(7, "blue whales"), (8, "zzz"), (9, "red fox {context}")], "query_id long, text string")
    got = {x.query_id: x for x in a.answers(q).collect()}
    assert "swim" in got[7].answer and got[8].answer == NOTHING_FOUND and got[8].confidence == 0 and "fox" in got[9].answer
    said = []
    lines = iter(["help", "", "red fox", "QUIT"])
    a.chat(lambda _: next(lines), said.append)
    assert len(said) == 2 and "the red fox runs" in said[1]
    a.chat(lambda _: (_ for _ in ()).throw(EOFError()), said.append)


def test_http_model():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def _reply(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self._reply(200, {"models": []})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self._reply(500 if asked["prompt"].endswith("fail") else 200, {"response": f"{asked['prompt']}|{asked['options']['num_predict']}|{asked['stream']}"})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    m = HttpModel(f"http://127.0.0.1:{server.server_port}")
    assert m.healthy() and m.generate("q", "be brief", 9) == "be brief\n\nq|9|False" and m.generate("fail") == BAD_STATUS
    server.shutdown()
    server.server_close()
    assert not m.healthy() and m.generate("q").startswith(BAD_CALL)


def test_stats_of_nothing(spark):
    c = spark.createDataFrame([], "doc_id long, char_count int, token_count int, has_multimodal boolean, multimodal_refs array<string>, is_table_chunk boolean")
    assert stats.chunk_validation(c).count() == 0 and stats.pipeline_stats(c).count() == 0


def test_lookup_types(spark):
    e = spark.createDataFrame([(1, "p1_img1", "image"), (1, "p1_t1", "table")], "doc_id long, element_id string, element_type string")
    assert linking.lookup(e, "p1_t1").count() == 1 and linking.lookup(e, "p1").count() == 0 and linking.lookup(e, "p1_t1", "image").count() == 0


def test_stream_ingest(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "One here. Two there."), (2, "")], "doc_id long, text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):  # a second run finds nothing new
        ingest.ingest(spark, src, schema, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.doc_id, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "One here. Two there.")]


def test_windowed_counts(spark):
    d = spark.sql("select timestamp'2024-01-01 00:01:00' ts, 's' source, 'abcdefgh' text")
    assert ingest.counts_by_source(d).first()["tokens"] == 2


def test_preprocessing(spark, folder, tmp_path):
    from loomline.plans.preprocess import Preprocessing

    t = Preprocessing().run(spark, folder, str(tmp_path)).first()
    meta = spark.read.json(f"{tmp_path}/metadata").orderBy("place").collect()
    assert t.total_documents == len(meta) == 8 and [r.place for r in meta] == list(range(1, 9)) and (t.total_images, t.total_tables) == (5, 3)
    assert meta[0].type == "pdf" and meta[0].images == 3 and meta[0].sections_count == 3 and [r.words for r in meta[1:]] == sorted((r.words for r in meta[1:]), reverse=True)
    text = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/consolidated").collect())
    assert text.startswith("=" * 80) and "1. Made\n   Tipo: pdf | Parole: " in text and " | Immagini: 3 | Tabelle: 1" in text and "Immagini totali: 5" in text
    assert text.index("INDICE") < text.index("DOCUMENTO 1: Made") < text.index("DOCUMENTO 8: ") < text.index("RIEPILOGO FINALE") and "[Fine documento 8]" in text
    assert "[Immagine: p1_img1 - Dimensioni: 2x1px]" in text and "[Tabella p1_t1: 3 righe x 2 colonne]\nname | value" in text and "  - p2_img1: 7x9px" in text
    assert spark.read.json(f"{tmp_path}/manifest/images").where("id = 'p1_img1'").first()["width"] == 2
    assert {bytes(r["data"])[:2] for r in spark.read.parquet(f"{tmp_path}/images").collect()} == {b"\x89P", b"\xff\xd8", b"im"}
    one = files.preprocessed_file(spark, str(tmp_path)).first()
    assert one.type == "preprocessed" and one.priority == "high" and one.total_documents == 8 and len(one.images) == 5 and one.text == text
    none = Preprocessing(images=False, tables=False).documents(spark, folder).where("name = 'f.pdf'").first()
    assert none.images == [] and "Immagine" not in none.text


def test_imports_need_no_session():
    import subprocess
    import sys

    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=files.__file__.rsplit("/loomline/", 1)[0]).returncode == 0


def test_rest_stands_without_the_optional_part(tmp_path):
    """With the llm folders and the pipeline gone, the entry point still imports and keeps the engine's queries."""
    import shutil
    import subprocess
    import sys

    root = files.__file__.rsplit("/loomline/", 1)[0]
    shutil.copytree(f"{root}/loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0


def test_artefact_sinks(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "plain text", 2, False, [], False), (1, 1, "x" * 400, 100, True, ["[IMMAGINE_i]", "[TABELLA_q]"], False)], "doc_id long, chunk_index int, content string, token_count int, has_multimodal boolean, multimodal_refs array<string>, is_table_chunk boolean")
    e = spark.createDataFrame([(1, "i", "image"), (2, "q", "table")], "doc_id long, element_id string, element_type string")
    m = linking.with_links(c, e).where("has_multimodal").collect()
    assert [[tuple(x) for x in r.linked] for r in m] == [[("image", "i")]]
    x = {r.chunk_index: r.example for r in sinks.examples(c).collect()}
    assert x[0] == "plain text" and x[1] == "x" * 300 + "..."
    s = vectors.store(c.select("content", "chunk_index"), vectors.hashing_embedding(8))
    vectors.write_collection(s, str(tmp_path / "v"), reset=True)
    vectors.write_collection(s, str(tmp_path / "v"))
    back = vectors.open_collection(spark, str(tmp_path / "v"))
    assert back.count() == 4 and back.select("id").distinct().count() == 2
    sinks.write_export(back, str(tmp_path / "x"))
    assert set(spark.read.json(str(tmp_path / "x/documents")).columns) == {"id", "text", "metadata"} and spark.read.json(str(tmp_path / "x/header")).first()["total_documents"] == 4
    sinks.write_images(spark.createDataFrame([(1, "i", "aGk=")], "doc_id long, image_id string, data string"), str(tmp_path / "i"))
    assert bytes(spark.read.parquet(str(tmp_path / "i")).first()["data"]) == b"hi"
    sinks.write_chunks(c, str(tmp_path / "c"), json=True)
    assert spark.read.json(str(tmp_path / "c_json")).count() == 2


def test_search_in_blocks_equals_search(spark):
    import random

    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(5 if i % 9 else 4)]) for i in range(300)] + [(400, [0.0] * 5), (401, None), (None, [1.0] * 5)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = sorted(tuple(x) for x in vectors.search(v, q, 4).collect())
    assert len(want) == 30 * 4 and sorted(tuple(x) for x in vectors.search(v, q, 4, block=7).collect()) == want
    top = vectors._blocks_meet(v, q.where("query_id is not null"), 4, 7, rows=50)
    assert top.where("query_id = 10").count() > 4


def test_hashed_embedding(spark):
    import zlib

    e = vectors.hashing_embedding(8)
    rows = spark.createDataFrame([("Due parole, due",), ("",), (None,), ("è_x 9",)], "t string").select("t", e(F.col("t")).alias("e")).collect()
    want = [0.0] * 8
    for w in ("due", "parole", "due"):
        want[zlib.crc32(w.encode()) % 8] += 1
    norm = sum(x * x for x in want) ** 0.5
    assert rows[0].e == pytest.approx([x / norm for x in want], abs=1e-6) and rows[1].e == rows[2].e == [0.0] * 8 and sum(x > 0 for x in rows[3].e) == 2


def test_driver_gives_memory_back_after_a_table(spark):
    import re
    from pathlib import Path

    from loomline.scratch import free, materialise

    platform, mb = spark._jvm.org.apache.spark.unsafe.Platform, 1 << 10
    status = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    resident = lambda: int(re.search(r"Rss:\s+(\d+)", status.read_text())[1])
    free(materialise(spark.range(10), "warm"))
    # The last block keeps the C library from returning the others by itself.
    blocks = [platform.allocateMemory(1 << 16) for _ in range(3200)]
    for b in blocks:
        platform.setMemory(b, 1, 1 << 16)
    for b in blocks[:-1]:
        platform.freeMemory(b)
    before = resident()
    out = materialise(spark.range(10), "after")
    assert before - resident() > 100 * mb and out.count() == 10
    free(out)
    platform.freeMemory(blocks[-1])
