"""Both cleaners against plain versions, on documents and on awkward rows."""
import re
import unicodedata

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.plans import fixtures as X

MORE = ["ﬁne ½ ① x", "page sep\n12 \n\nnext", "soft­hyphen zero​width\r\n", "\u001cedge\u001f", "ÉABCDEFGHIJ ABCDEFGHIJK1 x", "a@b.c http://x y", "[IMMAGINE_a  b] [TABELLA_x].Next [IMMAGINE_a  b]", "rep line here!\n" * 4 + "rep line here?\n" * 2]
# What is replaced by what.
LITERAL = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "–"), ("Ã¨", "è"), ("Ã©", "é"), ("Ã", "à"), ("Ã¹", "ù"), ("Ã²", "ò"), ("â‚¬", "€")]


def spaces(t):
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t))
    return "\n".join(x.strip() for x in t.split("\n"))


def keep(t, kinds):
    refs = [m for k in kinds for m in re.findall(rf"\[{k}_[^\]]+\]", t)]
    for i, r in enumerate(refs):
        t = t.replace(r, f"<<<PROTECTED_{i}>>>")
    return t, refs


def back(t, refs):
    for i, r in enumerate(refs):
        t = t.replace(f"<<<PROTECTED_{i}>>>", r)
    return t


def processor(t):
    t, refs = keep(t, ["IMMAGINE", "TABELLA", "GRAFICO", "FIGURA"])
    t = spaces(unicodedata.normalize("NFKC", t))
    for p in (r"^\d+\s*$", r"^[_\-=*]{3,}\s*$"):
        t = re.sub(p, "", t, flags=re.M)
    t = re.sub(r"([.!?,:;])([A-Z])", r"\1 \2", re.sub(r"([a-z])-\n([a-z])", r"\1\2", t))
    lines = t.split("\n")
    bad = {x for x in lines if 10 < len(x) < 100 and lines.count(x) >= 3}
    return back("\n".join(x for x in lines if x not in bad), refs)


def extractor(t):
    t, refs = keep(t, ["IMMAGINE", "TABELLA"])
    t = unicodedata.normalize("NFKC", t)
    for a, b in LITERAL:
        t = t.replace(a, b)
    t = "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\t\n")
    t = re.sub(r"([a-z])-\n([a-z])", r"\1\2", spaces(t))
    t = re.sub(r"\s+([.!?,:;])", r"\1", re.sub(r"([.!?,:;])([A-Za-z])", r"\1 \2", t))
    t = re.sub(r"\.{3,}", "...", re.sub("[‘’]", "'", re.sub("[“”]", '"', t)))
    for p in (r"^\d{1,4}\s*$", r"^Page \d+ of \d+\s*$", r"^[_\-=*]{3,}\s*$"):
        t = re.sub(p, "", t, flags=re.M)
    t = re.sub(r"\b[A-Z0-9]{10,}\b", "[CODE]", re.sub(r"\S+@\S+\.\S+", "[EMAIL]", re.sub(r"https?://\S+", "[URL]", t)))
    return back("\n".join(x for x in t.split("\n") if len(x) > 10 or x == ""), refs)


def test_cleaners_equal_plain_versions(spark):
    texts = [t for _, t in X.CLEAN + X.GARBLED + X.MM + X.SECTIONS] + MORE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in d.select("i", T.processor_clean(F.col("t"), "pdf").alias("p"), T.extractor_clean(F.col("t"), "pdf", True).alias("e")).collect():
        assert r.p == processor(texts[r.i]), texts[r.i][:200]
        assert r.e == extractor(texts[r.i]), texts[r.i][:200]


def test_nulls_stay_null(spark):
    d = spark.createDataFrame([(None,)], "t string")
    assert d.select(T.normalize_whitespace(F.col("t")), T.processor_clean(F.col("t")), T.extractor_clean(F.col("t")), T.tokens(F.col("t"))).first() == (None,) * 4


def test_nfkc_holds_no_batch_of_strings(spark):
    import pyarrow as pa

    texts = [None, "", "plain " * 40_000, "ﬁne ½ ① x " * 40_000, "é" * 10] * 12
    want = [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    parts = list(T._nfkc(iter([pa.array(texts), pa.array([], pa.string()), pa.array(texts)])))
    assert [t for p in parts for t in p.to_pylist()] == want * 2
    assert max(p.nbytes for p in parts) < 3 << 20 < sum(p.nbytes for p in parts) / 4
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.o for r in d.select("i", T.nfkc(F.col("t")).alias("o")).orderBy("i").collect()] == want
