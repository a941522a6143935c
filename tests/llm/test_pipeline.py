"""The pipeline's stages against their operators' verdicts, and the whole against a plain version."""
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_search_and_join import components
from test_text_models import plain_counts

import corpus_pipeline
from loomline.llm import jaccard, mixing, packing, quality, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def test_stages_follow_their_operators(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    step = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(step) == ["toxicity", "quality rules", "n-gram jaccard join", "mixing sources", "best-fit packing"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    waiting = quality.quality(docs), jaccard.join(docs)  # built before, read after the stages' tables have gone
    a = step["toxicity"](spark, docs, DATA).cache()
    assert ids(a) == sorted(r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted)
    b = step["quality rules"](spark, a, DATA).cache()
    assert ids(b) == sorted(r.doc_id for r in quality.quality(a).collect() if r.kept)
    c = step["n-gram jaccard join"](spark, b, DATA).cache()
    assert ids(c) == sorted(r.doc_id for r in jaccard.join(b).collect() if r.doc_id == r.component_id)
    d = step["mixing sources"](spark, c, DATA).cache()
    assert d.count() == sum(math.floor(r.taken / max(1, r.size) + 0.5) for r in mixing.mix(c).collect())
    for x in (a, b, c, d):
        assert x.columns == docs.columns
    e = step["best-fit packing"](spark, d, DATA)
    assert e.select("sequence_id").distinct().count() == packing.pack(d).select("sequence_id").distinct().count()
    assert corpus_pipeline.run(spark, DATA).count() == e.count()
    assert [x.count() for x in waiting] == [docs.count()] * 2


def plain_pipeline(rows, score):
    """Rows (doc_id, text, lang, source) of the last stage's pieces: (doc_id, piece, start, length)."""
    import duckdb
    import pandas as pd
    from tokenizers import Tokenizer

    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    # Quality rules.
    norm = lambda x: " ".join(x.lower().split())
    texts, held = defaultdict(set), defaultdict(set)
    for _, t, _, s in rows:
        texts[s].add(t)
        for x in (t or "").split("\n"):
            if WORD.search(x):
                held[s, norm(x)].add(t)
    bad = {k for k, v in held.items() if len(v) > max(quality.MIN_LINE_DOCS, quality.LINE_SHARE * len(texts[k[0]]))}
    kept = []
    for i, t, lang, s in rows:
        lines = (t or "").split("\n")
        gone = [x for x in lines if WORD.search(x) and (s, norm(x)) in bad]
        if not plain_counts(t)[5] and sum(len(WORD.findall(x)) for x in gone) <= quality.MAX_LOST * len(WORD.findall(t or "")):
            kept.append((i, "\n".join(x for x in lines if not (WORD.search(x) and (s, norm(x)) in bad)) if gone else t, lang, s))
    # One row of each component.
    comp = components([(k, t) for k, (_, t, _, _) in enumerate(kept)])
    groups = defaultdict(list)
    for k, n, c in comp:
        groups[c if n else ("alone", k)].append(kept[k])
    # By id and text's hash, which a plain version does not have: among rows of one id any text may stay.
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    # Mix: its SQL.
    c = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841  DuckDB reads it by name
    c.execute("create table documents as select * from documents")
    mixed = c.execute(mixing.ORACLE).fetchdf()
    taken = {}
    for r in mixed.itertuples(index=False):
        v = r._asdict()
        taken[None if pd.isna(v["doc_id"]) else int(v["doc_id"]), v["source"] if isinstance(v["source"], str) else None, int(v["size"])] = v["taken"]
    out = Counter()
    tok = Tokenizer.from_file(packing.tokenizer_file())
    for i, t, _, s in rows:
        size = len(WORD.findall(t or ""))
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        for a in range(0, n, packing.CAPACITY):
            out[i, a // packing.CAPACITY, a, min(packing.CAPACITY, n - a)] += math.floor(taken[i, s, size] / max(1, size) + 0.5)
    return Counter({k: v for k, v in out.items() if v})


def test_run_equals_a_plain_version(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    base = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    own = lambda k: " ".join(f"own{k}x{j}" for j in range(80))
    extra = [(None, own("n1"), "en", None), (None, own("n2"), None, "src1"), (9001, own("r"), "en", "src1"), (9001, own("r"), "en", "src1"), (9002, own("r") + " end", "en", "src2"), (9003, None, None, None), (9004, "", "en", "src1"), (9005, own("long") + " word" * 9000, "en", "src1"), (9006, own("l2") + "\nmore lines stand here", "de", "newsrc")]
    extra += [(9100 + k, f"{own(k)}\nThe same   line of this host\nx", "en", "lines") for k in range(30)]
    table = spark.createDataFrame(base + extra, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    got = Counter((r.doc_id, r.piece, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = plain_pipeline(base + extra, lambda t: toxicity.score_texts(model, pa.array([t], pa.string()))[0])
    assert got == want and sum(want.values()) > 60


@pytest.mark.parametrize("n_labels", [0, 5])
def test_run_of_an_empty_table(spark, tmp_path, n_labels):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").limit(n_labels).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
