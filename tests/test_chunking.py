"""Chunkers against a plain row-by-row version, on documents and on texts with references."""
import re

import pytest

from loomline.operators import chunking
from loomline.plans import fixtures as X

REF = re.compile(r"\[(IMMAGINE|TABELLA|GRAFICO|FIGURA)_([^\]]+)\]")
TARGET, MOST = 350, 450


def tok(t):
    return len(t) // 4


def sentences(t):
    # References hold no sentence break in these texts.
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", t) if s.strip()]


def pack(t):
    out, cur, n = [], [], 0
    for s in sentences(t):
        if cur and n + tok(s) > TARGET:
            out.append(" ".join(cur))
            cur, n = [], 0
        cur.append(s)
        n += tok(s)
    return out + ([" ".join(cur)] if cur else [])


def semantic(t):
    out, cur, n = [], [], 0

    def flush():
        nonlocal cur, n
        if cur:
            out.append("\n\n".join(cur))
        cur, n = [], 0

    for p in (p.strip() for p in t.split("\n\n")):
        if not p:
            continue
        if tok(p) > MOST:
            flush()
            out.extend(pack(p))
        elif REF.search(p):
            flush()
            out.append(p)
        else:
            if cur and n + tok(p) > TARGET:
                flush()
            cur.append(p)
            n += tok(p)
    flush()
    return out


def sliding(t):
    s, out, i = sentences(t), [], 0
    while i < len(s):
        cur, n, j = [], 0, i
        while j < len(s) and n < TARGET and n + tok(s[j]) <= MOST:
            cur.append(s[j])
            n += tok(s[j])
            j += 1
        if cur:
            out.append(" ".join(cur))
        i += max(1, len(cur) - 2)
    return out


def hierarchical(t):
    out, cur = [], []
    for line in t.split("\n"):
        title = re.match(r"^#+\s+(.+)$|^([A-Z][^.!?]{3,50})$", line.strip()) and len(line) < 100 and not REF.search(line)
        if title:
            if cur:
                out.append("\n".join(cur))
            cur = []
        else:
            cur.append(line)
    if cur:
        out.append("\n".join(cur))
    return [c for s in out for c in ([s] if tok(s) <= TARGET else semantic(s))]


def multimodal(t):
    out, last = [], 0
    for m in REF.finditer(t):
        if m.start() > last and t[last : m.start()].strip():
            out.append(("text", t[last : m.start()].strip()))
        end = min(len(t), m.end() + 200)
        out.append(("table" if m[1] == "TABELLA" else "ref", t[max(0, m.start() - 200) : end]))
        last = end
    if t[last:].strip():
        out.append(("text", t[last:].strip()))
    return [c for k, s in out for c in ([s] if k == "table" or tok(s) <= TARGET else pack(s))]


PLAIN = {"semantic": semantic, "sliding_window": sliding, "hierarchical": hierarchical, "multimodal_aware": multimodal}
LONG = "Word " * 500 + "ends. " + "Short one. " * 300
TEXTS = [*(t for _, t in X.MM + X.SECTIONS + X.CLEAN), LONG, "Para one.\n\n" + LONG + "\n\nSmall [IMMAGINE_q] here.\n\nLast para.", "x. Y\n\n\n\n z ", "A." * 900]


@pytest.mark.parametrize("strategy", sorted(PLAIN))
def test_equals_plain_version(spark, strategy):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = {}
    for r in chunking.chunk(spark.createDataFrame(rows, "doc_id long, text string"), strategy).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
        assert r.token_count == r.char_count // 4
    assert got == {i: c for i, t in rows if (c := PLAIN[strategy](t))}


def test_nulls_empty_and_unknown_strategy(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "Some text.")], "doc_id long, text string")
    assert [tuple(r) for r in chunking.chunk(d, "no such").select("doc_id", "content").collect()] == [(None, "Some text.")]
    assert chunking.chunk(d.limit(0), "sliding_window").count() == 0


def test_table_chunks_stay_whole(spark):
    d = spark.createDataFrame([(1, "x " * 2000 + "[TABELLA_t1] " + "Y z. " * 2000)], "doc_id long, text string")
    rows = chunking.chunk(d, "multimodal_aware").where("is_table_chunk").collect()
    assert len(rows) == 1 and list(rows[0].multimodal_refs) == ["t1"]
