"""Token counts, packing and mixing: exact round trips and edge cases."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import mixing, packing, tokencount

DATA = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "A null id, here."), (5, "Same text."), (5, "Same text."), (6, "word " * 9000), (7, "naïve café… é İ ǅ <|endoftext|> x"), (8, "don't won't. 'tis, (ok)! ..., a.b,c 12.5")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    return base.unionByName(spark.createDataFrame(ODD, SCHEMA)).repartition(3).cache()


def test_scan_stitches_blocks(spark):
    files = {1: [[5, 5, 9], [9, 9], [3], [4], [9, 7]], 2: [[1], [2, 2]], 3: [[9], [9]], 4: [[1]] * 7 + [[9]]}
    rows = [(f, i, np.array(a, "<u2").tobytes()) for f, bl in files.items() for i, a in enumerate(bl)]
    for segment in (2, 1024):
        tokencount.SEGMENT = segment
        got = sorted(tuple(r) for r in tokencount.scan(spark.createDataFrame(rows, "file int, block long, data binary"), end=9).collect())
        want = []
        for f, bl in files.items():
            docs, cur = [], 0
            for x in sum(bl, []):
                docs, cur = (docs + [cur], 0) if x == 9 else (docs, cur + 1)
            want += [(f, i, n, True) for i, n in enumerate(docs)] + ([(f, len(docs), cur, False)] if cur else [])
        assert got == sorted(want)


def test_scan_of_real_files(spark, tmp_path):
    for name, ids in (("a.bin", [1, 2, 9, 9, 4]), ("b.bin", []), ("c.bin", list(range(10, 60)) + [9])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    blocks = tokencount.read_token_files(spark, str(tmp_path), block_ids=7)
    got = sorted((r.file.rsplit("/", 1)[1], r.nth, r.n_tokens, r.closed) for r in tokencount.scan(blocks, end=9).collect())
    assert got == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 1, False), ("c.bin", 0, 50, True)]


def test_token_counts_equal_the_encoder(docs):
    import public_tokenizers

    enc = tokencount._encoder(open(tokencount.rank_file()).read(), public_tokenizers.PATTERN)
    want = Counter((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in tokencount.count_documents(docs).collect()) == want
    assert tokencount.count_documents(docs.limit(0)).count() == 0


def test_counts_of_clashing_columns_and_long_texts(spark):
    rows = [(1, "word " * 700_000, 5, 6, 7), (2, "a b", 1, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, file int, nth int, n_tokens int")
    assert sorted(tuple(r) for r in tokencount.count_documents(d).collect())[1][0] == 2 and tokencount.count_documents(d).columns == ["doc_id", "n_tokens"]
    assert tokencount.count_documents(d).where("doc_id = 1").first()["n_tokens"] > 600_000


def test_word_tokenizer_equals_the_library(docs):
    import pyarrow as pa
    from tokenizers import Tokenizer

    spec = open(packing.tokenizer_file()).read()
    texts = [r.text or "" for r in docs.collect()] + ["T̈ über Å", "…. ,., x..y", "a.B.c", "'s 'S it's ' s", "aé$$$b ÷, ×. Ã. é's É'LL a''s x<|y <|endoftext|>'s a<b>c (d) [e]f* ª. º, ß! ÿ? a_b-c/d e\u0301, x\u0338<", "<|startoftext|>a.b<|endoftext|>", " nbsp em. x"]
    ids, n = packing.WordTokenizer(spec).encode(pa.array(texts))
    lib = [e.ids + [1] for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in lib] and ids.tolist() == sum(lib, [])


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    rows = packing.pack(docs.withColumnsRenamed({}).selectExpr("*", "text as start", "1 as length")).collect()
    lib = Counter()
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            lib[r.doc_id, i // 4096, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == lib
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) == math.ceil(sum(r.length for r in rows) / 4096)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("histogram, best", [({6: 2, 4: 2}, 2), ({10: 3}, 3), ({7: 1, 5: 1, 3: 2, 2: 1}, 2), ({9: 1, 8: 1, 6: 2}, 4), ({3: 4, 7: 2, 5: 1, 4: 1, 1: 1}, 4), ({}, 0)])
def test_plan_is_best(histogram, best):
    p = packing.plan(histogram, 10)
    assert sum(p.rows[:, 2]) == sum(histogram.values()) and (p.rows[:, 4] + p.rows[:, 2] // p.rows[:, 3]).max(initial=0) == p.sequences == best
    assert p.proved and p.bound <= best


def fewest(items, capacity):
    """Sequences needed, by dynamic programming over all subsets."""
    best = [(0, 0)]
    for m in range(1, 1 << len(items)):
        tries = []
        for i, x in enumerate(items):
            if m >> i & 1:
                n, held = best[m ^ 1 << i]
                tries.append((n, held + x) if n and held + x <= capacity else (n + 1, x))
        best.append(min(tries))
    return best[-1][0]


def test_plan_equals_brute_force():
    r, beaten = random.Random(1), 0
    for _ in range(400):
        capacity = r.choice([10, 30, 100, 100])
        items = [r.randint(1, r.choice([capacity // 3, capacity * 7 // 10, capacity])) for _ in range(r.randint(1, 11))]
        p, fit = packing.plan(Counter(items), capacity), packing.best_fit(Counter(items), capacity)
        need = fewest(items, capacity)
        assert p.bound <= need == p.sequences and p.proved, (items, capacity)
        assert Counter(k for f, m in fit for k, n in f.items() for _ in range(n * m)) == Counter(items)
        assert all(sum(k * n for k, n in f.items()) <= capacity for f, _ in fit)
        beaten += sum(m for _, m in fit) > need
    assert beaten
    assert packing.plan(Counter([51, 67, 20, 46, 63, 31, 17, 15, 24, 57, 52, 45]), 100).sequences == 5


def test_a_spent_budget_says_so():
    items = [random.Random(3).randint(700, 2200) for _ in range(1)] + [random.Random(k).randint(700, 2200) for k in range(300)]
    p = packing.plan(Counter(items), nodes=500)
    assert p.bound <= p.sequences and (p.proved or p.bound < p.sequences)
    assert p.sequences <= sum(m for _, m in packing.best_fit(Counter(items)))


def test_mixing_totals(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(900, None, None), (901, "a b c", None), (None, "x y", "src1"), (902, "", "new"), (903, "one two three four", "new"), (903, "one two three four", "new")], "doc_id long, text string, source string")
    rows = mixing.mix(d.select("doc_id", "text", "source").unionByName(odd)).collect()
    assert len(rows) == d.count() + 6
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    names = sorted((k for k in by if k is not None), key=lambda k: [ord(c) for c in k]) + [None]
    weights = {k: i % 3 + 1 for i, k in enumerate(names)}
    sizes = {k: sum(r.size for r in by[k]) for k in names}
    full, targets = set(), {}
    while True:
        free = total - sum(3 * sizes[k] for k in full)
        targets = {k: 3 * sizes[k] if k in full else free * weights[k] / sum(weights[j] for j in names if j not in full) for k in names}
        over = {k for k in names if k not in full and targets[k] > 3 * sizes[k]}
        if not over:
            break
        full |= over
    for k in names:
        assert all(r.source_size == sizes[k] and abs(r.target - targets[k]) < 1e-6 * total for r in by[k])
        assert abs(sum(r.taken for r in by[k]) - targets[k]) <= 0.01 * targets[k] + 3
    assert mixing.mix(d.limit(0)).count() == 0
    assert mixing.mix(odd.where("text is null or text = ''")).agg({"taken": "sum"}).first()[0] == 0


def test_mixed_documents_follow_the_mix(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = Counter(r.doc_id for r in mixing.mixed_documents(d).select("doc_id").collect())
    want = {r.doc_id: n for r in mixing.mix(d).collect() if (n := math.floor(r.taken / max(1, r.size) + 0.5))}
    assert got == want and mixing.mixed_documents(d).schema == d.schema


def test_mixing_of_many_small_sources(spark):
    # 200 sources of three words beside one of 1.2 million words, with blocks of some 300 words.
    rows = [(i, "a b c", f"s{i}") for i in range(200)] + [(1000 + i, "w " * 3000, "big") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=4096).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    assert all(abs(sum(r.taken for r in held) - held[0].target) <= (3 if k != "big" else 600) for k, held in by.items())


@pytest.mark.parametrize("slots", [1 << 20, 1000])
def test_mixing_sql_at_every_block_size(spark, slots, monkeypatch):
    import duckdb

    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source")
    d = d.unionByName(spark.createDataFrame([(5000 + i, "w " * 50, "tiny") for i in range(3)], d.schema))
    c = duckdb.connect()
    documents = d.toPandas()  # noqa: F841  DuckDB reads it by name
    sql = mixing.ORACLE.replace(str(mixing.SLOTS), str(slots))
    cur = c.execute(sql)
    got = mixing.mix(d, slots=slots).select(*[x[0] for x in cur.description]).collect()
    same = lambda rows: sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert same(got) == same(cur.fetchall())


def test_mixed_documents_keep_clashing_columns(spark):
    d = spark.createDataFrame([(i, "some words here", "s", 7, "x", 1.5) for i in range(9)], "doc_id long, text string, source string, _size int, times string, copy double")
    out = mixing.mixed_documents(d)
    assert out.schema == d.schema and {(r._size, r.times, r.copy) for r in out.collect()} == {(7, "x", 1.5)}


@pytest.mark.parametrize("slots", [1 << 20, 1000, 20])
def test_mixing_reaches_small_sources(spark, slots):
    # Blocks of 1, about 170 and about 8,350 words: sources of 1,000 words or fewer lie under a block at the last.
    sizes = {"a": 1000, "b": 6000, "c": 100000, "d": 30000, "e": 30000, "f": 7}
    rows = [(1000 * k + i, "w " * (n // 5 if n >= 5 * 200 or i else 1), s) for k, (s, n) in enumerate(sizes.items()) for i in range(5)]
    got = defaultdict(list)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=slots).collect():
        assert 0 <= r.taken <= 3 * r.size
        got[r.source].append(r)
    for held in got.values():
        assert abs(sum(r.taken for r in held) - held[0].target) <= 3
