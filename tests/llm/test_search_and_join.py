"""Top-k search, Jaccard join and quotation linking against brute force."""
import random
import re
import time

import pytest

from loomline.llm import jaccard, mixing, quotes, topk
from loomline.llm.common import scratch_dir

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[r.choice(words) for _ in range(r.choice([3, 6, 12, 30, 60]))] for _ in range(12)]
    passage, rows = [r.choice(words) for _ in range(40)], []
    for _ in range(220):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [r.choice(words)], [r.choice(words), r.choice(words)]])
            w = w or ["x"]
        if r.random() < 0.3:
            k = r.randrange(len(w) + 1)
            w[k:k] = passage[: r.choice([20, 40])]
        rows.append((r.randrange(10**6), " ".join(w)))
    return rows + [(9, None), (8, ""), (7, "  \n"), (5, "A b"), (6, "a B"), (6, "a B"), (None, "a b"), (None, "alone here"), (4, "é É"), (3, "é é")]


@pytest.mark.parametrize("seed", [0, 1])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(5)
    assert sorted((tuple(r) for r in jaccard.join(d).collect()), key=repr) == components(rows)


def test_join_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join(d).count() == 0
    assert [tuple(r) for r in jaccard.join(spark.createDataFrame([(1, None)], d.schema)).collect()] == [(1, 0, 1)]


def test_groups_of_equal_prefix_and_size(spark):
    # Long shared starts, all words equally frequent: prefixes and sizes agree, sets differ.
    texts = [" ".join(f"t{i}" for i in range(60)) + f" e{k} f{k}" for k in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)]
    assert sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()), key=repr) == components(rows)


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand here now"), (5, None), (5, None), (1, "a b c d e f"), (None, "z y")]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(d).collect()), key=repr)
    assert got == sorted([(1, "a b c d e f"), (2, "other words stand here now"), (5, None), (5, None), (None, "z y")], key=repr)
    assert jaccard.one_of_each(d).schema == d.schema


def test_one_of_each_by_text(spark):
    # Several null ids and one id over texts of different components; copies of one of them under other ids.
    x, y, z = "a b c d e f", "other words stand here now", "yet another text of some words"
    rows = [(None, x), (None, x), (None, y), (None, "alone"), (None, None), (None, None), (7, y), (7, z), (7, "p q"), (7, "p q"), (7, ""), (8, z), (4, z.upper()), (7, z.upper())]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, component_id int").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(d).collect()), key=repr)
    assert got == sorted([(None, x), (None, "alone"), (None, None), (None, None), (7, y), (7, "p q"), (7, ""), (4, z.upper())], key=repr)


def brute(rows, k, every):
    import math

    code = lambda e: [math.floor(64 * float(x)) for x in e]
    ok = [(i, code(e)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    asked = {}
    for i, e in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, e), e)
    for i, e in asked.items():
        hits = sorted((-sum(a * b for a, b in zip(e, f)), j) for j, f in ok if j != i)[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, asked", [(1 << 16, 128), (37, 3)])
def test_top_k_equals_brute_force(spark, block, asked):
    r = random.Random(block)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.25, 0.9]) for _ in range(6)]) for i in range(300)]  # many ties
    rows += [(20, rows[20][1]), (40, [0.1] * 6), (301, None), (None, [0.5] * 6), (302, [None] + [0.5] * 5), (303, [float("nan")] + [0.5] * 5), (304, [float("inf")] + [0.5] * 5), (305, []), (-20, [3.0] * 6)]
    d = spark.createDataFrame([(*x, 7) for x in rows], "vec_id long, embedding array<float>, score int")
    assert sorted(tuple(x) for x in topk.top_k(d, block=block, query_block=asked).collect()) == brute(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    d = spark.createDataFrame([(20, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in topk.top_k(d).collect()] == [(20, 1, 1, 2048)]
    assert topk.top_k(d.limit(0)).count() == 0 and topk.top_k(d.where("vec_id = 1")).count() == 0


def test_quotes_link_nested_levels(spark):
    import duckdb

    rows = [(1, 0, "user", "Hello  World\nsecond line\n\nthird"), (1, 1, "assistant", "> hello world\n> Second line\nI agree"), (1, 2, "user", ">> Hello world\n>> second line\n> I agree\nGood"), (1, 3, "user", "> nothing known\nx"), (1, 4, "user", "> third\n>\n> good\n> bad\nok"), (1, 5, None, "> ok\nyes"), (1, 6, "a", None), (None, 7, "a", "> ok"), (1, None, "a", "> ok"), (2, 1, "user", "> hello world"), (1, 5, None, "> good\nyes"), (1, 8, "a", "  > > I agree \n>third\nfin  "), (2, 2, "user", "")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, root int")
    got = quotes.link(d)
    at = {(r.conv_id, r.turn): r for r in got.collect()}
    assert [at[1, t].reply_to for t in range(5)] == [None, 0, 1, None, 0] and at[1, 2].root == 0 and at[1, 2].depth == 2
    assert at[1, 1].text == "I agree" and at[1, 1].chat == "<|assistant|>\nI agree" and at[1, 8].reply_to == 0
    c = duckdb.connect()
    c.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = c.execute(quotes.ORACLE)
    names = [x[0] for x in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())
    assert quotes.link(d.limit(0)).count() == 0


def threads(seed, n=120):
    """Messages of three conversations, most of which quote one before them."""
    r, rows = random.Random(seed), []
    for t in range(n):
        said = f"message {t} says {r.randrange(1000)}"
        c, earlier = t % 3, [x for x in rows if x[0] == t % 3]
        quote = [f"> {x}" for x in r.choice(earlier[-6:] if r.random() < 0.6 else earlier)[3].split("\n") if not x.startswith(">")] if earlier and r.random() < 0.8 else []
        rows.append((c, t * 1500, "user", "\n".join([*quote, said])))
    return rows


def test_reply_order(spark):
    rows = threads(2)
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    said = {x: (c, t) for c, t, _, text in rows for x in text.split("\n") if not x.startswith(">")}
    kids, up = {}, {}
    for c, t, _, text in rows:
        if text.startswith(">"):
            up[c, t] = said[text.split("\n")[0][2:]]
            kids.setdefault(up[c, t], []).append((c, t))
    assert len(up) > 60 and all(got[k].reply_to == v[1] for k, v in up.items())

    def walk(v):
        return [v, *(x for k in sorted(kids.get(v, [])) for x in walk(k))]

    for v in got:
        if v not in up:
            assert [got[x].position for x in walk(v)] == list(range(len(walk(v)))) and {got[x].root for x in walk(v)} == {v[1]}


def test_quotes_of_long_messages(spark):
    lines = [f"{'>' * (i % 4)} line {i}" for i in range(60_000)]
    d = spark.createDataFrame([(1, 0, "user", "line 1\nline 2"), (1, 1, "user", "\n".join(lines))], "conv_id long, turn long, role string, text string")
    began = time.time()
    got = {r.turn: r for r in quotes.link(d).collect()}
    assert got[1].n_quotes == 45_000 and got[1].text.count("\n") == 14_999 and time.time() - began < 60


def executed(spark, run):
    """What ``run()`` executes, as plans: every query, not the last one alone."""
    seen, before = [], spark._jsparkSession.sharedState().statusStore().executionsCount()
    run()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(before, runs.size()):
        seen.append(runs.apply(i).physicalPlanDescription())
    return seen


def test_native_plans_run_no_python(spark):
    data = "/root/testdata/sf0.001"
    talk = spark.createDataFrame(threads(4, 30), "conv_id long, turn long, role string, text string")
    talk.write.mode("overwrite").parquet(path := f"{scratch_dir(spark)}/talk")
    talk, docs = spark.read.parquet(path), spark.read.parquet(f"{data}/documents.parquet")
    for run in (lambda: quotes.link(talk).write.format("noop").mode("overwrite").save(), lambda: mixing.mix(docs).write.format("noop").mode("overwrite").save(), lambda: mixing.mixed_documents(docs).write.format("noop").mode("overwrite").save()):
        plans = executed(spark, run)
        assert len(plans) > 2 and not any(re.search("Python|Arrow|Pandas|ExternalRDD|SerializeFromObject", x) for x in plans)


def test_hot_runs_that_do_not_link(spark, monkeypatch):
    # One passage in every text, half of it each text's own: prefixes share the passage, no two texts link but copies.
    monkeypatch.setattr(jaccard, "HOT_ENTRIES", 8)
    monkeypatch.setattr(jaccard, "HELD_ENTRIES", 200)
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(k, f"{passage} " + " ".join(f"w{r.randrange(12)}" for _ in range(r.choice([4, 9, 40])))) for k in range(90)]
    rows += [(200 + k, t + " end") for k, (_, t) in enumerate(rows[:20])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(x) for x in jaccard.join(d).collect()), key=repr) == components(rows)


def test_ranges_share_tasks(spark):
    import numpy as np

    d = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(near_copies(4))], "doc_id long, text string").repartition(5)
    found = {}
    for ranges in (4, 64):
        cand = jaccard.candidates(d, np.ones(1 << 18, np.uint8), 18, ranges)
        found[ranges] = {tuple(x) for x in cand.where("a is not null").groupBy("a", "b").agg({"n_shared": "sum"}).collect()}
        assert len(cand.inputFiles()) <= max(4, ranges // 4)
    assert found[4] == found[64] and len(found[4]) > 100


def test_components_settle_without_a_join(spark):
    # Each query and shuffle costs the driver memory for a while: whether all is settled takes one shuffle.
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long").coalesce(1)
    got = []
    plans = executed(spark, lambda: got.extend(jaccard.components(links).collect()))
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert not any("SortMergeJoin" in x for x in plans)


def test_cells_lose_no_pair(spark):
    import numpy as np

    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(400), r.choice([60, 70, 80]))), np.uint64) for _ in range(30)]
    sets += [np.sort(np.append(s[:-2], np.uint64(500 + k))) for k, s in enumerate(sets)]
    links = {(a, b) for b in range(60) for a in range(b) if 4 * len(set(sets[a]) & set(sets[b])) >= 3 * len(set(sets[a]) | set(sets[b]))}
    assert all(jaccard.may_link(jaccard.parity(sets[a]), jaccard.parity(sets[b]), len(sets[a]), len(sets[b])) for a, b in links)
    members = spark.createDataFrame([(k, k, len(s), jaccard.parity(s)) for k, s in enumerate(sets)], "g long, node long, n int, sig binary")
    cand = spark.createDataFrame([(None, None, 7, list(range(60)), [len(s) for s in sets], [0] * 60)], "a long, b long, run long, grp array<long>, sizes array<int>, places array<int>")
    comp = spark.createDataFrame([(0, 0), (30, 0)], "node long, comp long")
    for cell in (1000, 7):
        got = {(x.hub, x.other) for x in jaccard._run_pairs(cand, members, comp, cell).collect()}
        assert links - {(0, 30)} <= got and (0, 30) not in got and len(got) < 200


def test_levels_keep_order():
    import numpy as np

    c = np.unique(np.concatenate([np.arange(1000), 2 ** np.arange(38), 3**np.arange(24)]))
    assert (np.diff(jaccard.levels(c).astype(int)) >= 0).all() and jaccard.levels(np.array([5]))[0] == 5


def test_top_k_of_mixed_lengths(spark):
    rows = [(i, [float(i % 7)] * (3 if i % 4 else 2)) for i in range(100)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for dims in (None, 3, 2):
        own = [r for r in rows if len(r[1]) == (dims or 3)]
        assert sorted(tuple(x) for x in topk.top_k(d, every=5, dims=dims).collect()) == brute(own, 20, 5)
    assert topk.top_k(d, dims=9).count() == 0


@pytest.mark.parametrize("parts, most", [(1, 1 << 20), (7, 5)])
def test_components_of_chains_and_stars(spark, monkeypatch, parts, most):
    monkeypatch.setattr(jaccard._stars, "__defaults__", (most,))
    r = random.Random(parts)
    nodes = r.sample(range(-(10**6), 10**6), 240)
    links = [(nodes[k], nodes[k + 1]) for k in range(0, 60)] + [(nodes[100], nodes[k]) for k in range(101, 160)] + [(nodes[k], nodes[k + 1]) for k in range(200, 230, 2)] + [(nodes[0], nodes[60]), (nodes[3], nodes[3])]
    r.shuffle(links)
    up = {x: x for x in nodes}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for p in links if p[0] != p[1] for x in p}
    got = jaccard.components(spark.createDataFrame(links, "a long, b long").repartition(parts)).collect()
    assert len(got) == len(linked) and {(x.node, x.comp) for x in got} == {(x, root(x)) for x in linked}
