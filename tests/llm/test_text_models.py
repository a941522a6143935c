"""Toxicity, language, quality and license scans: held-out accuracy, plain versions and edge cases."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomline.llm import language, licences, quality, toxicity

DATA = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, "123 --- !", None, "s"), (None, "Some words stand here.", "en", None), (5, "Repeated row.", "en", "s"), (5, "Repeated row.", "en", "s"), (6, "long " * 30000, "en", "s"), (7, "é ñ ü", "fr", "s")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, True) for r in ODD], SCHEMA + ", score double, kept boolean")


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_learns_and_holds_out(spark, odd):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    pos = [r.score for r in rows if r.held_out and y.get(r.doc_id) == 1]
    neg = [r.score for r in rows if r.held_out and y.get(r.doc_id) == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9
    again = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert max(abs(a.score - b.score) for a, b in zip(sorted(rows), sorted(again))) < 1e-6
    out = toxicity.score(odd, model).collect()
    assert len(out) == len(ODD) and len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    none = toxicity.toxicity(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.toxicity(odd.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if not r.predicted)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 32, 33, 48, 49, 100])
    win, row = toxicity.windows(counts, np.arange(counts.sum()))
    off = np.concatenate([[0], np.cumsum(counts)])
    for i, n in enumerate(counts):
        seen = set(win[row == i].ravel()) - {0}
        assert seen == set(range(off[i] + 1, off[i + 1] + 1)) and (row == i).sum() >= 1


def test_gradients_by_differences():
    import pyarrow as pa

    from loomline.llm.common import word_ngrams

    toxicity.WORD_DROPOUT, kept = 0.0, toxicity.WORD_DROPOUT
    try:
        rng = np.random.default_rng(0)
        m = toxicity.Model.fresh()
        p = {k: v.astype(np.float64) for k, v in m.p.items()}
        feats = word_ngrams(pa.array(["alpha", "beta", "gam", "d"]), toxicity.CHAR_NS, toxicity.BITS)
        win, y = rng.integers(0, 5, (3, 4)), np.array([1, 0, 1], np.float32)

        def loss():
            q = toxicity.logits(p, toxicity._project(p, toxicity.inputs(p, feats)), win).astype(np.float64)
            return np.mean(np.log1p(np.exp(-q)) * y + np.log1p(np.exp(q)) * (1 - y))

        g = toxicity.gradients(p, feats, win, y, rng)
        for k in ("Wf", "Ub", "Wa", "va", "u", "b"):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            before = p[k][at]
            p[k][at] = before + 1e-2
            up = loss()
            p[k][at] = before - 1e-2
            down = loss()
            p[k][at] = before
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k
    finally:
        toxicity.WORD_DROPOUT = kept


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(docs)
    rows = language.language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.97
    out = {r.doc_id: r for r in language.language(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[6].lang_pred in ("de", "en", "es", "fr")
    assert language.language(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.language(odd.withColumn("lang", odd.lang.substr(9, 1).cast("string")).where("lang is null")).collect()} == {"und"}


def test_one_language_alone(spark):
    d = spark.createDataFrame([(i, "les mots ici", "fr") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.language(d).collect()} == {"fr"}


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_quality_measures_a_batch_in_small_parts():
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", *[" ".join(f"w{(i * 31 + j) % 977}" for j in range(2_000)) + "\nend of it" for i in range(400)]]
    n, one = len(texts), [0] * len(texts)
    batch = pa.RecordBatch.from_pydict({"rid": list(range(n)), "doc_id": list(range(n)), "host": ["h"] * n, "th": one, "text": texts})
    whole = quality.measure(batch.column("text"))
    tracemalloc.start()
    rows = [(p["rid"], p["n_words"], p["n_repeat_words"], p["hs"], p["ws"]) for part in quality._measured(iter([batch])) for p in part.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == list(zip(range(n), *(whole[k].tolist() for k in ("n_words", "n_repeat_words")), whole["hs"].to_pylist(), whole["ws"].to_pylist()))
    assert batch.nbytes > 3 << 20 and peak < 24 << 20


def test_quality_counts(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    both = docs.unionByName(odd.select(*docs.columns)).withColumn("h", docs.doc_id)
    texts = Counter((r.doc_id, *plain_counts(r.text)) for r in both.collect())
    got = quality.quality(both).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == texts
    assert not any(r.kept for r in got if r.base_failed) and quality.quality(docs.limit(0)).count() == 0


def test_frequent_lines_and_depletion(spark):
    common = "This LINE stands in   many documents of its host and it is long enough to deplete a text " * 3
    own = lambda i: " ".join(f"own{i}x{k}" for k in range(55))
    rows = [(i, f"{common.strip()}\n{own(i)}", "h1") for i in range(30)]  # 54 common words of 109: kept
    rows += [(100 + i, f"{own(i)}\n{common.lower().strip()} \n{common} ", "h1") for i in range(10)]  # more than half lost
    rows += [(200, f"{common}\n{own(1)}", "h2"), (201, f"{common}\n{own(2)}", None)]
    rows += [(300 + i, own(999), "h3") for i in range(50)]  # exact copies are one document
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    bad = quality.frequent_lines(quality.scan(d)).collect()
    want = defaultdict(set)
    for i, t, s in rows:
        for line in {" ".join(x.lower().split()) for x in t.split("\n")}:
            want[s, line].add(t)
    over = [(k, len(v)) for k, v in want.items() if len(v) > 20]
    assert [(r.host, r.n_docs) for r in bad] == [(k[0], n) for k, n in over] == [("h1", 40)]
    kept = {r.doc_id for r in quality.quality(d).collect() if r.kept}
    assert kept == {i for i, _, _ in rows} - set(range(100, 110))
    out = {r.doc_id: r.text for r in quality.keep_good(d).collect()}
    assert out[0] == own(0) and out[200] == rows[40][1] and set(out) == kept
    assert quality.keep_good(d).schema == d.schema and quality.keep_good(d.limit(0)).count() == 0
    # Columns of the operator's own names, another type of n_chars, lines kept as they stand.
    odd = d.selectExpr("*", "7 as d", "'x' as lost", "true as kept", "source as host", "cast(length(text) as int) as n_chars", "0L as th")
    rows = quality.keep_good(odd).collect()
    assert {r.doc_id: r.text for r in rows} == out and quality.keep_good(odd).schema == odd.schema
    assert all((r.d, r.lost, r.kept, r.th) == (7, "x", True, 0) and r.host == r.source and r.n_chars == len(r.text) for r in rows)


BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def plain_base(t):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    at = [(i, label) for i in range(len(w)) for phrase, label in BASE.items() if tuple(w[i : i + len(phrase)]) == phrase]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_license_base_places(spark):
    odd = [(1, None), (2, ""), (3, "MIT-License, mit license; MIT LICENSE"), (4, "CC BY-CC.BY cc by"), (5, "gnu\ngeneral public_license éapache license"), (6, "Apache  License gnu general public licence"), (None, "x mit license"), (7, "mit licenses cc bye accby")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = Counter((r.doc_id, *plain_base(r.text)) for r in rows.collect())
    got = licences.licenses(rows.withColumn("labels", rows.text)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licences.licenses(rows.limit(0)).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}), ("SPDX-License-Identifier: BSD-3-Clause", {"bsd-3-clause"}), ("Released under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
    ("This is free: GNU General Public License version 3", {"gpl-3.0"}), ("All rights reserved.", {"proprietary"}), ("a limited license plate", set()), ("in the public domain", {"public-domain"}), ("Mozilla Public License 2.0 applies", {"mpl-2.0"}),
])
def test_license_rules(text, labels):
    rules = licences.Rules()
    found = licences.scan_text(text.lower(), rules)[1]
    assert {d[2] for d in found} == labels
    assert re.search(rules.prefilter, text.lower()) or not found


def test_contained_detections_are_suppressed():
    found = licences.scan_text("licensed under the mit license", licences.Rules())[1]
    assert [(d[0], d[1], d[2]) for d in found] == [(0, 5, "mit")]


def example(pattern):
    """A text that a rule matches: of each choice the first, of what may be left out nothing."""
    while "(" in pattern:
        inner = re.search(r"\((\?:|\?!|\?P<\w+>)?([^()]*)\)([?*]|\{(\d)[^}]*\})?", pattern)
        kind, body, much, least = inner.groups()
        text = "" if kind == "?!" or much and (much in "?*" or least == "0") else body.split("|")[0] * int(least or 1)
        pattern = pattern[: inner.start()] + text + pattern[inner.end() :]
    pattern = re.sub(r"\[([^\]]).[^\]]*\]", r"\1", pattern.split("|")[0])
    return re.sub(r"\\d", "4", re.sub(r"\\w[+*]", "word", re.sub(r"(.)\?", "", pattern))).strip()


def test_every_rule_is_reached():
    """Each rule matches its example, which the keyword and the prefilter let through with any separators."""
    rules = licences.Rules()
    assert len(rules.rules) == len(set(rules.rules)) == len(licences.NAMES) + len(licences.SIGNATURES)
    for (label, pattern, key, *_), keys in zip(rules.rules, rules.keys):
        text = example(pattern)
        assert re.search(rf"(?<![^ ]){pattern}(?![^ ])", text), (label, pattern, text)
        assert any(k in text for k in keys), (label, key, text)
        assert re.search(rules.prefilter, text) and re.search(rules.prefilter, text.replace(" ", " \n* ")), (label, text)


def test_labels_equal_a_plain_scan(spark):
    """All rules over all texts, without prefilter or keywords; suppression by comparing every two detections."""
    rules = licences.Rules()
    extra = [(-1 - i, t, None, None) for i, t in enumerate(["licensed under the apache license version 2 0 and also the mit license applies here", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "GPL-2.0-only or GPLv3 or later; all rights reserved, Copyright (c) 2020"])]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.where("text rlike '(?i)licen|copyright|rights|domain' or doc_id % 10 = 0").unionByName(spark.createDataFrame(extra, docs.schema))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want, n = Counter(), 0
    for r in docs.collect():
        joined = " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r.text)))
        found = set()
        for label, pattern, _, priority, sure in rules.rules:
            for m in re.finditer(rf"(?<![^ ]){pattern}(?![^ ])", joined):
                told = any(m.groupdict().values())
                found.add((m.start(), m.end(), label, 5 if told else priority, 0.95 if told else sure))
        inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and a[:2] != b[:2] and b[3] >= a[3]
        same = lambda a, b: a[:2] == b[:2] and a != b and b[3] > a[3]
        stand = [a for a in found if not any(inside(a, b) or same(a, b) for b in found)]
        base = plain_base(r.text)
        labels = {d[2] for d in stand} | set(filter(None, base[4].split(",")))
        n += len(stand)
        want[r.doc_id, frozenset(labels), max([0.5 * bool(base[1]), *(d[4] for d in stand)])] += 1
    got = Counter((r.doc_id, frozenset(filter(None, r.labels.split(","))), r.score) for r in licences.licenses(docs).collect())
    assert n > 20 and {k[0]: k for k in got} == {k[0]: k for k in want}


def test_corpora_of_long_texts_only_are_learned(spark):
    r = np.random.default_rng(4)
    words = {k: [f"{k}{i}{k[::-1]}" for i in range(50)] for k in ("aeo", "tzk")}
    long = lambda k, bad=0: " ".join([*r.choice(words[k], 4000), *["vile", "filth", "scum"] * bad, *r.choice(words[k], 300)])
    rows = [(i, long(k, 2 * (i % 3 == 0)), k) for i in range(60) for k in [("aeo", "tzk")[i % 2]]]
    assert min(len(t) for _, t, _ in rows) > 20_000
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(x.lang_pred == rows[x.doc_id][2] for x in language.language(d).collect())
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    got = {x.doc_id: x.score for x in toxicity.score(d, m).collect()}
    assert m.trained and min(got[i] for i in got if i % 3 == 0) > max(got[i] for i in got if i % 3)
    # A budget of characters below one text still leaves one text of each kind.
    assert toxicity.fit(d, labels, chars=10).trained and len(language.fit(d, chars=10).families) == 2


def test_scores_equal_a_plain_reading(spark, odd):
    """Toxicity and language decided word by word with the trained arrays, without slices, batches or shared words."""
    import pyarrow as pa

    from loomline.llm.common import word_ngrams

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = docs.orderBy("doc_id").limit(40).unionByName(odd.select(*docs.columns)).collect()
    some = spark.createDataFrame(rows, docs.schema)
    tox, lan = toxicity.fit(docs, labels), language.fit(docs)
    sig = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(np.float64) for k, v in tox.p.items()}

    def vector(word):
        w, ids, _ = word_ngrams(pa.array([word]), toxicity.CHAR_NS, toxicity.BITS)
        n = len(word_ngrams(pa.array([], pa.string()), toxicity.CHAR_NS, toxicity.BITS)[1])  # those of the padding come first
        if word == "":
            return np.concatenate([p["Ew"][w[0]], p["Ec"][ids[:n]].mean(axis=0) if n else np.zeros(toxicity.CHAR_DIM)])
        return np.concatenate([p["Ew"][w[1]], p["Ec"][ids[n:]].mean(axis=0) if len(ids) > n else np.zeros(toxicity.CHAR_DIM)])

    def gru(xs, W, b, U):
        h, out, H = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            a, u = x @ W + b, h @ U
            z, r = sig(a[:H] + u[:H]), sig(a[H : 2 * H] + u[H : 2 * H])
            new = np.tanh(a[2 * H :] + r * u[2 * H :])
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out)

    def plain(text):
        words = WORD.findall((text or "").lower())
        best, a = -np.inf, 0
        while a == 0 or a + toxicity.STRIDE < len(words):
            xs = [vector(w) for w in (words[a : a + toxicity.WINDOW] + [""] * toxicity.WINDOW)[: toxicity.WINDOW]]
            h = np.concatenate([gru(xs, p["Wf"], p["bf"], p["Uf"]), gru(xs[::-1], p["Wb"], p["bb"], p["Ub"])[::-1]], axis=1)
            s = np.tanh(h @ p["Wa"]) @ p["va"]
            e = np.exp(s - s.max())
            best, a = max(best, e @ (h @ p["u"]) / e.sum() + p["b"][0]), a + toxicity.STRIDE
        return sig(best)

    got = toxicity.score(some, tox).collect()
    assert len(got) == len(rows)
    short = [(g.score, r.text) for g, r in zip(sorted(got, key=lambda x: (x.doc_id is None, x.doc_id)), sorted(rows, key=lambda x: (x.doc_id is None, x.doc_id))) if len(r.text or "") < 3000]
    for s, t in short[:30]:
        assert abs(s - plain(t)) < 1e-4, t

    def plain_lang(text):
        words = [w for w in WORD.findall((text or "").lower()) if any(c.isalpha() for c in w)]
        if not words:
            return "und"
        x = np.zeros(2 << language.BITS)
        n = len(word_ngrams(pa.array([], pa.string()), language.NGRAMS, language.BITS)[1])
        for w in words:
            own, ids, _ = word_ngrams(pa.array([w]), language.NGRAMS, language.BITS)
            np.add.at(x, ids[n:], 1 / max(1, len(ids) - n) / len(words))
            x[(1 << language.BITS) + own[1]] += 1 / len(words)
        d = x @ lan.weights.astype(np.float64) + lan.bias

        def vote(classes):
            total = dict.fromkeys(classes, 0.0)
            for (a, b), k in lan.columns.items():
                if a in classes and b in classes:
                    t = np.tanh(d[k])
                    total[a if d[k] > 0 else b] += 1
                    total[a] += t / (4 * len(classes))
                    total[b] -= t / (4 * len(classes))
            return max(classes, key=lambda c: total[c])

        return vote(lan.languages[vote(lan.families)])

    for x in language.language(some, lan).collect():
        assert x.lang_pred in {plain_lang(r.text) for r in rows if r.doc_id == x.doc_id}


def test_no_rows_or_labels_of_other_documents(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000, 1040)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity(odd, labels).collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels).count() == len(ODD) and toxicity.drop_toxic(odd.limit(0), labels).count() == 0
    assert language.language(odd.limit(0)).count() == 0
