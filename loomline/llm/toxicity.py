"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

Every word enters as a hashed word vector beside the mean of its hashed character n-gram vectors
(3 and 5 UTF-8 bytes of ``^word$``). Windows of 32 words, half overlapping, cover the whole text; a text's
score is that of its worst window. Texts of fewer words are padded. Training takes whole texts of a bounded number of
labelled rows.

Defined cases: a null, empty or blank text is one window of padding and gets that window's score; rows with a
null id are scored like others; repeated rows give repeated results; labels that do not hold rows of both kinds for
``docs`` (or no rows at all) leave an untrained model that scores every text 0. A very long text is scored in pieces of
4,096 windows, so its task holds some 300 bytes a word. Extra columns are ignored; an empty table has no scores.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, free, is_held_out, materialise, starts, text_slices, trained_in_task, word_ngrams, words_of

WINDOW, STRIDE, THRESHOLD = 32, 16, 0.3
HIDDEN, WORD_DIM, CHAR_DIM, BITS, CHAR_NS = 8, 12, 12, 17, (3, 5)
WORD_DROPOUT = 0.25
#: Words and n-grams of fewer training texts have no vector: they could only be learnt by heart.
MIN_TEXTS = 3
#: Bytes of text that a task works on at once.
SLICE = 1 << 20
#: Bounds of the training sample: labelled rows of each kind, and characters of all their texts.
MAX_ROWS_PER_LABEL, MAX_CHARS_PER_LABEL = 1500, 16_000_000


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Model:
    p: dict = field(default_factory=dict)
    trained: bool = False

    @staticmethod
    def fresh(seed: int = 7) -> "Model":
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        return Model({"Ew": f(1 << BITS, WORD_DIM, k=0.1), "Ec": f(1 << BITS, CHAR_DIM, k=0.3), "Wf": f(d, 3 * h), "Wb": f(d, 3 * h),
                      "bf": np.zeros(3 * h, np.float32), "bb": np.zeros(3 * h, np.float32), "Uf": f(h, 3 * h), "Ub": f(h, 3 * h),
                      "Wa": f(2 * h, h), "va": f(h), "u": f(2 * h), "b": np.full(1, -1.0, np.float32)})


def _char_means(table, ids, counts, chunk: int = 20_000):
    """Means of the words' n-gram rows, some thousand words at a time: the rows themselves are many times their means."""
    total, off = np.zeros((len(counts), table.shape[1]), np.float32), starts(counts)
    for a in range(0, len(counts), chunk):
        n = counts[a : a + chunk]
        full = np.flatnonzero(n)
        if len(full):
            at = off[a : a + len(n)]
            total[a + full] = np.add.reduceat(table[ids[at[0] : off[a + len(n)]]], (at - at[0])[full], axis=0) / n[full, None]
    return total


def inputs(p, feats):
    word, ids, counts = feats
    return np.concatenate([p["Ew"][word], _char_means(p["Ec"], ids, counts)], axis=1)


def windows(counts: np.ndarray, codes: np.ndarray):
    """Word numbers (0 is padding) of every window, and each window's row; every row has one window at least."""
    per = np.maximum(1, -(-(counts - STRIDE) // STRIDE))
    row = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(row)) - np.repeat(starts(per)[:-1], per)
    first, last = starts(counts)[:-1][row] + nth * STRIDE, starts(counts)[1:][row]
    at = first[:, None] + np.arange(WINDOW)
    known = at < last[:, None]
    padded = np.append(codes + 1, 0)
    return np.where(known, padded[np.minimum(at, len(codes))], 0), row


def _gru(x, U, reverse, keep=None):
    """x: (T, B, 3H) projected inputs. Hidden states (T, B, H)."""
    T, B, H3 = x.shape
    H = H3 // 3
    out, h = np.empty((T, B, H), np.float32), np.zeros((B, H), np.float32)
    for t in range(T - 1, -1, -1) if reverse else range(T):
        hu = h @ U
        zr = _sigmoid(x[t, :, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(x[t, :, 2 * H :] + r * hu[:, 2 * H :])
        if keep is not None:
            keep.append((t, h, z, r, n, hu[:, 2 * H :]))
        h = n + z * (h - n)
        out[t] = h
    return out


def _gru_back(dout, U, keep, gx):
    """Gradients of the projected inputs (into gx) and of U."""
    H, gU, dh = dout.shape[2], np.zeros_like(U), np.zeros(dout.shape[1:], np.float32)
    for t, h, z, r, n, hun in reversed(keep):
        d = dh + dout[t]
        dn, dz = d * (1 - z) * (1 - n * n), d * (h - n) * z * (1 - z)
        dr = dn * hun * r * (1 - r)
        gx[t] = np.concatenate([dz, dr, dn], axis=1)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        gU += h.T @ dhu
        dh = d * z + dhu @ U.T
    return gU


def _project(p, table):
    return table @ p["Wf"] + p["bf"], table @ p["Wb"] + p["bb"]


def logits(p, projected, win, chunk: int = 4096):
    """Logit of every window."""
    out = np.empty(len(win), np.float32)
    for a in range(0, len(win), chunk):
        w = win[a : a + chunk].T
        h = np.concatenate([_gru(projected[0][w], p["Uf"], False), _gru(projected[1][w], p["Ub"], True)], axis=2)
        s = np.tanh(h @ p["Wa"]) @ p["va"]
        e = np.exp(s - s.max(axis=0))
        value = h @ p["u"]
        out[a : a + chunk] = (e * value).sum(axis=0) / e.sum(axis=0) + p["b"][0]
    return out


def _some(feats, seen):
    """The features of the words numbered in ``seen`` alone."""
    word, ids, counts = feats
    n = counts[seen]
    flat = np.repeat(starts(counts)[seen] - starts(n)[:-1], n) + np.arange(n.sum())
    return word[seen], ids[flat], n


def gradients(p, feats, win, y, rng):
    """Gradients of the mean logistic loss over the given windows; those of the two tables by bucket."""
    seen, back = np.unique(win.T, return_inverse=True)
    w = back.reshape(win.T.shape)
    feats = _some(feats, seen)
    table = inputs(p, feats)
    # Rare words are easily learnt by heart: their own vectors are often left out, so characters must do.
    out = rng.random(len(seen)) < WORD_DROPOUT
    table[out, :WORD_DIM] = 0
    kf, kb = [], []
    pf, pb = _project(p, table)
    hf, hb = _gru(pf[w], p["Uf"], False, kf), _gru(pb[w], p["Ub"], True, kb)
    h = np.concatenate([hf, hb], axis=2)
    ta = np.tanh(h @ p["Wa"])
    s = ta @ p["va"]
    e = np.exp(s - s.max(axis=0))
    a = e / e.sum(axis=0)
    value = h @ p["u"]
    q = (a * value).sum(axis=0)
    dl = ((_sigmoid(q + p["b"][0]) - y) / len(y)).astype(np.float32)
    g = {"b": dl.sum(keepdims=True)}
    g["u"] = np.einsum("tbh,tb->h", h, a * dl)
    ds = a * (value - q) * dl
    g["va"] = np.einsum("tbh,tb->h", ta, ds)
    dta = ds[..., None] * p["va"] * (1 - ta * ta)
    g["Wa"] = np.einsum("tbh,tbk->hk", h, dta)
    dh = (a * dl)[..., None] * p["u"] + dta @ p["Wa"].T
    H = HIDDEN
    gxf, gxb = np.empty_like(pf[w]), np.empty_like(pb[w])
    g["Uf"], g["Ub"] = _gru_back(dh[:, :, :H], p["Uf"], kf, gxf), _gru_back(dh[:, :, H:], p["Ub"], kb, gxb)
    back, gp = w.reshape(-1), []
    order = np.argsort(back, kind="stable")
    first = np.searchsorted(back[order], np.arange(len(seen)))
    for gx in (gxf, gxb):
        gp.append(np.add.reduceat(gx.reshape(len(back), -1)[order], first, axis=0))
    g["Wf"], g["Wb"], g["bf"], g["bb"] = table.T @ gp[0], table.T @ gp[1], gp[0].sum(axis=0), gp[1].sum(axis=0)
    dx = gp[0] @ p["Wf"].T + gp[1] @ p["Wb"].T
    dx[out, :WORD_DIM] = 0
    word, ids, n = feats
    g["Ew"] = _by_bucket(word, dx[:, :WORD_DIM])
    g["Ec"] = _by_bucket(ids, np.repeat(dx[:, WORD_DIM:] / np.maximum(1, n)[:, None], n, axis=0))
    return g


def _in_texts(feats, codes, counts, which: int, chunk: int = 100) -> np.ndarray:
    """In how many texts each bucket of words (0) or n-grams (1) occurs."""
    word, n = feats[0], feats[2]
    off, total = starts(counts), np.zeros(1 << BITS, np.int64)
    for a in range(0, len(counts), chunk):
        part = counts[a : a + chunk]
        pairs = np.unique(np.repeat(np.arange(len(part)), part) * np.int64(len(word)) + codes[off[a] : off[a + len(part)]] + 1)
        row, seen = pairs // len(word), pairs % len(word)
        if which:
            row, bucket = np.repeat(row, n[seen]), _some(feats, seen)[1]
        else:
            bucket = word[seen]
        pairs = np.unique(row * np.int64(1 << BITS) + bucket)
        total += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
    return total


def _by_bucket(ids, rows):
    order = np.argsort(ids, kind="stable")
    buckets, first = np.unique(ids[order], return_index=True)
    return buckets, np.add.reduceat(rows[order], first, axis=0)


def train(texts: list[str], labels: list[int], steps: int = 250, batch: int = 256, seed: int = 7, share: float | None = None) -> Model:
    """Fit on labelled texts.

    The first rounds teach windows their text's label; later ones only the window that now scores highest,
    as a text is toxic if one of its windows is. ``share``: how many of all labelled texts are toxic, if the sample
    holds another share; scores are moved to it.
    """
    m = Model.fresh(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return m
    p, rng = m.p, np.random.default_rng(seed)
    codes, counts, vocabulary = words_of(pc.utf8_lower(pa.array(texts, pa.string())))
    feats = word_ngrams(vocabulary, CHAR_NS, BITS)
    used = [_in_texts(feats, codes, counts, which) >= MIN_TEXTS for which in (0, 1)]
    for k, ok in zip(("Ew", "Ec"), used):
        p[k][~ok] = 0
    win, row = windows(counts, codes)
    first = starts(np.bincount(row, minlength=len(y)))[:-1]
    m1 = {k: np.zeros_like(v) for k, v in p.items()}
    m2 = {k: np.zeros_like(v) for k, v in p.items()}
    # Small samples take more rounds and smaller batches, so that every model sees about as many steps.
    batch = max(32, min(batch, len(y) // 8))
    rounds = max(8, -(-steps * batch // (2 * len(y))))
    step = 0
    for rnd in range(rounds):
        table = inputs(p, feats)
        if rnd < 0.375 * rounds:
            pick = np.concatenate([first + rng.integers(0, np.bincount(row, minlength=len(y))) for _ in range(2)])
        else:
            lg = logits(p, _project(p, table), win)
            order = np.lexsort((-lg, row))
            top = order[first]
            second = order[np.minimum(first + 1, np.append(first[1:], len(row)) - 1)]
            pick = np.concatenate([top, second[y == 0]])
        pick = rng.permutation(pick)
        rate = 0.01 if rnd < 0.625 * rounds else 0.003
        for a in range(0, len(pick), batch):
            w = pick[a : a + batch]
            g = gradients(p, feats, win[w], y[row[w]], rng)
            step += 1
            for k, v in g.items():
                at, v = v if isinstance(v, tuple) else (slice(None), v)  # a bucket's moments move when it is seen
                if k in ("Ew", "Ec"):
                    ok = used[k == "Ec"][at]
                    at, v = at[ok], v[ok]
                m1[k][at] += 0.1 * (v - m1[k][at])
                m2[k][at] += 0.01 * (v * v - m2[k][at])
                p[k][at] -= (rate * (m1[k][at] / (1 - 0.9**step)) / (np.sqrt(m2[k][at] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if share:
        odds = lambda q: np.log(q / (1 - q))
        p["b"] -= np.float32(odds(float(y.mean())) - odds(share))
    m.trained = True
    return m


def score_texts(model: Model, text: pa.Array) -> np.ndarray:
    """Scores of an Arrow array of texts: the highest over all windows of each."""
    if not model.trained:
        return np.zeros(len(text))
    codes, counts, vocabulary = words_of(pc.utf8_lower(pc.fill_null(text, "")))
    win, row = windows(counts, codes)
    p = model.p
    lg = logits(p, _project(p, inputs(p, word_ngrams(vocabulary, CHAR_NS, BITS))), win)
    best = np.maximum.reduceat(lg, starts(np.bincount(row, minlength=len(counts)))[:-1]).astype(np.float64)
    return 1 / (1 + np.exp(-best))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = MAX_ROWS_PER_LABEL, chars: int = MAX_CHARS_PER_LABEL) -> Model:
    """Train on at most ``rows`` labelled documents of each kind, the first by hash of the id, none held out."""
    known = labels.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")  # an id and a label a row
    n = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return Model.fresh()
    share = n[1] / (n[0] + n[1])
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for part in ids for r in part.collect()], "doc_id long, y int")  # 2 * rows at most
    free(known)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def fitted(texts, y):
        m = train(texts, y, share=share)
        return m.p, m.trained

    return Model(*trained_in_task(found, "y", fitted, chars))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for batch in it:
            for part in text_slices(batch, limit=SLICE):
                s = score_texts(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return batches(docs.withColumn("held_out", is_held_out()), "doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose whole text stays under the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(it):
        for batch in it:
            for part in text_slices(batch, limit=SLICE):
                yield part.filter(pa.array(score_texts(shared.value, part.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
