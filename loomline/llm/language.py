"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed character n-grams and words: those between families decide the family,
those between each two languages of a family vote on the language within it. Words count equally within a text, and
n-grams within a word; a text's decision values are therefore means over its words, worked out once a distinct word.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every text where no labelled row
exists; null and repeated ids are rows like others; a language without a listed family is a family of its own. A text
of any length is read whole in its task. Extra columns are ignored; an empty table has no rows.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, is_held_out, starts, text_slices, trained_in_task, word_ngrams, words_of

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
}
NGRAMS, BITS = (2, 3, 4), 13
#: Bounds of the training sample: rows of a language, rows in all, characters of all texts.
MAX_ROWS_PER_LANG, MAX_ROWS, MAX_CHARS = 400, 4000, 40_000_000
UNDECIDED = "und"


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.lower().split("-")[0] in codes.split()), lang)


@dataclass
class Model:
    """``pairs``: (classes, for each pair of classes its column of ``weights``), for families and within each."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((2 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    families: list = field(default_factory=list)
    languages: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)


def _word_rows(vocabulary: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each distinct word the mean of its n-grams' rows, plus its own row."""
    word, ids, counts = word_ngrams(vocabulary, NGRAMS, BITS)
    out = table[(1 << BITS) + word].copy()
    full = np.flatnonzero(counts)
    out[full] += np.add.reduceat(table[ids], starts(counts)[:-1][full], axis=0) / counts[full, None]
    return out[1:]


def _lettered(text: pa.Array):
    """As ``words_of`` in lower case, with the words that have a letter alone."""
    codes, counts, vocabulary = words_of(pc.utf8_lower(pc.fill_null(text, "")))
    letters = pc.match_substring_regex(vocabulary, r"\pL").to_numpy(zero_copy_only=False)
    if letters.all():
        return codes, counts, vocabulary
    keep = letters[codes]
    row = np.repeat(np.arange(len(counts)), counts)[keep]
    return codes[keep], np.bincount(row, minlength=len(counts)), vocabulary


def _matrix(texts: list[str]) -> np.ndarray:
    """Training texts as dense rows: the same means that ``decide`` takes."""
    x = np.zeros((len(texts), 2 << BITS), np.float32)
    codes, counts, vocabulary = _lettered(pa.array(texts, pa.string()))
    word, ids, n = word_ngrams(vocabulary, NGRAMS, BITS)
    off, at = starts(n), starts(counts)
    for i in range(len(texts)):
        w = codes[at[i] : at[i + 1]] + 1
        if len(w):
            flat = np.repeat(off[w] - starts(n[w])[:-1], n[w]) + np.arange(n[w].sum())
            x[i, : 1 << BITS] = np.bincount(ids[flat], np.repeat(1 / np.maximum(1, n[w]), n[w]), 1 << BITS)
            x[i, 1 << BITS :] = np.bincount(word[w], minlength=1 << BITS)
            x[i] /= len(w)
    return x


def svm(x: np.ndarray, y: np.ndarray, c: float = 3000.0, passes: int = 60, seed: int = 3):
    """Linear SVM with squared hinge loss and equal class weights, by dual coordinate descent over the Gram matrix."""
    n = len(y)
    cost = c * n / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum()) / n
    q = (x @ x.T + np.float32(0.01)).astype(np.float64) * np.outer(y, y)
    q[np.arange(n), np.arange(n)] += 1 / (2 * cost)
    alpha, f, rng = np.zeros(n), np.zeros(n), np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(n):
            new = max(0.0, alpha[i] - (f[i] - 1) / q[i, i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]) * q[i, i])
                f += (new - alpha[i]) * q[i]
                alpha[i] = new
        if moved < 1e-2:
            break
    return ((alpha * y) @ x).astype(np.float32), np.float32(0.01 * (alpha * y).sum())


def train(texts: list[str], langs: list[str]) -> Model:
    m = Model()
    if not texts:
        return m
    x, lang = _matrix(texts), np.array(langs)
    fam = np.array([family_of(k) for k in langs])
    columns, biases = [], []

    def against(classes, of):
        for a, b in combinations(classes, 2):
            at = np.flatnonzero((of == a) | (of == b))
            w, bias = svm(x[at], np.where(of[at] == a, 1, -1).astype(np.float32))
            m.columns[a, b] = len(columns)
            columns.append(w)
            biases.append(bias)

    m.families = sorted(set(fam.tolist()))
    against(m.families, fam)
    for f in m.families:
        m.languages[f] = sorted(set(lang[fam == f].tolist()))
        against(m.languages[f], np.where(fam == f, lang, ""))
    m.weights = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((2 << BITS, 0), np.float32)
    m.bias = np.array(biases, np.float32)
    return m


def _vote(m: Model, classes: list[str], values: np.ndarray):
    """Winner among classes (number) and its confidence: pairwise votes, then summed decision values."""
    n = len(values)
    if len(classes) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, sure = np.zeros((n, len(classes))), np.zeros((n, len(classes)))
    for i, j in combinations(range(len(classes)), 2):
        d = np.tanh(values[:, m.columns[classes[i], classes[j]]].astype(np.float64))
        votes[:, i] += d > 0
        votes[:, j] += d <= 0
        sure[:, i] += d
        sure[:, j] -= d
    best = np.argmax(votes + sure / (4 * len(classes)), axis=1)
    return best, 0.5 + 0.5 * np.clip(sure[np.arange(n), best] / (len(classes) - 1), 0, 1)


def decide(m: Model, text: pa.Array):
    """(language, score) of each text."""
    lettered = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
    n = len(text)
    lang, score = np.full(n, UNDECIDED, object), np.zeros(n)
    if not m.families:
        return lang, score
    codes, counts, vocabulary = _lettered(text)
    rows = _word_rows(vocabulary, m.weights)
    values = np.zeros((n, rows.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    if len(full) and rows.shape[1]:
        values[full] = np.add.reduceat(rows[codes], starts(counts)[:-1][full], axis=0) / counts[full, None]
    values += m.bias
    fam, sure = _vote(m, m.families, values)
    for k, f in enumerate(m.families):
        at = np.flatnonzero((fam == k) & lettered)
        won, inner = _vote(m, m.languages[f], values[at])
        lang[at] = np.array(m.languages[f], object)[won]
        score[at] = sure[at] * inner
    return lang, score


def fit(docs: DataFrame, rows: int = MAX_ROWS_PER_LANG, total: int = MAX_ROWS, chars: int = MAX_CHARS) -> Model:
    """Train on whole texts: the first rows of each language by hash of the id, none held out."""
    known = docs.select("doc_id", "lang", "text").where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as there are languages
    if not n:
        return Model()
    each = max(1, min(rows, total // len(n)))
    # Hashes under this bound belong to some four times the rows that are wanted: no language's rows meet in one task.
    bounds = docs.sparkSession.createDataFrame([(k, min(1.0, (4.0 * each + 400) / v)) for k, v in n.items()], "lang string, most double")
    low = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(bounds), "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.col("most"))
    first = low.groupBy("lang", "doc_id", "h").agg(F.lit(1).alias("x")).withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("nth") <= each)
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in first.collect()], "doc_id long, lang string")  # ``total`` at most
    found = known.join(F.broadcast(few), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return Model(**trained_in_task(found, "lang", lambda texts, y: dict(vars(train(texts, y))), chars // len(n)))


def language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def run(it):
        for batch in it:
            for part in text_slices(batch):
                lang, score = decide(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return batches(docs.withColumn("held_out", is_held_out()), "doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
