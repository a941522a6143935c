"""Shared helpers: word tables over Arrow text, scratch tables, stable hashing."""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import delete, free, materialise, scratch_dir, scratch_tables  # noqa: F401
from ..slices import SLICE_BYTES, text_slices, trim  # noqa: F401

def trained_in_task(sample: DataFrame, label: str, train, chars: int):
    """``train(texts, labels)`` of a bounded sample (doc_id, text, label), run by one task; what it returns, unpickled.

    The driver holds neither the texts nor the arrays of the training, and a lost executor costs one rerun. Texts come
    in order of their ids' hashes, whole, until those of a label would exceed ``chars`` characters; the first text of
    a label is in the sample however long it is. ``train`` gets them in order of id, so reruns agree, and returns plain
    containers and arrays, of no rows too.
    """
    import pickle

    def run(it):
        rows, used = [], {}
        for batch in it:
            for i, t, y in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", label))):
                if y not in used or used[y] + len(t) <= chars:
                    rows.append((i, t, y))
                used[y] = used.get(y, 0) + len(t)
        rows.sort()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    dealt = sample.select("doc_id", "text", label).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    made = dealt.mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else train([], [])


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def batches(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, for a map over Arrow batches: other columns and clashing names stay out."""
    return df.select(*columns)


def words_of(text: pa.Array, lower: bool = False):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (codes, counts per row, distinct words).

    Null texts have no words. ``codes`` holds an index into the distinct words for each word, row after row.
    """
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    off = lists.offsets.to_numpy()
    flat = lists.values.slice(off[0], off[-1] - off[0])
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False)
    if not mask.all():
        flat = flat.filter(full)
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    counts = np.diff(total[off - off[0]])
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    return codes, counts, coded.dictionary


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def utf8(text: pa.Array):
    """(bytes as uint8, offsets) of an array of strings, nulls as empty texts."""
    text = pc.fill_null(text, "") if text.null_count else text
    buf = text.buffers()
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    off = np.frombuffer(buf[1], width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]] if buf[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ngrams(words: pa.Array, sizes: tuple, bits: int, chunk: int = 50_000):
    """Of each word: its bucket, the buckets of its n-grams (UTF-8 bytes of ``^word$``, flat), n-grams per word.

    Word 0 is an empty one, put before the given words.
    """
    joined = pa.concat_arrays([pa.array(["^$"]), pc.binary_join_element_wise("^", words.cast(pa.string()), "$", "")]) if len(words) else pa.array(["^$"])
    parts = [_ngrams(joined.slice(a, chunk), sizes, bits) for a in range(0, len(joined), chunk)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _ngrams(joined: pa.Array, sizes: tuple, bits: int):
    data, off = utf8(joined)
    n = len(off) - 1
    b = data.astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(n), np.diff(off))
    size = np.diff(off)
    # A word's hash: sum of byte * odd power of its place, finished by a multiply and shift.
    place = np.arange(len(b)) - np.repeat(off[:-1], size)
    power = np.cumprod(np.full(max(1, int(size.max())), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat(b * power[place], off[:-1])
    word = ((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64)
    ids, owners = [], []
    for k in sizes:
        if len(b) < k:
            continue
        m = len(b) - k + 1
        ok = np.flatnonzero(owner[:m] == owner[k - 1 :])
        g = np.zeros(m, np.uint64)
        for j in range(k):
            g = g * np.uint64(0x100000001B3) + b[j : j + m]
        ids.append((((g[ok] ^ np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.int64))
        owners.append(owner[ok])
    ids, owners = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    return word, ids[order].astype(np.int32), np.bincount(owners, minlength=n)


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
