"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but ids, each document closed by an end id. Files are read as fixed-size blocks; a task finds
the end ids of each block with one vectorised comparison and reports the lengths of the documents that end there, the
first of them without what earlier blocks hold of it. A prefix scan over the blocks of a file then gives, for each
block, the documents closed before it and the tokens since the last end id; it runs in two levels (within segments
of ``SEGMENT`` blocks, then over segments), so a large file's blocks are scanned in many tasks.

Defined cases: two end ids in a row close an empty document (0 tokens); ids after the last end id are a last document
without one (``closed`` false); an empty file has no documents. In ``count_documents`` null and empty texts have 0
tokens, and null and repeated ids are rows like others; a text of any length is encoded whole in its task and may span
blocks; an empty table has no rows. Extra columns are ignored, whatever their names.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, materialise, text_slices

END_ID, DTYPE, BLOCK_IDS, SEGMENT = 50256, "<u2", 1 << 19, 1024


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(ranks: str, pattern: str):
    import base64

    import tiktoken

    kept = getattr(tiktoken, "_loomline_worker", None)
    if kept is None or kept[0] != hash(ranks):
        table = {base64.b64decode(a): int(b) for a, b in map(str.split, ranks.splitlines())}
        kept = tiktoken._loomline_worker = (hash(ranks), tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
    return kept[1]


def write_tokens(docs: DataFrame, path: str | None = None, end: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Each task's documents as one flat file: rows (file, block, data), and rows (file, nth, doc_ids) naming its documents in order."""
    import public_tokenizers

    with open(path or rank_file()) as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))  # a public vocabulary: a few MB

    def run(it):
        enc, file = _encoder(*spec.value), TaskContext.get().partitionId()
        schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("nth", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        held, n_held, block, nth = [], 0, 0, 0

        def full(last):
            nonlocal held, n_held, block
            flat = np.concatenate(held) if held else np.zeros(0, DTYPE)
            stop = len(flat) if last else len(flat) // block_ids * block_ids
            for a in range(0, stop, block_ids):
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "data": [flat[a : min(stop, a + block_ids)].tobytes()], "nth": [None], "doc_ids": [None]}, schema=schema)
                block += 1
            held, n_held = [flat[stop:]], len(flat) - stop

        for batch in it:
            for part in text_slices(batch, limit=2 << 20):
                for t in part.column("text").to_pylist():
                    ids = np.array([*enc.encode_ordinary(t or ""), end], DTYPE)
                    held.append(ids)
                    n_held += len(ids)
                    if n_held >= block_ids:
                        yield from full(False)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [None], "data": [None], "nth": [nth], "doc_ids": [part.column("doc_id").to_pylist()]}, schema=schema)
                nth += part.num_rows
        if n_held:
            yield from full(True)

    return batches(docs, "doc_id", "text").mapInArrow(run, "file int, block long, data binary, nth long, doc_ids array<long>")


def read_token_files(spark: SparkSession, path: str, dtype: str = DTYPE, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Token files as rows (file, block, data), the blocks of a file dealt over tasks.

    Spark hands a binary file over whole, so one task reads and cuts it, and a file of 2 GB or more fails with Spark's own
    message: larger sets are written as several files.
    """
    size = np.dtype(dtype).itemsize * block_ids

    def run(it):
        for batch in it:
            for p, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = data.as_buffer()
                for b in range(-(-raw.size // size)):
                    yield pa.RecordBatch.from_pydict({"file": [p], "block": [b], "data": [raw.slice(b * size, min(size, raw.size - b * size)).to_pybytes()]}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("data", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary").repartition("file", "block")


def scan(blocks: DataFrame, end: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """file, nth (document of the file, from 0), n_tokens (end id left out), closed: one row a document."""
    kind = blocks.schema["file"].dataType

    def run(it):
        for batch in it:
            rows: dict[str, list] = {k: [] for k in ("n", "ends", "last", "lengths")}
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype)
                at = np.flatnonzero(ids == end)
                rows["n"].append(len(ids))
                rows["ends"].append(len(at))
                rows["last"].append(int(at[-1]) + 1 if len(at) else None)
                rows["lengths"].append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(rows["n"], pa.int64()), pa.array(rows["ends"], pa.int64()), pa.array(rows["last"], pa.int64()), pa.array(rows["lengths"], pa.list_(pa.int64()))], names=["file", "block", *rows])

    found = materialise(blocks.select("file", "block", "data").mapInArrow(run, f"file {kind.simpleString()}, block long, n long, ends long, last long, lengths array<long>"), "ends")
    found = found.withColumn("seg", F.floor(F.col("block") / SEGMENT))
    # Within a segment: tokens and end ids before a block, and where the last end id before it stands.
    inner = Window.partitionBy("file", "seg").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    s = found.withColumn("at", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("before", F.coalesce(F.sum("ends").over(inner), F.lit(0)))
    s = s.withColumn("closed_at", F.max(F.col("at") + F.col("last")).over(inner))
    # Over segments: the same from one row each.
    seg = s.groupBy("file", "seg").agg(F.sum("n").alias("seg_n"), F.sum("ends").alias("seg_ends"), F.max(F.col("at") + F.col("last")).alias("seg_last"))
    outer = Window.partitionBy("file").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("seg_at", F.coalesce(F.sum("seg_n").over(outer), F.lit(0))).withColumn("seg_before", F.coalesce(F.sum("seg_ends").over(outer), F.lit(0)))
    seg = seg.withColumn("seg_closed", F.coalesce(F.max(F.col("seg_at") + F.col("seg_last")).over(outer), F.lit(0)))
    s = s.join(seg.select("file", "seg", "seg_at", "seg_before", "seg_closed"), ["file", "seg"])
    start = F.col("seg_at") + F.col("at")
    s = s.withColumn("carried", start - F.coalesce(F.col("seg_at") + F.col("closed_at"), "seg_closed")).withColumn("first", F.col("seg_before") + F.col("before"))
    ended = s.select("file", "first", "carried", F.posexplode("lengths").alias("i", "len"))
    ended = ended.select("file", (F.col("first") + F.col("i")).alias("nth"), (F.col("len") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    total = s.groupBy("file").agg(F.sum("ends").alias("nth"), (F.sum("n") - F.coalesce(F.max(start + F.col("last")), F.lit(0))).alias("n_tokens"))
    return ended.unionByName(total.where("n_tokens > 0").select("file", "nth", "n_tokens", F.lit(False).alias("closed")))


def count_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every document: written as flat token files, then counted by the scan alone."""
    written = materialise(write_tokens(docs, path), "tokens")
    names = written.where("data is null").select("file", "nth", F.posexplode("doc_ids").alias("i", "doc_id")).select("file", (F.col("nth") + F.col("i")).alias("nth"), "doc_id")
    return names.join(scan(written.where("data is not null")), ["file", "nth"]).select("doc_id", "n_tokens")
