"""Vector collection: cosine search, thresholds, re-ranking and context assembly.

Search is exact. At most ``QUERY_BLOCK`` query vectors (counted first) go to every task, which keeps its k best of each;
more of them are packed into blocks by tasks, and each block meets each group of vectors. The tasks' results meet in one
window per query. Similarities are compared to nine digits. Vectors of zero length, null vectors, null ids and those of
another dimension are never hits.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

QUERY_BLOCK = 4096


def _block(vectors: DataFrame, ids: list, matrix: np.ndarray, k: int) -> DataFrame:
    spark = vectors.sparkSession
    norms = np.linalg.norm(matrix, axis=1)
    shared = spark.sparkContext.broadcast((ids, matrix, norms))

    def run(it):
        q_ids, q, q_norm = shared.value
        best: list = [None] * len(q_ids)
        for batch in it:
            lists = batch.column("embedding")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ok = np.flatnonzero(size == q.shape[1])
            if not len(ok):
                continue
            x = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ok), -1)
            vid = batch.column("id").take(pa.array(ok)).to_numpy(zero_copy_only=False)
            norm = np.linalg.norm(x, axis=1)
            full = (norm > 0) & np.isfinite(norm)
            x, vid, norm = x[full], vid[full], norm[full]
            for i in range(len(q_ids)):
                if not q_norm[i] > 0:
                    continue
                s = np.round(x @ q[i] / (norm * q_norm[i]), 9)
                v = vid
                if best[i] is not None:
                    s, v = np.concatenate([best[i][0], s]), np.concatenate([best[i][1], v])
                if len(s) > k:
                    cut = np.partition(s, len(s) - k)[len(s) - k]
                    keep = s >= cut
                    s, v = s[keep], v[keep]
                order = np.lexsort((v, -s))[:k]
                best[i] = (s[order], v[order])
        for i, b in enumerate(best):
            if b is not None and len(b[0]):
                yield pa.RecordBatch.from_arrays([pa.array([q_ids[i]] * len(b[0]), pa.int64()), pa.array(b[1], pa.int64()), pa.array(b[0])], names=["query_id", "id", "similarity"])

    return vectors.select("id", "embedding").mapInArrow(run, "query_id long, id long, similarity double")


def _packed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """(nth, ids, data, dim) of at most ``rows`` vectors of one dimension each."""

    def run(it):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        for batch in it:
            lists = batch.column("embedding")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for d in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == d)
                for i in range(0, len(at), rows):
                    some = pa.array(at[i : i + rows])
                    x = lists.take(some).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    row = {"nth": [(task << 33) + made], "ids": [batch.column(key).take(some).cast(pa.int64()).to_numpy().tobytes()], "data": [x.tobytes()], "dim": [d]}
                    yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("nth", pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("dim", pa.int32())]))
                    made += 1

    return df.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, "embedding").mapInArrow(run, "nth long, ids binary, data binary, dim int")


def _blocks_meet(vectors: DataFrame, queries: DataFrame, k: int, block: int, rows: int = 16_384) -> DataFrame:
    """Best k of each query in each group of vectors. Tasks pack both sides into blocks; every group of about ``rows``
    vectors is held by one task while all blocks of queries pass. The driver sees neither."""
    groups = max(1, -(-vectors.count() // rows))
    left = _packed(vectors, "id", min(rows, 1024)).select(F.pmod(F.xxhash64("nth"), F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("side"), "ids", "data", "dim")
    right = _packed(queries, "query_id", block).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("side"), "ids", "data", "dim")

    def best(asked, held, dim):
        q_ids, q, q_norm = asked
        out: list = []
        for ids, x, norm in (h for h in held if h[1].shape[1] == dim and len(h[0])):
            for i in np.flatnonzero(q_norm > 0).tolist():
                s, v = np.round(x @ q[i] / (norm * q_norm[i]), 9), ids
                if len(s) > k:
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, v = s[keep], v[keep]
                order = np.lexsort((v, -s))[:k]
                out.append((np.full(len(order), q_ids[i]), v[order], s[order]))
        return out

    def run(it):
        now, held = None, []
        for batch in it:
            for grp, side, ids, data, dim in zip(*(batch.column(c).to_pylist() for c in ("grp", "side", "ids", "data", "dim"))):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
                norm = np.linalg.norm(x, axis=1)
                if grp != now:
                    now, held = grp, []
                if not side:
                    ok = (norm > 0) & np.isfinite(norm)
                    held.append((ids[ok], x[ok], norm[ok]))
                elif out := best((ids, x, norm), held, dim):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "id", "similarity"])

    dealt = left.unionByName(right).repartition(min(groups, 4096), "grp").sortWithinPartitions("grp", "side")
    return dealt.mapInArrow(run, "query_id long, id long, similarity double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, where=None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id, distance, score: the k nearest by cosine, ties to smaller ids; ``where`` filters before the k are taken.

    vectors(id long, embedding, ...), queries(query_id long, embedding).
    """
    v = (vectors.where(where) if where is not None else vectors).where("id is not null")
    spark = vectors.sparkSession
    asked = queries.where("embedding is not null and query_id is not null").select("query_id", "embedding")
    few = asked.limit(block + 1).collect()
    if len(few) > block:
        best = _blocks_meet(v, asked, k, block)
    else:
        by_size: dict[int, list] = {}
        for r in few:
            by_size.setdefault(len(r.embedding), []).append((r.query_id, r.embedding))
        if not by_size:
            return spark.createDataFrame([], "query_id long, rank int, id long, distance double, score double")
        best = reduce(DataFrame.unionByName, [_block(v, [i for i, _ in g], np.array([e for _, e in g], np.float64), k) for g in by_size.values()])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), F.round("similarity", 6).alias("score"))


def search_with_threshold(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.3, where=None) -> DataFrame:
    """The k nearest, then those that score the threshold at least: never more than the k."""
    return search(vectors, queries, k, where).where(F.col("score") >= threshold)


def rerank(hits: DataFrame, k: int = 3) -> DataFrame:
    """The k best hits of each query by score, in stable order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def confidence(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("confidence"))


def context(hits: DataFrame) -> DataFrame:
    """query_id, context: the hits (place, score, text, file_name, chunk_index) as numbered source blocks."""
    source, number = F.coalesce("file_name", F.lit("Sconosciuto")), F.coalesce(F.col("chunk_index").cast("string"), F.lit("N/A"))
    head = F.format_string("[Fonte %d - %s, Chunk #%s (Rilevanza: %s)]", F.col("place"), source, number, F.format_string("%.2f", "score"))
    part = F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n---"))
    # At most the re-ranked few of a query meet here.
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def preview(text, n: int = 200):
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def store(chunks: DataFrame, embed, key: str = "id") -> DataFrame:
    """id, embedding, document, metadata of chunks; ids come from the content, so repeated adds do not collide."""
    meta = [c for c in chunks.columns if c not in (key, "content")]
    ids = chunks[key] if key in chunks.columns else F.xxhash64(F.sha2("content", 256), *[F.col(f"`{c}`").cast("string") for c in meta])
    return chunks.select(ids.alias("id"), embed(F.col("content")).alias("embedding"), F.col("content").alias("document"), F.create_map(*[x for c in meta for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("metadata"))


def hashing_embedding(dim: int = 256):
    """A stand-in for a sentence model where none is at hand: hashed words, counted and brought to unit length.

    Built from column functions; a model is any other function from a column of texts to a column of vectors.
    """
    def embed(text):
        words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)
        places = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dim)).cast("int"))
        # With every place once more in the array, place p's words are the gap between two of these in sorted order.
        ordered = F.array_sort(F.concat(places, F.sequence(F.lit(0), F.lit(dim))))

        def unit(n):
            norm = F.sqrt(F.aggregate(n, F.lit(0.0), lambda a, x: a + x * x))
            return T.let(norm, lambda z: F.transform(n, lambda x: F.when(z > 0, x / z).otherwise(0.0).cast("float")))

        def counts(o):
            first = F.filter(F.transform(o, lambda p, i: F.when((i == 0) | (p != F.get(o, i - 1)), i)), lambda i: i.isNotNull())
            return T.let(first, lambda at: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda p: (F.get(at, p + 1) - F.get(at, p) - 1).cast("double")))

        return T.let(T.let(ordered, counts), unit)

    return embed


def write_collection(rows: DataFrame, path: str, reset: bool = False) -> None:
    rows.write.mode("overwrite" if reset else "append").parquet(path)


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a collection; none where nothing was written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "id long, embedding array<float>, document string, metadata map<string,string>")
    return spark.read.parquet(path)
