"""Exact top-k search by a bit-sliced index.

Vectors become integers floor(scale * x). A block of up to ``BLOCK`` candidates, sorted by id, is held as bit slices:
for each component and bit one bitmap over the block's rows. A query's scores are the sum, over components, of its
integer times the component: slices are added by carry-save bitmap adders, each query bit shifting them, negative
factors taking complemented slices and a constant. The best k rows are then selected from the most significant slice
downward; rows still tied when the slices end lie on the boundary, where the smaller ids win. Scores of the selected
rows are worked out exactly from their integers. Blocks' results meet in one window per query.

A block of candidates is sent once for each group of query blocks and meets them in a cogroup; both are bounded in bytes.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, nor do null ids. All
others must have ``dims`` components, by default as many as most vectors have; those of another length take no part
either, as no inner product with them is defined. A query's own row is every row with its id. A repeated id is a
candidate as often as it occurs; as a query it counts once, with its smallest vector. Extra columns are ignored; an
empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a candidate block and of a query block at most; bytes of a block's integers and of the queries that meet it.
BLOCK, QUERY_BLOCK, BLOCK_BYTES, GROUP_BYTES = 1 << 16, 128, 32 << 20, 16 << 20


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and q, the integers floor(scale * x), of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    v = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return v.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("q"))


def _pack(kind: str, per_block: int):
    """Rows (vec_id, q) of a partition into rows (block, n, ids, codes) of at most ``per_block`` vectors."""

    def run(it):
        ids, codes, n, made = [], [], 0, 0

        def flush():
            i, q = np.concatenate(ids), np.concatenate(codes)
            for a in range(0, len(i), per_block):
                part = q[a : a + per_block]
                small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= part.min() and part.max() <= np.iinfo(t).max)
                row = {"task": [task], "made": [made * per_block + a], "n": [len(part)], "ids": [i[a : a + per_block].tobytes()], "codes": [part.astype(small).tobytes()], "bytes": [np.dtype(small).itemsize]}
                yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("task", pa.int32()), ("made", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("bytes", pa.int32())]))

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in it:
            if batch.num_rows:
                col = batch.column("q")
                codes.append(col.flatten().to_numpy().reshape(batch.num_rows, -1))
                ids.append(batch.column("vec_id").to_numpy())
                n += batch.num_rows
            if n >= per_block:
                yield from flush()
                ids, codes, n, made = [], [], 0, made + 1
        if n:
            yield from flush()

    return run


_PACKED = "task int, made long, n int, ids binary, codes binary, bytes int"


def _unpacked(ids, codes, size):
    i = np.frombuffer(ids.as_py(), np.int64)
    return i, np.frombuffer(codes.as_py(), f"<i{size.as_py()}").astype(np.int64).reshape(len(i), -1)


class SlicedBlock:
    """Bit slices of a block of integer vectors, sorted by id."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        n = len(ids)
        self.low = self.codes.min(axis=0)
        width = int((self.codes.max(axis=0) - self.low).max()).bit_length()
        self.width = max(1, width)
        words = -(-n // 64)
        shifted = np.zeros((words * 64, codes.shape[1]), np.int64)
        shifted[:n] = self.codes - self.low
        #: slices[b][d]: bitmap of bit b of component d, less its least value in the block
        self.slices = [np.ascontiguousarray(np.packbits(((shifted >> b) & 1).astype(np.uint8), axis=0, bitorder="little").T).view(np.uint64) for b in range(self.width)]
        self.all = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
        self.row_of = dict(zip(self.ids.tolist(), range(n)))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of score plus a constant of the query, for all rows."""
        size, columns = np.abs(query), {}
        for d in np.flatnonzero(query).tolist():
            for k in range(int(size[d]).bit_length()):
                if int(size[d]) >> k & 1:
                    for b in range(self.width):
                        s = self.slices[b][d]
                        columns.setdefault(k + b, []).append(~s if query[d] < 0 else s)
        out, place = [], 0
        while columns:
            todo = columns.pop(place, [])
            while len(todo) > 1:
                if len(todo) == 2:
                    a, b = todo
                    todo = [a ^ b]
                    columns.setdefault(place + 1, []).append(a & b)
                else:
                    # Whole-column carry-save step: three thirds of the bitmaps at once.
                    m = len(todo) // 3
                    a, b, c = (np.stack(todo[i * m : (i + 1) * m]) for i in range(3))
                    x = a ^ b
                    columns.setdefault(place + 1, []).extend((a & b) | (x & c))
                    todo = [*(x ^ c), *todo[3 * m :]]
            out.append(todo[0] if todo else np.zeros_like(self.all))
            place += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int):
        """(ids, scores) of the k best rows, the query's own left out."""
        edge, sure = self.all.copy(), np.zeros_like(self.all)
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
        for r in range(a, b):
            edge[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        need = k
        for s in reversed(self.sums(query)):
            upper = edge & s
            n = int(np.bitwise_count(upper).sum())
            if n > need:
                edge = upper
            else:
                sure |= upper
                edge &= ~s
                need -= n
                if not need:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if need:  # ties at the boundary: rows are in order of id
            tied = np.flatnonzero(np.unpackbits(edge.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, tied[:need]])
        return self.ids[rows], self.codes[rows] @ query


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK, query_block: int = QUERY_BLOCK, dims: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every`` the k rows of highest integer inner product."""
    spark = vectors.sparkSession
    q = materialise(quantised(vectors, scale).withColumn("d", F.size("q")), "vectors")
    lengths = q.groupBy("d").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asked"))
    most = (lengths if dims is None else lengths.where(F.col("d") == dims)).orderBy(F.desc("n"), "d").first()
    if most is None or not most["asked"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q = q.where(F.col("d") == most["d"]).drop("d")
    block = max(64, min(block, BLOCK_BYTES // (8 * most["d"]))) if block == BLOCK else block
    # Blocks fill up within tasks: about one task for each block of candidates.
    packed = materialise(q.repartition(-(-most["n"] // block)).mapInArrow(_pack("c", block), _PACKED), "blocks")
    queries = q.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    n_asked = -(-most["asked"] // query_block)
    asked = queries.repartition(n_asked).mapInArrow(_pack("q", query_block), _PACKED)
    # Every group of query blocks meets every block of candidates, by number. There are as many groups as the queries'
    # bytes ask for, or more where the blocks alone would not keep the cores busy.
    blocks = [(r.task, r.made) for r in packed.select("task", "made").collect()]  # one row a block
    numbers = spark.createDataFrame([(i, *b) for i, b in enumerate(blocks)], "block int, task int, made long")
    groups = max(-(-8 * most["d"] * most["asked"] // GROUP_BYTES), min(n_asked, -(-2 * spark.sparkContext.defaultParallelism // len(blocks))))
    left = packed.join(numbers, ["task", "made"]).select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "ids", "codes", "bytes")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))).alias("block"), F.pmod(F.hash("task", "made"), F.lit(groups)).alias("grp"), "ids", "codes", "bytes")

    def meet(key, candidates, asking):
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        for i in range(candidates.num_rows):  # one
            held = SlicedBlock(*_unpacked(*(candidates.column(c)[i] for c in ("ids", "codes", "bytes"))))
            for j in range(asking.num_rows):
                for who, code in zip(*_unpacked(*(asking.column(c)[j] for c in ("ids", "codes", "bytes")))):
                    ids, scores = held.top(int(who), code, k)
                    for name, x in zip(out, (np.full(len(ids), who), ids, scores)):
                        out[name].append(x)
        return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in out.items()})

    cells = min(4096, len(blocks) * groups)
    best = left.repartition(cells, "block", "grp").groupBy("block", "grp").cogroup(right.repartition(cells, "block", "grp").groupBy("block", "grp")).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB's version of ``top_k`` over ``embeddings``.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
p as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from (select vec_id, min(q) as q from v where vec_id % 20 = 0 group by vec_id) a join v b on a.vec_id <> b.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank, vec_id, score from p
qualify rank <= 20
"""
