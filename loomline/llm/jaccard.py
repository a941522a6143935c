"""N-gram Jaccard join by grouped prefix filtering, returning link components.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; with fewer words the whole sequence is one
shingle), as 64-bit hashes. Two documents link when ``4 * overlap >= 3 * union``. Such a pair shares a shingle among
the first ``n - ceil(3n/4) + 1`` of both sets under any one global order; here rarer shingles come first, by a count
sketch over all documents that grows with the input (it only orders: every order gives the same result).

1. ``measured``: each document's set size and fingerprints, and the sketch. Documents with equal sets are one node.
2. ``candidates``: documents with identical prefix and size are one group, whichever tasks read them, named by the hash
   of both. Prefix entries are sent by hash range; runs of equal shingles give candidate pairs of groups, each group
   with its neighbour in order of size and with the run's hub, never all pairs, and the runs themselves for step 4.
   A shingle of very many documents is dealt over several ranges.
3. Groups are expanded by their members. A pair whose parity bitmaps already differ in more places than a link allows
   is ruled out; the others are compared exactly (``verified``): first each node with the partner it shares most
   entries with, then pairs not yet in one component.
4. Runs whose nodes still lie in several components yield every pair across components that passes the size, position
   and bitmap filters, in cells of bounded size; these are verified too. A pair within a component needs no check, as
   its link could not change the result. No case is capped.

Components come from stars over each task's links, then alternating large-star and small-star steps until all are
settled; later links join whole components.

Defined cases: a null text or one without words has no shingles and links with nothing, so its component is its own
id; equal texts always link; rows with a null id take part (a component made of them alone has a null id); repeated
rows give repeated results. A text of any length is one set in the memory of its task, some 30 bytes a word. Extra
columns are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialise, mix64, starts, text_slices, trim, words_of

WORDS, SEGMENTS = 5, 64
#: The sketch has a counter (one byte where it is shared) for this many bytes of input, between 2^18 and 2^26 of them.
BYTES_A_COUNTER, MIN_BITS, MAX_BITS = 256, 18, 26
#: Entries that one hash range holds, about; that a task holds at once; documents of a shingle that one range may get.
RANGE_ENTRIES, HELD_ENTRIES, HOT_ENTRIES = 1 << 19, 1 << 20, 1 << 18
#: Hash ranges of one task. Every file that a task writes costs Hadoop's local file system several ``chmod`` processes, and
#: each of them counts with the executor's whole memory until it has begun, so tasks of one small range are dear.
RANGES_A_TASK = 4
#: Rows of a run on either side of one cell of step 4.
CELL = 4096
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)


def shingles(text: pa.Array):
    """(hashes, per row): each row's distinct shingles in ascending order."""
    codes, counts, vocabulary = words_of(text, lower=True)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in vocabulary.to_pylist()], np.uint64)
    w = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    off = starts(counts)
    n = len(w)
    sums = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        sums += w[k : n - WORDS + 1 + k] * _FACTORS[k] if n >= WORDS else 0
    sums = mix64(sums)
    sets = []
    for a, k in zip(off[:-1].tolist(), counts.tolist()):
        if k >= WORDS:
            s = np.sort(sums[a : a + k - WORDS + 1])
            new = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=new[1:])
            sets.append(s[new])
        elif k:
            sets.append(mix64((w[a : a + k] * _FACTORS[:k]).sum(keepdims=True) + np.uint64(k)))
        else:
            sets.append(sums[:0])
    return (np.concatenate(sets) if sets else sums[:0]), np.array([len(s) for s in sets], np.int64)


def prefix_length(n):
    return n - -(-3 * n // 4) + 1


def _node(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def _squeezed(x: np.ndarray) -> bytes:
    raw = x.tobytes()
    return bytes([x.dtype.itemsize]) + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _loose(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), "zstd"), f"<u{raw[0]}")


def _smallest(x: np.ndarray) -> np.ndarray:
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or int(x.max()) <= np.iinfo(t).max))


# ---- counters over all documents ----------------------------------------------------------------------------------

_COUNTERS = "seg int, part int, at binary, n binary"


def _segments(at: np.ndarray, n: np.ndarray, bits: int, part: int) -> dict:
    """Counters (sorted places, counts) as one row a segment: gaps between places, and counts."""
    size = (1 << bits) // SEGMENTS
    cut = np.searchsorted(at, np.arange(SEGMENTS + 1) * size)
    out: dict = {"seg": [], "part": [], "at": [], "n": []}
    for s in range(SEGMENTS):
        a, b = cut[s], cut[s + 1]
        if b > a:
            out["seg"].append(s)
            out["part"].append(part)
            out["at"].append(_squeezed(_smallest(np.diff(at[a:b] - s * size, prepend=0).astype(np.int64))))
            out["n"].append(_squeezed(_smallest(n[a:b])))
    return out


def _added(rows: pa.Table, size: int) -> np.ndarray:
    total = np.zeros(size, np.int64)
    for at, n in zip(rows.column("at"), rows.column("n")):
        total[np.cumsum(_loose(at.as_py()).astype(np.int64))] += _loose(n.as_py()).astype(np.int64)
    return total


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: exact up to 128, then four steps a doubling, up to some 4e11."""
    c = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts <= 128, counts, np.minimum(255, 128 + 4 * np.log2(c / 128))).astype(np.uint8)


def merged(rows: DataFrame, parts: int, bits: int) -> np.ndarray:
    """Levels of all counters, added up by a tree: at most 64 rows meet in one group. One byte a counter is collected."""
    size = (1 << bits) // SEGMENTS

    def meet(key, table):
        total = _added(table, size)
        at = np.flatnonzero(total)
        gaps = np.diff(at, prepend=0)
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "at": pa.array([_squeezed(_smallest(gaps))], pa.binary()), "n": pa.array([_squeezed(_smallest(total[at]))], pa.binary())})

    def last(key, table):
        return pa.table({"seg": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([_squeezed(levels(_added(table, size)))], pa.binary())})

    while parts > 64:
        parts = -(-parts // 64)
        rows = rows.withColumn("part", (F.col("part") % parts).cast("int")).groupBy("seg", "part").applyInArrow(meet, _COUNTERS)
    out = np.zeros(1 << bits, np.uint8)
    for r in rows.groupBy("seg").applyInArrow(last, "seg int, data binary").collect():  # SEGMENTS rows, 2^bits bytes in all
        out[r.seg * size : (r.seg + 1) * size] = _loose(bytes(r.data))
    return out


def sketch_bits(docs: DataFrame) -> int:
    """Bits of a counter's place, by the size that Spark estimates for the input."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:  # Spark knows nothing
        size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    return min(MAX_BITS, max(MIN_BITS, (size // BYTES_A_COUNTER).bit_length()))


def measured(docs: DataFrame, bits: int, seed: int = 0):
    """Table of doc_id, th, n, node, f2 and, in rows with seg set, the sketch's counters."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("f2", pa.int64()), ("seg", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("n_at", pa.binary())])

    def counters(held, part):
        at, n = np.unique(np.concatenate(held), return_counts=True)
        c = _segments(at, n, bits, part)
        none = [None] * len(c["seg"])
        return pa.RecordBatch.from_pydict({**dict.fromkeys(("doc_id", "th", "n", "node", "f2"), none), "seg": c["seg"], "part": c["part"], "at": c["at"], "n_at": c["n"]}, schema=schema)

    def run(it):
        held, n_held, part = [], 0, TaskContext.get().partitionId()
        for batch in it:
            for rows in text_slices(batch):
                flat, n = shingles(rows.column("text"))
                held.append((flat >> np.uint64(64 - bits)).astype(np.uint32))
                n_held += len(flat)
                off = starts(n)
                sets = [flat[a:b] for a, b in zip(off[:-1], off[1:])]
                none = pa.nulls(rows.num_rows, pa.int32())
                raw = pa.nulls(rows.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("th"), pa.array(n.astype(np.int32)), pa.array([_node(s, seed) for s in sets], pa.int64()), pa.array([_node(s, seed + 1000003) for s in sets], pa.int64()), none, none, raw, raw], schema=schema)
                if n_held > 4 << 20:
                    yield counters(held, part)
                    held, n_held = [], 0
        if n_held:
            yield counters(held, part)

    return materialise(_keyed(docs).mapInArrow(run, "doc_id long, th long, n int, node long, f2 long, seg int, part int, at binary, n_at binary"), "measured")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


# ---- bitmaps --------------------------------------------------------------------------------------------------------


def parity(s: np.ndarray) -> bytes:
    """Bit b tells whether an odd number of the set's hashes are b modulo the bitmap's size, a power of two from n up."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sig: np.ndarray, size: int) -> np.ndarray:
    return sig if len(sig) == size else np.bitwise_xor.reduce(sig.reshape(-1, size), axis=0)


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether two sets can link: bits that differ stand for at least so many shingles that only one set holds."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    return 7 * int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum()) <= n + m


# ---- candidates -----------------------------------------------------------------------------------------------------

_CAND = "a long, b long, n_shared int, run long, grp array<long>, sizes array<int>, places array<int>, g long, node long, th long, n int, sig binary"
_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_shared", pa.int32()), ("run", pa.int64()), ("grp", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())), ("g", pa.int64()), ("node", pa.int64()), ("th", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])
_MEMBER = ("g", "node", "th", "n", "sig")


def _rows(**columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def candidates(docs: DataFrame, sketch: np.ndarray, bits: int, ranges: int, seed: int = 0) -> DataFrame:
    """Rows (a, b, n_shared): candidate pairs of groups; (run, grp, sizes, places): parts of runs of three groups or
    more; (g, node, th, n, sig): members of groups. Columns that a row does not have are null."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sketch)  # 2^bits bytes, 64 MB at most
    blob = pa.schema([("rng", pa.int32()), ("hs", pa.binary()), ("gs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), *[_OUT.field(k) for k in _MEMBER]])
    most = np.where(np.arange(256) <= 128, np.arange(256), 128 * 2.0 ** ((np.arange(256) - 127) / 4))
    most_held = HELD_ENTRIES
    shares = np.maximum(1, np.ceil(most / HOT_ENTRIES)).astype(np.int64)  # ranges that a shingle of each level is dealt over

    def emit(it):
        seen, known, order = set(), set(), shared.value
        for batch in it:
            for part in text_slices(batch):
                flat, n = shingles(part.column("text"))
                off, th = starts(n), part.column("th").to_pylist()
                hs, gs, sizes, places, level = [], [], [], [], []
                member: dict = {k: [] for k in _MEMBER}
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                    s = flat[a:b]
                    if a == b:
                        continue
                    node = _node(s, seed)
                    if node in seen:
                        continue
                    seen.add(node)
                    key = (order[s >> np.uint64(64 - bits)].astype(np.uint64) << np.uint64(56)) | (s & np.uint64((1 << 56) - 1))
                    p = prefix_length(len(s))
                    key = np.sort(np.partition(key, p - 1)[:p]) if p < len(s) else np.sort(key)
                    g = xxhash.xxh3_64_intdigest(key.tobytes() + len(s).to_bytes(8, "little"), seed) - (1 << 63)
                    for k, v in zip(_MEMBER, (g, node, th[i], len(s), parity(s))):
                        member[k].append(v)
                    if g in known:
                        continue  # an identical prefix and size: one group
                    known.add(g)
                    hs.append(key)
                    gs.append(g)
                    sizes.append(len(s))
                    places.append(p)
                if not member["g"]:
                    continue
                none = [None] * len(member["g"])
                yield pa.RecordBatch.from_pydict({"rng": [-1] * len(none), **dict.fromkeys(("hs", "gs", "sizes", "places"), none), **member}, schema=blob)
                if not hs:
                    continue
                many = np.array(places)
                key, g, size = np.concatenate(hs), np.repeat(np.array(gs, np.int64), many), np.repeat(np.array(sizes, np.int64), many)
                place = np.arange(len(key)) - np.repeat(starts(many)[:-1], many)
                share = shares[(key >> np.uint64(56)).astype(np.int64)]
                h = key & np.uint64((1 << 56) - 1)
                own = (g.view(np.uint64) % share.astype(np.uint64)).astype(np.int64)
                rng = (mix64(h + np.uint64(0x9E3779B97F4A7C15) * own.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64) + ranges * (share > 1)
                # A hot shingle's first share goes to its other ranges too, so that hubs are common to them.
                hot = np.flatnonzero((share > 1) & (own == 0))
                if len(hot):
                    n_more = share[hot] - 1
                    again = np.repeat(hot, n_more)
                    nth = np.arange(len(again)) - np.repeat(starts(n_more)[:-1], n_more) + 1
                    rng = np.concatenate([rng, (mix64(h[again] + np.uint64(0x9E3779B97F4A7C15) * nth.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64) + ranges])
                    h, g, size, place = (np.concatenate([x, x[again]]) for x in (h, g, size, place))
                by = np.argsort(rng, kind="stable")
                cut = np.flatnonzero(np.diff(rng[by])) + 1
                none = [None] * (len(cut) + 1)
                # Six bytes of a hash: the range stands for more.
                six = np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :6])
                cols = [[x[i].tobytes() for i in np.split(by, cut)] for x in (six, g, _smallest(size), _smallest(place))]
                yield pa.RecordBatch.from_pydict({"rng": rng[by][np.concatenate([[0], cut])].astype(np.int32), "hs": cols[0], "gs": cols[1], "sizes": cols[2], "places": cols[3], **dict.fromkeys(_MEMBER, none)}, schema=blob)

    kinds = "rng int, hs binary, gs binary, sizes binary, places binary, g long, node long, th long, n int, sig binary"
    sent = _keyed(docs).mapInArrow(emit, kinds)
    # Members have no range; they are dealt by their nodes. A task works on its ranges one after another.
    dealt = sent.repartition(min(max(4, ranges // RANGES_A_TASK), 2000), F.when(F.col("rng") >= 0, F.col("rng")).otherwise(F.hash("node"))).sortWithinPartitions("rng")
    out = materialise(dealt.mapInArrow(lambda it: _meet(it, ranges, most_held), _CAND), "candidates")
    shared.destroy()
    return out


def _meet(it, ranges: int, most: int):
    """Prefix entries of one hash range after another into candidate pairs and runs; members pass through."""
    now, held, n_held, parts = None, [], 0, False
    for batch in it:
        rng = np.array(batch.column("rng").to_pylist())
        apart = np.flatnonzero(rng < 0)
        if len(apart):
            m = batch.take(pa.array(apart))
            yield _rows(**{k: m.column(k) for k in _MEMBER})
        for i in np.flatnonzero(rng >= 0).tolist():
            if rng[i] != now:
                if held:
                    yield from _runs(held, parts or now >= ranges)
                now, held, n_held, parts = int(rng[i]), [], 0, False
            g = np.frombuffer(batch.column("gs")[i].as_py(), np.int64)
            h = np.zeros((len(g), 8), np.uint8)
            h[:, :6] = np.frombuffer(batch.column("hs")[i].as_py(), np.uint8).reshape(-1, 6)
            rest = []
            for c in ("sizes", "places"):
                raw = batch.column(c)[i].as_py()
                rest.append(np.frombuffer(raw, f"<u{len(raw) // len(g)}").astype(np.int32))
            held.append((h.view(np.uint64)[:, 0], g, *rest))
            n_held += len(g)
            if n_held > most:
                # More than a range should hold: work on what is there; the hub of each shingle meets what is to come.
                hubs = _hubs(held)
                yield from _runs(held, True)
                held, n_held, parts = [hubs], 0, True
    if held:
        yield from _runs(held, parts or now >= ranges)
    trim()


def _hubs(held):
    h, g, size, place = (np.concatenate([x[k] for x in held]) for k in range(4))
    order = np.lexsort((g, size, place, h))
    first = np.ones(len(h), bool)
    first[1:] = h[order][1:] != h[order][:-1]
    at = order[first]
    return h[at], g[at], size[at], place[at]


def possible(n, m, i, j):
    """Whether sets of sizes n and m whose first shared shingle is at places i and j can link."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (7 * np.minimum(n - i, m - j) >= 3 * (n + m))


def _runs(held, parts: bool):
    """Pairs and runs of a range's entries. ``parts``: other rows may hold more of the same runs, so their hash names them."""
    key, g, size, place = (np.concatenate([x[k] for x in held]) for k in range(4))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    keep = np.zeros(len(k), bool)
    keep[1:] |= same
    keep[:-1] |= same
    at = order[keep]
    if not len(at):
        return
    at = at[np.lexsort((g[at], size[at], key[at]))]
    # A group that several tasks sent appears once.
    once = np.ones(len(at), bool)
    once[1:] = (key[at][1:] != key[at][:-1]) | (g[at][1:] != g[at][:-1])
    at = at[once]
    k, n, s, p = key[at].copy(), g[at], size[at].astype(np.int64), place[at].astype(np.int64)
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(k)))
    # A run's hub is the group that has its shingle earliest: few rarer shingles of its own stand before it, as in the
    # text that near copies were made from. Every group pairs with the hub and with its neighbour in order of size.
    run = np.repeat(np.arange(len(first)), length)
    hub = np.repeat(np.lexsort((n, s, p, run))[first], length)
    every, inside = np.arange(len(k)), np.flatnonzero(~new)
    left = np.concatenate([hub[every != hub], inside - 1])
    right = np.concatenate([every[every != hub], inside])
    ok = possible(s[left], s[right], p[left], p[right])
    a, b = np.minimum(n[left[ok]], n[right[ok]]), np.maximum(n[left[ok]], n[right[ok]])
    if len(a):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        start = np.flatnonzero(new)
        yield _rows(a=a[start], b=b[start], n_shared=np.diff(np.append(start, len(a))).astype(np.int32))
    # Runs of three or more; whole runs of the same groups are one, with their least places.
    runs: dict = {}
    for f, m in zip(first.tolist(), length.tolist()):
        if m > 2 or parts and m > 1:
            name = (int(mix64(k[f : f + 1])[0]) if parts else xxhash.xxh3_64_intdigest(n[f : f + m].tobytes())) - (1 << 63)
            last = runs.get(name)
            runs[name] = (n[f : f + m], s[f : f + m], p[f : f + m] if last is None else np.minimum(last[2], p[f : f + m]))
    # Rows of at most ``CELL`` groups, so that none is large.
    rows = [(name, *(x[a : a + CELL] for x in r)) for name, r in runs.items() for a in range(0, len(r[0]), CELL)]
    for i in range(0, len(rows), 500):
        some = rows[i : i + 500]
        yield _rows(run=[r[0] for r in some], grp=[r[1] for r in some], sizes=[r[2].astype(np.int32) for r in some], places=[r[3].astype(np.int32) for r in some])


# ---- exact checks ---------------------------------------------------------------------------------------------------


def texts_of(docs: DataFrame, wanted: DataFrame, bits: int, seed: int = 0) -> DataFrame:
    """node, body (compressed lower-case text) of the wanted nodes (node, th), one row each.

    A bitmap of 2^bits bits over the wanted texts' hashes keeps most others from being worked on; the join is exact.
    """
    spark = docs.sparkSession

    def mark(it):
        for batch in it:
            at = np.unique((batch.column("th").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            yield pa.RecordBatch.from_pydict(_segments(at, np.ones(len(at), np.int64), bits, TaskContext.get().partitionId()), schema=pa.schema([("seg", pa.int32()), ("part", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    marked = wanted.select("th").coalesce(64).mapInArrow(mark, _COUNTERS)
    shared = spark.sparkContext.broadcast(np.packbits(merged(marked, 64, bits) > 0, bitorder="little"))  # 8 MB at most

    def bodies(it):
        known, seen = shared.value, set()
        for batch in it:
            at = (batch.column("th").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            batch = batch.filter(pa.array((known[at >> 3] >> (at & 7) & 1).astype(bool)))
            for part in text_slices(batch):
                flat, n = shingles(part.column("text"))
                off = starts(n)
                nodes, body = [], []
                for i, t in enumerate(part.column("text")):
                    node = _node(flat[off[i] : off[i + 1]], seed)
                    if n[i] and node not in seen:
                        seen.add(node)
                        raw = t.as_py().encode()
                        nodes.append(node)
                        body.append(len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(body, pa.binary())], names=["node", "body"])

    found = _keyed(docs).mapInArrow(bodies, "node long, body binary").join(wanted.select("node").hint("merge"), "node", "left_semi")
    out = materialise(found.dropDuplicates(["node"]), "bodies")
    shared.destroy()
    return out


def verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """hub, other, linked of the pairs (hub, other), by their whole sets. The hub's text is attached to slim pairs, so
    that a hub of very many pairs makes no heavy join key."""

    def run(it):
        last: dict = {}
        for batch in it:
            ids = [batch.column(c).to_pylist() for c in ("hub", "other")]
            yes = []
            for i in range(batch.num_rows):
                sets = []
                for c, who in (("x", ids[0][i]), ("y", ids[1][i])):
                    s = last.get(who)
                    if s is None:
                        raw = batch.column(c)[i].as_py()
                        text = pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), "zstd", asbytes=True)
                        if len(last) > 400:
                            last.clear()
                        s = last[who] = shingles(pa.array([text]).cast(pa.string()))[0]
                    sets.append(s)
                x, y = sets
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                yes.append(7 * shared >= 3 * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("other"), pa.array(yes, pa.bool_())], names=["hub", "other", "linked"])

    met = pairs.select("hub", "other").join(bodies.select(F.col("node").alias("hub"), F.col("body").alias("x")).hint("merge"), "hub").join(bodies.select(F.col("node").alias("other"), F.col("body").alias("y")).hint("merge"), "other")
    return materialise(met.select("hub", "other", "x", "y").mapInArrow(run, "hub long, other long, linked boolean"), "verified")


# ---- components -----------------------------------------------------------------------------------------------------


def _stars(it, most: int = 1 << 20):
    """Edges (u, v) into edges from every node to the least one that the edges at hand, ``most`` at a time, reach."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def flush():
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    n = 0
    for batch in it:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
        n += batch.num_rows
        if n >= most:
            yield flush()
            n = 0
    if up:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node it reaches) of every node that has a link (a, b), written."""
    first = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(first.mapInArrow(_stars, "u long, v long").distinct(), "edges")
    while True:
        # Settled when every node has one edge and no node that others point to points on: one query tells, and one
        # shuffle, as the driver remembers every query and has a thread for every shuffle of late.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met")).where("out + met > 1 and out > 0").isEmpty():
            break
        # Large star: larger neighbours go to the least neighbour. Small star: smaller ones and the node itself do.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        after = materialise(small.distinct(), "edges")
        free(edges)
        edges = after
    out = materialise(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()), "components")
    free(edges)
    return out


def _comps(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs (hub, other) with ca and cb, the components of both; only those across components."""
    c = lambda side, name: comp.select(F.col("node").alias(side), F.col("comp").alias(name)).hint("merge")
    p = pairs.join(c("hub", "ca"), "hub", "left").join(c("other", "cb"), "other", "left")
    return p.withColumn("ca", F.coalesce("ca", "hub")).withColumn("cb", F.coalesce("cb", "other")).where("ca <> cb")


def joined(comp: DataFrame, linked: DataFrame) -> DataFrame:
    """Components after more links (hub, other): whole components are joined, their nodes follow."""
    between = materialise(_comps(linked, comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "between")
    if between.isEmpty():
        free(between)
        return comp
    moved = components(between)
    free(between)
    # A component of one node has no row yet.
    rows = comp.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")).hint("merge"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    out = materialise(rows.unionByName(moved.join(comp.select("node").hint("merge"), "node", "left_anti").select("node", "comp")), "components")
    free(moved, comp)
    return out


# ---- pairs of nodes -------------------------------------------------------------------------------------------------


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (hub, other, ..., x, y, n, m) whose bitmaps do not rule a link out."""
    kept = [c for c in pairs.columns if c not in ("x", "y", "n", "m")]

    def run(it):
        for batch in it:
            ok = [may_link(x.as_buffer(), y.as_buffer(), n, m) for x, y, n, m in zip(batch.column("x"), batch.column("y"), batch.column("n").to_pylist(), batch.column("m").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept], names=kept).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*kept).schema))


def _cells(it):
    """Entries of one cell after another (sorted by cell) into pairs across components that pass the filters."""
    held: list = []
    now = None

    def pairs():
        nodes, comps, n, p, side = (np.array([e[k] for e in held], np.int64) for k in range(1, 6))
        order = np.lexsort((nodes, n))
        nodes, comps, n, p, side = (x[order] for x in (nodes, comps, n, p, side))
        sigs = [held[i][6] for i in order]
        out = []
        for i in range(len(nodes) - 1):
            j = np.arange(i + 1, np.searchsorted(n, 4 * n[i] // 3, side="right"))
            # Sides 0 and 1 of a cell meet each other; side 2 stands for a run's only cell, or one part with itself.
            j = j[(comps[j] != comps[i]) & (nodes[j] != nodes[i]) & ((side[i] == 2) | (side[j] != side[i])) & possible(n[i], n[j], p[i], p[j])]
            out += [(min(nodes[i], nodes[k]), max(nodes[i], nodes[k])) for k in j.tolist() if may_link(sigs[i], sigs[k], int(n[i]), int(n[k]))]
        both = np.unique(np.array(out, np.int64).reshape(-1, 2), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["hub", "other"])

    for batch in it:
        rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "comp", "size", "place", "side", "sig")))
        for r in rows:
            if r[0] != now:
                if len(held) > 1:
                    yield pairs()
                now, held = r[0], []
            held.append(r)
    if len(held) > 1:
        yield pairs()


def _run_pairs(cand: DataFrame, members: DataFrame, comp: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs (hub, other) across components within runs and groups, groups expanded to their members."""
    runs = cand.where("run is not null").select("run", F.explode(F.arrays_zip("grp", "places")).alias("x")).select("run", F.col("x.grp").alias("g"), F.col("x.places").alias("place"))
    # A group of several members is a run, and so is a pair of groups one of which is; its places are not known, so 0.
    many = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
    alone = many.select(F.xxhash64("g").alias("run"), "g", F.lit(0).alias("place"))
    short = cand.where("a is not null").select("a", "b").distinct()
    grown = short.join(many.select(F.col("g").alias("a")), "a", "left_semi").unionByName(short.join(many.select(F.col("g").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    paired = grown.select(F.xxhash64("a", "b").alias("run"), F.explode(F.array("a", "b")).alias("g")).select("run", "g", F.lit(0).alias("place"))
    # A group's members have one size.
    labelled_members = members.join(comp.hint("merge"), "node", "left").select("g", "node", F.col("n").alias("size"), F.coalesce("comp", "node").alias("comp"))
    entries = runs.unionByName(alone).unionByName(paired).join(labelled_members.hint("merge"), "g").groupBy("run", "node", "comp").agg(F.max("size").alias("size"), F.min("place").alias("place"))
    entries = materialise(entries, "entries")
    several = entries.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("run", F.ceil(F.col("k") / cell).cast("int").alias("parts"))
    kept = entries.join(several.hint("merge"), "run").join(members.select("node", "sig").hint("merge"), "node")
    # A long run is cut into parts by its nodes' hashes; each two parts meet in a cell, each part with itself in another.
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    kept = kept.withColumn("own", own).withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    kept = kept.withColumn("side", F.when(F.col("own") == F.col("met"), 2).when(F.col("own") < F.col("met"), 0).otherwise(1))
    kept = kept.withColumn("cell", F.xxhash64("run", F.least("own", "met"), F.greatest("own", "met")))
    dealt = kept.select("cell", "node", "comp", "size", "place", "side", "sig").repartition("cell").sortWithinPartitions("cell")
    out = materialise(dealt.mapInArrow(_cells, "hub long, other long").distinct(), "across")
    free(entries)
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, th (the text's hash), n (shingles), comp (null without shingles) of every document."""
    seed, bits = 0, sketch_bits(docs)
    while True:
        table = measured(docs, bits, seed)
        rows = table.where("seg is null")
        # The sketch's rows, which have no node, are one group of no entries.
        nodes = table.where("n > 0 or seg is not null").groupBy("node").agg(F.min("f2").alias("f2"), F.max("f2").alias("f3"), F.max("n").alias("n"), F.max("part").alias("part"))
        sums = nodes.agg(F.sum("n").alias("entries"), F.sum((F.col("f2") != F.col("f3")).cast("int")).alias("clashes"), F.max("part").alias("part")).first()
        if not sums["clashes"]:
            break
        free(table)
        seed += 1  # two different sets with one 64-bit name: name them anew
    if not sums["entries"]:
        return rows.select("doc_id", "th", "n", F.lit(None).cast("long").alias("comp"))
    counters = table.where("seg is not null").select("seg", "part", "at", F.col("n_at").alias("n"))
    cand = candidates(docs, merged(counters, 1 + (sums["part"] or 0), bits), bits, max(1, -(-sums["entries"] // 4 // RANGE_ENTRIES)) * 4, seed)

    # Groups stand for their least node; a group's other members pair with it.
    members = materialise(cand.where("node is not null").select(*_MEMBER).dropDuplicates(["node"]), "members")
    groups = materialise(members.groupBy("g").agg(F.min(F.struct("node", "th", "n", "sig")).alias("m")).select("g", "m.*"), "groups")
    of = lambda g, node, sig, n: groups.select(F.col("g").alias(g), F.col("node").alias(node), F.col("sig").alias(sig), F.col("n").alias(n)).hint("merge")
    pairs = cand.where("a is not null").groupBy("a", "b").agg(F.sum("n_shared").alias("w"))
    pairs = pairs.join(of("a", "hub", "x", "n"), "a").join(of("b", "other", "y", "m"), "b").select("hub", "other", "w", "x", "y", "n", "m")
    inner = members.join(of("g", "hub", "x", "k"), "g").where("node <> hub").select("hub", F.col("node").alias("other"), prefix_length_of("n").alias("w"), "x", F.col("sig").alias("y"), F.col("k").alias("n"), F.col("n").alias("m"))
    near = materialise(_near(pairs.unionByName(inner)), "near")

    def bodies_of(some: DataFrame) -> DataFrame:
        named = some.select(F.explode(F.array("hub", "other")).alias("node")).distinct()
        wanted = materialise(members.join(named.hint("merge"), "node", "left_semi").select("node", "th"), "wanted")
        out = texts_of(docs, wanted, bits, seed)
        free(wanted)
        return out

    bodies = bodies_of(near)
    # Each node with its closest partner first: that settles most groups of near copies.
    ends = near.select("hub", "other", "w").unionByName(near.select(F.col("other").alias("hub"), F.col("hub").alias("other"), "w"))
    best = ends.groupBy("other").agg(F.max_by("hub", F.struct("w", -F.col("hub"))).alias("hub"))
    best = best.groupBy(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")).agg(F.min("hub").alias("hub")).select("hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    done = verified(best, bodies)
    comp = components(done.where("linked").select(F.col("hub").alias("a"), F.col("other").alias("b")))
    known = done.select(F.least("hub", "other").alias("hub"), F.greatest("hub", "other").alias("other"))
    rest = near.select(F.least("hub", "other").alias("hub"), F.greatest("hub", "other").alias("other")).distinct().join(known.hint("merge"), ["hub", "other"], "left_anti")
    more = verified(_comps(rest, comp).select("hub", "other"), bodies)
    comp = joined(comp, more.where("linked"))
    free(bodies)
    known = known.unionByName(more.select("hub", "other"))
    across = _run_pairs(cand, members, comp)
    last = materialise(across.join(known.hint("merge"), ["hub", "other"], "left_anti"), "last")
    used = [cand, members, groups, near, done, more, across, last]
    if not last.isEmpty():
        bodies = bodies_of(last)
        links = verified(last, bodies)
        comp = joined(comp, links.where("linked"))
        used += [bodies, links]
    free(*used)
    return rows.join(comp.hint("merge"), "node", "left").select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))


def prefix_length_of(n: str):
    return (F.col(n) - F.ceil(3 * F.col(n) / 4) + 1).cast("long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    found = labelled(docs)
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "comp", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: one with its smallest id. Documents without shingles all stay. Columns as in ``docs``.

    Rows go by id and text: those that share an id, or have none, are as many documents as they have texts. A null id
    stands for its component only where no other row does.
    """
    found = labelled(docs).groupBy("comp", "doc_id", "th").agg(F.count("*").alias("rows"))
    first = found.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "rows")).alias("x"))
    picked = first.select("x.doc_id", "x.th", (F.col("x.rows") > 1).alias("_many"))
    picked = materialise(picked.unionByName(found.where("comp is null").select("doc_id", "th", F.lit(False).alias("_many"))), "kept")
    # The document goes as one column, so none of its own clashes with these.
    keyed = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    kept = keyed.alias("k").join(picked.alias("f"), F.expr("k.id <=> f.doc_id and k.th = f.th")).select("k.d", "k.id", "k.th", "_many")
    if picked.where("_many").isEmpty():
        return kept.select("d.*")
    # Rows that repeat both id and text: one of them stays.
    return kept.where("not _many").select("d.*").unionByName(kept.where("_many").withColumn("text", F.col("d.text")).dropDuplicates(["id", "text"]).select("d.*"))


#: DuckDB's version of ``join`` over ``documents``: every pair that shares a shingle is counted.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select doc_id, list_distinct(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')] else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) end) as sh from w),
e as (select doc_id, unnest(sh) as h from s),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as shared from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join s a on a.doc_id = x join s b on b.doc_id = y where 100 * shared >= 75 * (len(a.sh) + len(b.sh) - shared)),
edge as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as c from s union select edge.x, reach.c from reach join edge on edge.y = reach.doc_id)
select s.doc_id, len(s.sh)::bigint as n_shingles, min(reach.c) as component_id from s join reach on reach.doc_id = s.doc_id group by s.doc_id, len(s.sh)
"""
