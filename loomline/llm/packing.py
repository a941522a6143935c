"""Best-fit packing by bin completion with branch and bound, over the histogram of piece lengths.

Documents become token ids plus an end id; those over the capacity are cut into capacity-sized pieces. As a piece
counts by its length alone, packing works on a histogram of at most ``CAPACITY`` lengths, which the driver may hold
at any input size. The incumbent is the whole best-fit solution. Where it needs more sequences than a lower bound, the
search fills sequences around the largest length left: undominated fillings are enumerated, the least wasteful first,
each taken for as many sequences as the counts allow and then for fewer, and a branch ends when its waste rules out
fewer sequences than the incumbent's. What is left is packed by best fit at some levels, for further incumbents. The
search has a budget of visits; the plan tells whether its result is proved least. Pieces then take the places of their
length by rank.

Defined cases: null and empty texts are the end id alone; null and repeated ids are rows like others; an empty
table packs into nothing. A text of any length is tokenised whole in its task. Extra columns are ignored.
"""
from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, crc, materialise, starts, text_slices, utf8, words_of

CAPACITY, END_ID = 4096, 1
#: Visits of the whole search, and of one tier of waste at one level; where they run out, the best solution so far
#: stands and ``Plan.proved`` is false.
NODES, TIER_NODES = 1 << 20, 300
#: Bytes of text that a task works on at once.
SLICE = 2 << 20
#: Distinct words whose ids a task remembers.
CACHE_WORDS = 300_000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: ASCII signs, but for the one that stands by a letter in special tokens.
_POINT = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~", np.uint8))
#: Second bytes of the letters that begin with 0xC3: all but the signs of multiplication and division.
_LATIN = np.isin(np.arange(256), np.setdiff1d(np.arange(0x80, 0xC0), [0x97, 0xB7]))
#: Lead bytes of the combining marks that may join an ASCII letter.
_MARKS = np.isin(np.arange(256), np.array([0xCC, 0xCD], np.uint8))


def loosened(text: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer distinct words: a space between a Latin letter and an ASCII sign, where the
    vocabulary splits anyway, and A-Z in lower case unless a combining mark, which composes before case, is near."""
    data, off = utf8(text)
    if len(data) > 1:
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        at = np.flatnonzero(letter[:-1] & _POINT[data[1:]]) + 1
        at = at[~np.isin(at, off)] if len(at) else at
        if not _MARKS[data].any():
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        off = off + np.searchsorted(at, off, side="right")
        data = np.insert(data, at, 32)
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


class WordTokenizer:
    """Ids of texts, word by word: the vocabulary's normaliser drops white space, so words are independent."""

    BETWEEN = "<|endoftext|>"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        # The same without special tokens, whose search takes most of the time on words of letters alone. Such a word is
        # one piece, and a piece's last token is one that ends a word.
        told = json.loads(spec)
        self.plain = Tokenizer.from_str(json.dumps(told | {"added_tokens": []}))
        vocabulary = told["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(told["model"].get("end_of_word_suffix") or "\0")]] = True
        self.between = self.tok.token_to_id(self.BETWEEN)
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.again = np.zeros(0, bool)
        self.flat, self.first, self.used = np.zeros(1 << 20, np.uint32), [np.zeros(1, np.int64)], 0

    def forget(self):
        """Drop the words that were not met again since the last time; all of them, if too many were."""
        first, held = np.concatenate(self.first), np.flatnonzero(self.again)
        words = list(self.known)
        ids = [self.flat[a:b] for a, b in zip(first[held].tolist(), first[held + 1].tolist())]
        self.clear()
        if len(held) <= CACHE_WORDS // 2:
            self.again = np.zeros(len(held), bool)
            self._store(np.concatenate(ids) if ids else self.flat[:0], np.array([len(x) for x in ids], np.int64), [words[i] for i in held.tolist()])

    def _learn(self, words):
        """Many words at once: those of letters with a space between them, others with a special token; those that hold
        "<|" go one by one."""
        letters = [w for w in words if w.isalpha() and (w.isascii() or w.lower().isalpha())]
        others = set(letters)
        others = [w for w in words if w not in others and "<|" not in w]
        for a in range(0, len(letters), 2000):
            some = letters[a : a + 2000]
            ids = np.asarray(self.plain.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(some):
                self._store(ids, np.diff(last, prepend=-1), some)
            else:  # another kind of vocabulary
                others += some
        for a in range(0, len(others), 2000):
            ids = np.asarray(self.tok.encode(self.BETWEEN.join(others[a : a + 2000]), add_special_tokens=False).ids, np.uint32)
            cut = ids == self.between
            self._store(ids[~cut], np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(ids)]])) - 1, others[a : a + 2000])
        for w in words:
            if "<|" in w:
                ids = np.asarray(self.tok.encode(w, add_special_tokens=False).ids, np.uint32)
                self._store(ids, np.array([len(ids)]), [w])

    def _store(self, ids, sizes, words):
        while self.used + len(ids) >= len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        n = len(self.known)
        self.known.update(zip(words, range(n, n + len(words))))
        self.first.append(self.used + np.cumsum(sizes))
        self.used += len(ids)

    def encode(self, text: pa.Array, end: int = END_ID):
        """(ids of all rows one after another, ids per row), each row closed by ``end``."""
        codes, counts, vocabulary = words_of(loosened(text))
        words = vocabulary.to_pylist()
        if len(self.known) + len(words) > CACHE_WORDS:
            self.forget()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0).tolist()
        self.again[at[at >= 0]] = True
        self._learn([words[i] for i in new])
        at[new] = np.fromiter((self.known[words[i]] for i in new), np.int64, len(new))
        self.again = np.concatenate([self.again, np.zeros(len(self.known) - len(self.again), bool)])
        self.first = [np.concatenate(self.first)]
        first = self.first[0]
        start, size = first[at], first[at + 1] - first[at]
        # The end id of each row stands as one more "word".
        row_end = starts(counts)[1:]
        start = np.insert(start[codes], row_end, self.used)
        size = np.insert(size[codes], row_end, 1)
        self.flat[self.used] = end
        off = starts(size)
        ids = self.flat[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
        return ids, np.diff(off[np.concatenate([[0], row_end + np.arange(1, len(row_end) + 1)])])


def worker_tokenizer(spec: str) -> WordTokenizer:
    """The tokenizer of this Python worker: tasks that share a worker share the words it has seen."""
    import os

    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = getattr(tokenizers, "_loomline_worker", None)
    if kept is None or kept[0] != hash(spec):
        kept = tokenizers._loomline_worker = (hash(spec), WordTokenizer(spec))
    return kept[1]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and its rank among its task's pieces of that length."""
    with open(path or tokenizer_file(), encoding="utf8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a public vocabulary: a few MB whatever the input

    def run(it):
        tok, seen, task = worker_tokenizer(spec.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in it:
            for part in text_slices(batch, limit=SLICE):
                ids, n = tok.encode(part.column("text"))
                off = starts(n)
                per = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(row)) - np.repeat(starts(per)[:-1], per)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                raw = ids.astype("<u4")
                crcs = np.array([crc(raw[a : a + k].data) for a, k in zip((off[row] + start).tolist(), length.tolist())], np.int64)
                order = np.argsort(length, kind="stable")
                hist = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(starts(hist)[:-1], hist)
                rank += seen[length]
                seen += hist
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return batches(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The best-fit solution, longest pieces first: (how many of each length a sequence holds, sequences)."""
    spaces: dict[int, list] = {}  # space left: sequences alike
    for k in sorted(histogram, reverse=True):
        n = histogram[k]
        # The tightest space that fits takes pieces until it no longer fits one, as it stays the tightest.
        for space in sorted(s for s in spaces if s >= k):
            each, alike = space // k, spaces.pop(space)
            while alike and n:
                filling, m = alike.pop()
                full = min(m, n // each)
                last = 1 if full < m and n % each and n // each == full else 0
                for times, held in ((full, each), (last, n % each)):
                    if times:
                        spaces.setdefault(space - held * k, []).append((filling | {k: held}, times))
                if m - full - last:
                    alike.append((filling, m - full - last))
                n -= full * each + last * (n % each)
            if alike:
                spaces.setdefault(space, []).extend(alike)
            if not n:
                break
        each = capacity // k
        for times, held in ((n // each, each), (int(n % each > 0), n % each)):
            if times:
                spaces.setdefault(capacity - held * k, []).append(({k: held}, times))
    return [x for alike in spaces.values() for x in alike]


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """A number of sequences that no packing goes below: by all tokens, and by the pieces over each size alone."""
    n = np.zeros(capacity + 2, np.int64)
    for k, v in histogram.items():
        n[k] = v
    count, tokens = np.cumsum(n), np.cumsum(n * np.arange(len(n)))
    least = -(-int(tokens[-1]) // capacity)
    half = capacity // 2
    for small in range(0, half + 1):
        # Pieces over ``capacity - small`` stand alone; others over half fill up with pieces from ``small`` to half.
        alone = count[capacity] - count[capacity - small]
        large = count[capacity - small] - count[half]
        space = large * capacity - (tokens[capacity - small] - tokens[half])
        rest = tokens[half] - (tokens[small - 1] if small else 0)
        least = max(least, int(alone + large + max(0, -(-(rest - space) // capacity))))
    return least


def _dominated(filling: list[tuple[int, int]], space: int, left: dict[int, int], mask: int) -> bool:
    """Whether a piece at hand could be added, or one of a length not in the filling could stand for some of its pieces
    (all subsets of up to eight pieces, else one or two) and still fit: those then fit where it would have gone."""
    spare = mask
    for k, n in filling:
        if left[k] == n:
            spare &= ~(1 << k)
    if spare & ((2 << space) - 1):
        return True
    others = mask & ~sum(1 << k for k, _ in filling)
    held = [k for k, n in filling for _ in range(n)]
    if len(held) <= 8:
        sums = {0}
        for k in held:
            sums |= {s + k for s in sums}
    else:
        kinds = [k for k, _ in filling]
        sums = {*kinds, *(a + b for i, a in enumerate(kinds) for b in kinds[i + 1 :]), *(2 * k for k, n in filling if n > 1)}
    return any((others >> s) & ((2 << space) - 1) for s in sums if s)


def fillings(space: int, left: dict[int, int], mask: int, most, spend):
    """Undominated fillings [(length, how many)] of a space that waste at most ``most()``, the least wasteful first, by
    tiers of waste. ``mask`` has a bit for each length left; ``spend(n)`` tells whether an n-th visit may be made."""

    def visit(space, limit, chosen, low, high):
        nonlocal visits
        visits += 1
        if low <= space <= high and not _dominated(chosen, space, left, mask):
            yield chosen
        top = min(space, limit)
        while top > 0 and (space > low or not low) and space and spend(visits):
            at = (mask & ((2 << top) - 1)).bit_length() - 1
            if at < 1:
                return
            # The most of one length first, then fewer: what follows is smaller, so no filling comes twice.
            for k in range(min(left[at], space // at), 0, -1):
                yield from visit(space - k * at, at - 1, [*chosen, (at, k)], low, high)
            top = at - 1

    low, high = 0, 0
    while low <= min(space, most()):
        visits = 0
        yield from visit(space, space, [], low, high)
        low, high = high + 1, 4 * high + 3


@dataclass
class Plan:
    """rows: (length, first rank, ranks, pieces a sequence, first sequence, offset); sequences used; the number that no
    packing goes below; whether the search shows that no packing needs fewer (else ``nodes`` ran out)."""

    rows: np.ndarray
    sequences: int
    bound: int
    proved: bool


def complete(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES):
    """(solution, bound, proved): bin completion. Each level fills sequences around the largest piece left; a branch is
    an undominated filling and how many sequences take it."""
    left = {k: v for k, v in histogram.items() if v > 0}
    best, bound = best_fit(left, capacity), least_sequences(left, capacity)
    size = lambda solution: sum(m for _, m in solution)
    most, total, waste, spent, cut, over, seen = size(best), sum(k * v for k, v in left.items()), 0, 0, False, False, set()
    mask, name = sum(1 << k for k in left), 0  # name: of what is left, by the hashes of its lengths and counts

    def room():
        """Tokens that a better solution may still waste from here on."""
        return (most - 1) * capacity - total - waste

    def spend(visits):
        nonlocal spent, cut
        spent += 1
        cut |= visits > TIER_NODES or spent > nodes
        return visits <= TIER_NODES and spent <= nodes

    def options():
        """(filling with the largest piece, how often, waste) of every branch of a node."""
        largest = mask.bit_length() - 1
        left[largest] -= 1
        inner = mask if left[largest] else mask & ~(1 << largest)
        found = fillings(capacity - largest, left, inner, room, spend)
        while True:
            f = next(found, None)
            left[largest] += 1
            if f is None:
                return
            filling = dict(f)
            filling[largest] = filling.get(largest, 0) + 1
            lost = capacity - sum(k * n for k, n in filling.items())
            times = min(left[k] // n for k, n in filling.items())
            while times and room() >= 0:
                times = min(times, room() // lost) if lost else times
                if times < 1:
                    break
                yield filling, times, lost * times
                times -= 1
            left[largest] -= 1

    def move(filling, times):
        nonlocal mask, name
        for k, n in filling.items():
            name ^= hash((k, left.get(k, 0)))
            left[k] = left.get(k, 0) - n * times
            name ^= hash((k, left[k]))
            if left[k]:
                mask |= 1 << k
            else:
                del left[k]
                mask &= ~(1 << k)

    # Depth first, without recursion: the choices so far, and the open branches of each level.
    chosen: list = []
    levels = [options()] if most > bound else []
    while levels and most > bound and not over:
        step = next(levels[-1], None)
        if step is None:
            levels.pop()
            if chosen:
                filling, times, lost = chosen.pop()
                move(filling, -times)
                waste -= lost
            continue
        filling, times, lost = step
        move(filling, times)
        waste += lost
        chosen.append(step)
        spent += 8  # a branch costs as much as some visits
        state = hash((name, waste))
        if left and room() >= 0 and state not in seen:
            seen.add(state)
            over = spent > nodes
            if over or len(levels) & (len(levels) - 1) == 0:  # whole best-fit solutions of what is left are incumbents too
                spent += len(left)
                whole = [*((f, t) for f, t, _ in chosen), *best_fit(left, capacity)]
                best, most = min((best, most), (whole, size(whole)), key=lambda x: x[1])
            levels.append(options())
            continue
        if not left and size(s := [(f, t) for f, t, _ in chosen]) < most:
            best, most = s, size(s)
        chosen.pop()
        move(filling, -times)
        waste -= lost
    return best, bound, most == bound or not cut and not over


def plan(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The packing of a histogram of lengths as a table by length and first rank.

    Its rows are as many as the solution's patterns hold different lengths, whatever the counts: a bounded table.
    """
    solution, bound, proved = complete(histogram, capacity, nodes)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in solution:
        offset = 0
        for k, n in sorted(filling.items(), reverse=True):
            rows.append((k, used.get(k, 0), times * n, n, sequence, offset))
            offset += k * n
            used[k] = used.get(k, 0) + times * n
        sequence += times
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 6), sequence, bound, proved)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; and, the same in all rows, bound (no
    packing has fewer sequences) and proved (none has fewer than this one)."""
    cut = materialise(pieces(docs, capacity, path), "pieces")
    hist = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    hist = hist.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    hist = materialise(hist, "lengths")
    counts = {r.length: r.n for r in hist.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    found = plan(counts, capacity, nodes)
    if not found.proved:
        logging.getLogger(__name__).warning("packing: %d sequences, at least %d are needed; the search's %d visits ran out", found.sequences, found.bound, nodes)
    table = docs.sparkSession.sparkContext.broadcast(found)

    def run(it):
        p = table.value.rows
        key = (p[:, 0] << 44) + p[:, 1]
        for batch in it:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            inside = rank - p[at, 1]
            out = {"sequence_id": p[at, 4] + inside // p[at, 3], "offset": p[at, 5] + inside % p[at, 3] * length, "bound": np.full(len(at), table.value.bound), "proved": np.full(len(at), table.value.proved)}
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), *map(pa.array, out.values())], names=[*names, *out])

    # A row a task and length: it grows with the input, so it is merged, not broadcast.
    ranked = cut.join(hist.drop("n").hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    return batches(ranked, "doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, bound long, proved boolean")
