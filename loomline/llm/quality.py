"""Quality rules with cross-document line frequency.

Each line (lower-cased, white space collapsed) is hashed; for each host (``source``) the distinct documents that
hold it are counted, exact copies of a text being one document: else a text with many copies would lose all its lines,
and the copies are for the join to settle. Lines in more than ``max(MIN_LINE_DOCS, LINE_SHARE *
distinct texts of the host)`` of them are removed, and a document that loses more than ``MAX_LOST`` of its words is
rejected as depleted. The base rules reject texts of under 50 words and texts of mostly repeated 3-word windows.

Defined cases: a null text counts as empty; it has no words and fails the base rules. A null source is a host of
its own. Null and repeated ids are rows like others, each judged by its own text and host. A text of any length is
measured whole in its task. Extra columns are ignored, and kept by ``keep_good``, whatever their names. An empty table
gives no rows. Nothing is sampled: counts cover every line of every document.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise, starts, text_slices, utf8, words_of

MIN_LINE_DOCS, LINE_SHARE, MAX_LOST = 20, 0.02, 0.5
#: Bytes of text measured at once: over 2 MB of prose the arrays of words and windows took 87 MB, over 512 KB 36.
SLICE = 1 << 19
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
NO_HOST = "\x00none"
_SCAN = "rid long, doc_id long, host string, th long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hs array<long>, ws array<int>"


def _per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    off = starts(counts)
    return total[off[1:]] - total[off[:-1]]


def repeat_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text inside 3-word windows that the text holds twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        row = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(row[:-2] == row[2:])
        base = int(codes.max()) + 1
        _, pair = np.unique(codes[at] * base + codes[at + 1], return_inverse=True)
        order = np.lexsort((codes[at + 2], pair, row[at]))
        k = np.stack([row[at][order], pair[order], codes[at + 2][order]])
        same = (k[:, 1:] == k[:, :-1]).all(axis=0)
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for j in range(3):
            covered[hit + j] = True
    return _per_row(covered, counts)


def lines_of(text: pa.Array):
    """Lines of each text split at \\n: (codes, counts per row, distinct lines)."""
    lists = pc.split_pattern(pc.fill_null(text, ""), "\n")
    off = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), np.diff(off), coded.dictionary


def _line_hash(line: str) -> int:
    h = xxhash.xxh3_64_intdigest(" ".join(line.lower().split()))
    return h - (1 << 64) if h >> 63 else h


def measure(text: pa.Array) -> dict:
    """The base counts of each text, and hashes of its normalised lines (null where a line has no word) with their words."""
    codes, counts, vocabulary = words_of(text)
    out = {"n_words": counts.astype(np.int64)}
    out["word_chars"] = _per_row(pc.utf8_length(vocabulary).to_numpy().astype(np.int64)[codes], counts)
    data, off = utf8(text)
    out["n_symbols"] = _per_row(SYMBOLS[data], np.diff(off))
    out["n_repeat_words"] = repeat_words(codes, counts)
    lc, ln, lines = lines_of(text)
    row = np.repeat(np.arange(len(ln)), ln)
    per_line = words_of(lines)[1]
    words = per_line[lc]
    full = words > 0
    _, first = np.unique(row[full] * np.int64(len(lines) + 1) + lc[full], return_index=True)
    out["n_dup_lines"] = np.bincount(row[full], minlength=len(ln)) - np.bincount(row[full][first], minlength=len(ln))
    hashed = np.array([_line_hash(x) for x in lines.to_pylist()], np.int64)
    off = pa.array(starts(ln).astype(np.int32))
    out["hs"] = pa.ListArray.from_arrays(off, pa.array(hashed[lc], mask=~full))
    out["ws"] = pa.ListArray.from_arrays(off, pa.array(words.astype(np.int32)))
    return out


def _measured(it):
    names = [x.split()[0] for x in _SCAN.split(", ")]
    for batch in it:
        for part in text_slices(batch, limit=SLICE):
            m = measure(part.column("text"))
            yield pa.RecordBatch.from_arrays([m[k] if k in ("hs", "ws") else pa.array(m[k]) if k in m else part.column(k) for k in names], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document with its base counts and line hashes; the text itself is not carried on."""
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("source", F.lit(NO_HOST)).alias("host"), F.xxhash64("text").alias("th"), "text")
    return batches(keyed, "rid", "doc_id", "host", "th", "text").mapInArrow(_measured, _SCAN)


def frequent_lines(scanned: DataFrame, least: int = MIN_LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """host, h of the lines above their host's limit. Copies of a text meet in the partial aggregate."""
    hosts = scanned.groupBy("host", "th").agg(F.lit(1).alias("x")).groupBy("host").agg(F.greatest(F.lit(float(least)), F.count("*") * share).alias("most"))
    held = scanned.select("host", "th", F.explode(F.array_distinct(F.array_compact("hs"))).alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > least)
    return held.join(hosts, "host").where(F.col("n_docs") > F.col("most")).select("host", "h", "n_docs")


def judge(docs: DataFrame, least: int = MIN_LINE_DOCS, share: float = LINE_SHARE, lost: float = MAX_LOST):
    """(judged rows, frequent lines): one row a document with its counts, lost words and verdicts."""
    scanned = materialise(scan(docs), "quality")
    bad = materialise(frequent_lines(scanned, least, share), "lines")
    lines = scanned.select("rid", "host", F.posexplode(F.arrays_zip("hs", "ws")).alias("at", "x")).select("rid", "host", "at", F.col("x.hs").alias("h"), F.col("x.ws").alias("w"))
    gone = lines.join(bad, ["host", "h"]).groupBy("rid").agg(F.sum("w").alias("lost_words"), F.collect_list("at").alias("lost_lines"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scanned.drop("hs", "ws").join(gone, "rid", "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0)).cast("long"))
    judged = judged.withColumn("base_failed", failed).withColumn("depleted", F.col("lost_words") > lost * F.col("n_words"))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")), bad


def quality(docs: DataFrame, least: int = MIN_LINE_DOCS, share: float = LINE_SHARE, lost: float = MAX_LOST) -> DataFrame:
    return judge(docs, least, share, lost)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


def keep_good(docs: DataFrame, least: int = MIN_LINE_DOCS, share: float = LINE_SHARE, lost: float = MAX_LOST) -> DataFrame:
    """The kept documents without their host's frequent lines; n_chars, where there is one, follows. Columns as in ``docs``.

    The texts move once, to meet their verdicts; a verdict brings the numbers of the lines that go, and no text leaves
    the JVM again.
    """
    judged, _ = judge(docs, least, share, lost)
    verdict = judged.groupBy(F.coalesce("doc_id", F.lit(0)).alias("id"), "host", "th").agg(F.bool_and("kept").alias("kept"), F.first("lost_lines", ignorenulls=True).alias("lost"))
    # The document goes as one column, so none of its own clashes with these.
    keyed = docs.select(F.struct("*").alias("d"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.coalesce("source", F.lit(NO_HOST)).alias("host"), F.xxhash64("text").alias("th"))
    good = keyed.join(verdict.where("kept"), ["id", "host", "th"])
    lines = F.split("d.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lost")
    text = F.when(F.col("lost").isNull(), F.col("d.text")).otherwise(F.array_join(F.transform(F.array(lines), lambda v: F.transform(left, lambda i: F.get(v, i)))[0], "\n"))
    good = good.select("d", "lost", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("lost").isNull(), F.col("d.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    cols = [(new[c].cast(docs.schema[c].dataType) if new.get(c) is not None else F.col(f"d.`{c}`")).alias(c) for c in docs.columns]
    return good.select(*cols)


def oracle(least: int = MIN_LINE_DOCS, share: float = LINE_SHARE, lost: float = MAX_LOST) -> str:
    """DuckDB's version of ``quality`` over ``documents``."""
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as l from d),
tri as (select rid, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] as k from (select rid, l, unnest(range(1, len(l) - 1)) as i from w where len(l) >= 3)),
hit as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as n from tri) where n > 1),
rep as (select rid, count(distinct i + j) as n from hit, (select unnest([0, 1, 2]) as j) group by rid),
ln as (select rid, host, t, unnest(string_split(t, chr(10))) as x from d),
full_ln as (select rid, host, t, x, array_to_string(list_filter(regexp_split_to_array(lower(x), '\s+'), lambda v: v <> ''), ' ') as k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from ln where regexp_matches(x, '[^\x20\x09-\x0D]')),
dup as (select rid, count(*) - count(distinct x) as n from full_ln group by rid),
lim as (select host, greatest({least}, {share} * count(distinct t)) as most from d group by host),
bad as (select f.host, k from full_ln f join lim on lim.host = f.host group by f.host, k having count(distinct f.t) > max(most)),
lost as (select rid, sum(n)::bigint as n from full_ln f join bad on bad.host = f.host and bad.k = f.k group by rid)
select doc_id, len(l)::bigint as n_words, coalesce(list_sum(list_transform(l, lambda v: length(v))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
       coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(l) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(l) as base_failed,
       not (len(l) < 50 or 100 * coalesce(rep.n, 0) > 50 * len(l)) and not coalesce(lost.n, 0) > {lost} * len(l) as kept, coalesce(lost.n, 0)::bigint as lost_words
from w left join dup using (rid) left join rep using (rid) left join lost using (rid)
"""
