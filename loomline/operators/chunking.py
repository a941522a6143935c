"""Chunking strategies: DataFrame(doc_id, text) to one row a chunk, without a shuffle.

Each strategy finds its bounds among a document's sentences, lines or paragraphs inside its row and explodes the chunks
at the end. A fold's input array is worked out once; what its lambdas refer to must be cheap, as lambdas share no results.
``chunk_index`` is dense within a document.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_BOUNDS = "array<struct<s:int,n:int>>"
_CHUNK = "array<struct<content:string,refs:array<string>,is_table:boolean,section:string,section_index:int>>"


@dataclass(frozen=True)
class Config:
    """Sizes in estimated tokens. ``min_size`` serves statistics only; overlap is measured if ``overlap`` > 0."""

    target: int = 350
    max_size: int = 450
    min_size: int = 100
    overlap: int = 50
    split_tables: bool = False
    keep_refs: bool = True


def pack_sentences(text: Column, target: int) -> Column:
    """Greedily packed sentences: a chunk closes when the next one would pass ``target``; a longer one stands alone.

    The fold keeps the places where chunks begin; their sentences are joined once."""
    start = F.struct(F.lit(0).alias("tok"), F.array().cast("array<int>").alias("out"))

    def step(a, v):
        new = (F.size(a["out"]) == 0) | (a["tok"] + v["tok"] > target)
        return F.when(new, F.struct(v["tok"].alias("tok"), F.array_append(a["out"], v["i"]).alias("out"))).otherwise(F.struct((a["tok"] + v["tok"]).alias("tok"), a["out"].alias("out")))

    def joined(s):
        first = F.aggregate(F.transform(s, lambda v, i: F.struct(i.alias("i"), T.tokens(v).alias("tok"))), start, step, lambda a: a["out"])
        return T.let(first, lambda at: F.transform(at, lambda i, k: F.array_join(F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i), " ")))

    return T.let(T.sentences(text), joined)


def _chunk(content, refs, is_table=None, section=None, index=None) -> Column:
    none = F.lit(None)
    return F.struct(content.alias("content"), refs.alias("refs"), (F.lit(False) if is_table is None else is_table).alias("is_table"), (none.cast("string") if section is None else section).alias("section"), (none.cast("int") if index is None else index).alias("section_index"))


def semantic_chunks(text: Column, cfg: Config) -> Column:
    """Paragraphs grouped up to the target; those with references, and those over the maximum, stand alone."""
    def item(p):
        alone = F.when(T.tokens(p) > cfg.max_size, "b")
        return F.struct(p.alias("p"), T.tokens(p).alias("tok"), (alone.when(p.rlike(T.REF), "r") if cfg.keep_refs else alone).alias("alone"))

    state = F.struct(F.lit("").alias("cur"), F.lit(0).alias("tok"), F.array().cast("array<struct<k:string,text:string>>").alias("out"))
    group = lambda k, t: F.struct(k.alias("k"), t.alias("text"))
    done = lambda a: F.when(a["cur"] != "", F.array_append(a["out"], group(F.lit("n"), a["cur"]))).otherwise(a["out"])

    def step(a, v):
        lone = F.struct(F.lit("").alias("cur"), F.lit(0).alias("tok"), F.array_append(done(a), group(v["alone"], v["p"])).alias("out"))
        new = F.struct(v["p"].alias("cur"), v["tok"].alias("tok"), done(a).alias("out"))
        more = F.struct(F.when(a["cur"] == "", v["p"]).otherwise(F.concat(a["cur"], F.lit("\n\n"), v["p"])).alias("cur"), (a["tok"] + v["tok"]).alias("tok"), a["out"].alias("out"))
        return F.when(v["alone"].isNotNull(), lone).when((a["cur"] != "") & (a["tok"] + v["tok"] > cfg.target), new).otherwise(more)

    def chunks(g):
        refs = F.when(g["k"] == "r", T.refs_of(g["text"])).otherwise(F.array().cast("array<string>"))
        split = F.transform(pack_sentences(g["text"], cfg.target), lambda c: _chunk(c, T.refs_of(c)))
        return F.when(g["k"] == "b", split).otherwise(F.array(_chunk(g["text"], refs)))

    return F.flatten(F.transform(F.aggregate(F.transform(T.paragraphs(text), item), state, step, done), chunks))


def window_bounds(toks: Column, cfg: Config) -> Column:
    """(first sentence from 1, sentences) of windows that grow below the target, never pass the maximum, and start two
    sentences before the last one's end. A sentence over the maximum starts no window."""
    def taken(i):
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tok"), F.lit(True).alias("open"))
        near = F.slice(toks, i, 64)
        rest = F.when(F.aggregate(near, F.lit(0), lambda a, v: a + v) > cfg.max_size, near).otherwise(F.slice(toks, i, F.size(toks)))

        def grow(a, v):
            fits = a["open"] & (a["tok"] < cfg.target) & (a["tok"] + v <= cfg.max_size)
            return F.when(fits, F.struct((a["n"] + 1).alias("n"), (a["tok"] + v).alias("tok"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["tok"].alias("tok"), F.lit(False).alias("open")))

        return F.aggregate(rest, start, grow, lambda a: a["n"])

    state = F.struct(F.lit(1).alias("next"), F.array().cast(_BOUNDS).alias("out"))

    def step(a, i):
        held = F.transform(F.array(taken(i)), lambda n: F.struct((i + F.greatest(F.lit(1), n - 2)).alias("next"), F.when(n > 0, F.array_append(a["out"], F.struct(i.alias("s"), n.alias("n")))).otherwise(a["out"]).alias("out")))
        return F.when(a["next"] == i, held[0]).otherwise(a)

    places = F.when(F.size(toks) > 0, F.sequence(F.lit(1), F.size(toks))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, state, step, lambda a: a["out"])


def section_bounds(text: Column) -> Column:
    """Array of (title, section text): title lines open a section and are not in its text; empty sections are skipped."""
    def cut(ls):
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: T.is_section_title(F.get(ls, i)))
        return T.let(F.concat(F.array(F.lit(-1)), heads), lambda at: F.filter(F.transform(at, lambda i, k: section(ls, i, F.coalesce(F.get(at, k + 1), F.size(ls)))), lambda x: x["text"].isNotNull()))

    def section(ls, i, end):
        title = F.when(i < 0, "Introduzione").otherwise(T.strip(F.get(ls, F.greatest(i, F.lit(0)))))
        return F.struct(title.alias("title"), F.when(end > i + 1, F.array_join(F.slice(ls, i + 2, end - i - 1), "\n")).alias("text"))

    return T.let(T.lines(text), cut)


def hierarchical_chunks(text: Column, cfg: Config) -> Column:
    """Sections up to the target whole, others by ``semantic_chunks``; ``section_index`` counts within a split section."""
    def chunks(g):
        small = F.array(_chunk(g["text"], T.refs_of(g["text"]), section=g["title"]))
        large = F.transform(semantic_chunks(g["text"], cfg), lambda c, i: _chunk(c["content"], c["refs"], section=g["title"], index=i))
        return F.when(T.tokens(g["text"]) <= cfg.target, small).otherwise(large)

    return F.flatten(F.transform(section_bounds(text), chunks))


def segments(text: Column, context: int = 200) -> Column:
    """Array of (text, kind, ref_id, ref): each reference with its context, and the text between contexts, stripped.

    Contexts may repeat text of their neighbours, as each reaches ``context`` characters to both sides.
    """
    refs = T.refs_in_place(text)
    kind = "array<struct<text:string,kind:string,ref_id:string,ref:string>>"
    seg = lambda t, k, i, r: F.struct(t.alias("text"), k.alias("kind"), i.alias("ref_id"), r.alias("ref"))
    none = F.lit(None).cast("string")
    between = lambda a, b: T.strip(F.substring(text, a + 1, F.greatest(b - a, F.lit(0))))
    with_text = lambda out, t: F.when(t != "", F.array_append(out, seg(t, F.lit("text"), none, none))).otherwise(out)
    state = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("out"))

    def step(a, r):
        low = F.greatest(F.lit(0), r["position"] - context)
        high = F.least(F.length(text), r["position"] + F.length(r["full_ref"]) + context)
        own = seg(F.substring(text, low + 1, high - low), F.when(r["kind"] == "TABELLA", "table").otherwise("multimodal"), r["id"], r["full_ref"])
        return F.struct(high.alias("last"), F.array_append(with_text(a["out"], between(a["last"], r["position"])), own).alias("out"))

    return F.aggregate(refs, state, step, lambda a: with_text(a["out"], between(a["last"], F.length(text))))


def multimodal_chunks(text: Column, cfg: Config) -> Column:
    """Segments as chunks: tables whole, small ones whole, others by packed sentences; references go to every part."""
    def chunks(g):
        refs = F.when(g["ref"].isNull(), F.array().cast("array<string>")).when((g["kind"] == "table") & F.lit(not cfg.split_tables), F.array(g["ref_id"])).otherwise(F.array(g["ref"]))
        whole = F.array(_chunk(g["text"], refs, is_table=(g["kind"] == "table") & F.lit(not cfg.split_tables)))
        parts = F.transform(pack_sentences(g["text"], cfg.target), lambda c: _chunk(c, F.when(g["ref"].isNull(), T.refs_of(c)).otherwise(refs)))
        return F.when(((g["kind"] == "table") & F.lit(not cfg.split_tables)) | (T.tokens(g["text"]) <= cfg.target), whole).otherwise(parts)

    return F.flatten(F.transform(segments(text), chunks))


STRATEGIES = {"semantic": semantic_chunks, "hierarchical": hierarchical_chunks, "multimodal_aware": multimodal_chunks}


def _windows(docs: DataFrame, text: Column, cfg: Config) -> DataFrame:
    """``_chunks`` of the sliding strategy, in steps so that sentences are split once."""
    made = docs.withColumn("_s", T.sentences(text)).withColumn("_t", F.transform("_s", T.tokens)).withColumn("_g", window_bounds(F.col("_t"), cfg))
    part = lambda g: F.slice("_s", g["s"], g["n"])
    return made.withColumn("_chunks", F.transform("_g", lambda g: _chunk(F.array_join(part(g), " "), F.flatten(F.transform(part(g), T.refs_of))))).drop("_s", "_t", "_g")


def chunk(docs: DataFrame, strategy: str = "semantic", cfg: Config | None = None, text: str = "text") -> DataFrame:
    """One row a chunk, with the document's other columns. An unknown strategy is semantic; a null text is empty."""
    cfg = cfg or Config()
    body = F.coalesce(F.col(text), F.lit(""))
    sliding = strategy == "sliding_window"
    name = strategy if sliding or strategy in STRATEGIES else "semantic"
    made = (_windows(docs, body, cfg) if sliding else docs.withColumn("_chunks", STRATEGIES[name](body, cfg))).drop(text)
    overlap = F.lit(0)
    if sliding and cfg.overlap > 0:
        made = made.withColumn("_over", F.transform("_chunks", lambda c, i: F.when(i > 0, T.shared_words(F.get("_chunks", i - 1)["content"], c["content"])).otherwise(0)))
        overlap = F.expr("_over[chunk_index]")
    # The outer form: for the inner one Spark filters by the array's size, working the whole fold out twice.
    rows = made.select("*", F.posexplode_outer("_chunks").alias("chunk_index", "_c")).where(F.col("chunk_index").isNotNull())
    keep = [f"`{c}`" for c in made.columns if c not in ("_chunks", "_over")]
    return rows.select(*keep, "chunk_index", F.col("_c.content").alias("content"), F.length("_c.content").alias("char_count"), T.tokens(F.col("_c.content")).alias("token_count"), overlap.alias("overlap_with_previous"), F.lit(0).alias("overlap_with_next"), (F.size("_c.refs") > 0).alias("has_multimodal"), F.col("_c.refs").alias("multimodal_refs"), F.col("_c.is_table").alias("is_table_chunk"), F.col("_c.section").alias("section"), F.col("_c.section_index").alias("section_chunk_index"), F.lit(name).alias("chunking_strategy"))
