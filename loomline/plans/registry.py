"""Queries of the document engine, each beside the SQL that DuckDB runs on the same tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, linking, stats, vectors
from ..operators.order import numbered
from ..sources import files, markup
from . import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_TEXT = "id long, text string"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """``df``, dealt anew only where its scan has fewer splits than there are cores: one small file is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def docs_of(spark, sf_dir, *columns):
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def fixed(spark, rows, schema=_TEXT):
    return spark.createDataFrame(rows, schema)


def _extended(spark, sf_dir, rows):
    """``documents`` and fixture rows (negative ids) as id, text."""
    return docs_of(spark, sf_dir).withColumnRenamed("doc_id", "id").unionByName(fixed(spark, [(-i, t) for i, t in rows]))


def _extended_sql(rows):
    return f"(select doc_id as id, text from documents union all select -id, text from {X.values(rows, 'id, text')})"


def _both(name: str, rows, change, sql: str):
    """A text function over ``documents`` and over fixture rows."""
    QUERIES[name] = lambda spark, sf_dir: _extended(spark, sf_dir, rows).select(F.col("id").alias("doc_id"), change(F.col("text")).alias("out"))
    ORACLES[name] = f"select id as doc_id, {sql} as out from {_extended_sql(rows)}"


def _in_steps(rows, *steps):
    """SQL expressions over ``text`` one after another."""
    made = [f"s0 as (select id, text from {_extended_sql(rows)})"] + [f"s{i} as (select id, {x} as text from s{i - 1})" for i, x in enumerate(steps, 1)]
    return f"with {', '.join(made)} select id as doc_id, text as out from s{len(steps)}"


# Scalars ---------------------------------------------------------------------------------------------------------------
_R = lambda t, p, r: f"regexp_replace({t}, '{p}', '{r}', 'g')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WS = "array_to_string(list_transform(string_split(" + _R(_R("text", "[ \\t]+", " "), r"\n{3,}", "'||chr(10)||chr(10)||'") + ", chr(10)), lambda x: " + _STRIP.format("x") + "), chr(10))"
_both("clean_whitespace", X.CLEAN, T.normalize_whitespace, _WS)
_NUM = _R(_R("text", r"(?m)^\d+\s*$", ""), r"(?m)^[_\-=*]{3,}\s*$", "")
_both("clean_numbers_and_rules", X.CLEAN, T.drop_rules_and_numbers, _NUM)
_MARKS = _R(_R(_R("text", r"(?m)^\d{1,4}\s*$", ""), r"(?m)^Page \d+ of \d+\s*$", ""), r"(?m)^[_\-=*]{3,}\s*$", "")
_both("clean_page_marks", X.CLEAN, T.drop_page_marks, _MARKS)
_HYPHENS = _R("text", r"([a-z])-\n([a-z])", r"\1\2")
_both("join_hyphens", X.CLEAN, T.join_hyphens, _HYPHENS)
_CAPITALS = _R("text", "([.!?,:;])([A-Z])", r"\1 \2")
_both("space_capitals", X.CLEAN, T.space_capitals, _CAPITALS)
_TIDY = _R(_R(_R(_R(_R("text", "([.!?,:;])([A-Za-z])", r"\1 \2"), r"\s+([.!?,:;])", r"\1"), "[“”]", '"'), "[‘’]", "''"), r"\.{3,}", "...")
_both("tidy_punctuation", X.CLEAN, T.tidy_punctuation, _TIDY)
_CONTROL = "array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, chr(9)), lambda x: " + _R("x", r"[\p{C}]", "") + "), chr(9))), chr(10))"
_both("drop_control", X.CLEAN, T.drop_control, _CONTROL)
_CODE = r"(^|[^\p{L}\p{N}_])[A-Z0-9]{10,}($|[^\p{L}\p{N}_])"
_MASK = "array_to_string(list_filter(string_split(" + _R(_R(_R(_R("text", r"https?://\S+", "[URL]"), r"\S+@\S+\.\S+", "[EMAIL]"), _CODE, r"\1[CODE]\2"), _CODE, r"\1[CODE]\2") + ", chr(10)), lambda x: length(x) > 10 or x = ''), chr(10))"
_both("mask_aggressive", X.CLEAN, T.mask, _MASK)
_moji = "text"
for _w, _r in T.MOJIBAKE:
    _moji = f"replace({_moji}, {X.literal(_w)}, {X.literal(_r)})"
_both("fix_mojibake", X.GARBLED, T.fix_mojibake, _moji)
_REP = "list_filter(list_distinct(list_filter(string_split(text, chr(10)), lambda x: length(x) > 10 and length(x) < 100)), lambda y: len(list_filter(string_split(text, chr(10)), lambda z: z = y)) >= 3)"
_DROPREP = f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains({_REP}, x)), chr(10))"
_both("drop_repetitive_lines", X.CLEAN, T.drop_repetitive_lines, _DROPREP)
_both("token_estimate", X.MM, lambda c: T.tokens(c).cast("long"), "(length(text) // 4)::bigint")
_both("file_hash", X.CLEAN, lambda c: F.sha2(c, 256), "sha256(text)")
_both("element_id", X.MM, lambda c: T.element_id(F.lit("text"), c), "'text_' || substr(md5(text), 1, 8)")


_CLEANED = X.CLEAN + [(10, "ﬁne ① Ａ½"), (11, "one line of enough characters here\nsee https://a.example/x?y now and then")]
# NFKC of the rows is NFC but for these characters of the fixture.
_NFKC = "nfc_normalize(replace(replace(replace(replace(text, 'ﬁ', 'fi'), '①', '1'), 'Ａ', 'A'), '½', '1⁄2'))"
_both("nfkc", _CLEANED, T.nfkc, _NFKC)


@query("extractor_clean", _in_steps(_CLEANED, _NFKC, _moji, _CONTROL, _WS, _HYPHENS, _TIDY, _MARKS, _MASK))
def extractor_clean(spark, sf_dir):
    return _extended(spark, sf_dir, _CLEANED).select(F.col("id").alias("doc_id"), T.extractor_clean(F.col("text"), "pdf", True).alias("out"))


@query("processor_clean", _in_steps(_CLEANED, _NFKC, _WS, _NUM, _HYPHENS, _CAPITALS, _DROPREP))
def processor_clean(spark, sf_dir):
    return _extended(spark, sf_dir, _CLEANED).select(F.col("id").alias("doc_id"), T.processor_clean(F.col("text"), "pdf").alias("out"))


# References, sentences, structure ------------------------------------------------------------------------------------------
_MM = _extended_sql(X.MM) + " as t"
_REFRX = r"\[(?:IMMAGINE|TABELLA|GRAFICO|FIGURA)_[^\]]+\]"
_PLACED = f"""r as (select id, text, unnest(regexp_extract_all(text, '{_REFRX}')) as ref, generate_subscripts(regexp_extract_all(text, '{_REFRX}'), 1) as i, regexp_split_to_array(text, '{_REFRX}') as gaps, regexp_extract_all(text, '{_REFRX}') as all_refs from {_MM}),
placed as (select id, text, i, ref, (length(array_to_string(gaps[1:i], '')) + length(array_to_string(all_refs[1:i-1], '')))::bigint as position from r)"""


@query("extract_refs", f"with {_PLACED} select id, ref as full_ref, regexp_extract(ref, '_([^\\]]+)\\]', 1) as ref_id, position from placed")
def extract_refs(spark, sf_dir):
    d = _extended(spark, sf_dir, X.MM).select("id", F.explode(T.refs_in_place(F.col("text"))).alias("r"))
    return d.select("id", F.col("r.full_ref").alias("full_ref"), F.col("r.id").alias("ref_id"), F.col("r.position").cast("long").alias("position"))


@query("protect_restore", f"select id, text as restored, len(regexp_extract_all(text, '{_REFRX}'))::bigint as n from {_MM}")
def protect_restore(spark, sf_dir):
    marked, refs = T.protect(F.col("text"))
    return _extended(spark, sf_dir, X.MM).select("id", T.restore(marked, refs).alias("restored"), F.size(refs).cast("long").alias("n"))


_SENT = r"""sent as (select doc_id, unnest(l) as sentence, generate_subscripts(l, 1)::bigint as pos from (
select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from documents))"""


@query("sentences", f"with {_SENT} select doc_id, pos, sentence from sent")
def sentences(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "sentence")


@query("structure_sections", r"""select doc_id, i - 1 as position, t as title from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1)::bigint as i from documents),
lateral (select regexp_replace(x, '^\s+|\s+$', '', 'g') as t) where length(x) > 3 and length(x) < 100 and regexp_matches(t, '^[A-Z][^.!?]*$')""")
def structure_sections(spark, sf_dir):
    d = docs_of(spark, sf_dir).select("doc_id", F.explode(T.sections(F.col("text"))).alias("s"))
    return d.select("doc_id", F.col("s.position").cast("long").alias("position"), F.col("s.title").alias("title"))


@query("structure_paragraphs", r"select doc_id, p from (select doc_id, unnest(list_transform(string_split(text, chr(10)||chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) as p from documents) where length(p) > 50")
def structure_paragraphs(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.explode(T.paragraphs(F.col("text"), 50)).alias("p"))


# Chunking --------------------------------------------------------------------------------------------------------------------
_PACK = f"""{_SENT}, s as (select *, length(sentence) // 4 as tok from sent),
p as (select doc_id, pos, sentence, tok as sum_tok, 0 as g from s where pos = 1
      union all select s.doc_id, s.pos, s.sentence, case when p.sum_tok + s.tok > 350 then s.tok else p.sum_tok + s.tok end, case when p.sum_tok + s.tok > 350 then p.g + 1 else p.g end from p join s on s.doc_id = p.doc_id and s.pos = p.pos + 1),
packed as (select doc_id, g::bigint as chunk_index, string_agg(sentence, ' ' order by pos) as content from p group by doc_id, g)"""


def packed(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.posexplode_outer(chunking.pack_sentences(F.col("text"), 350)).alias("chunk_index", "content")).where("content is not null").select("doc_id", F.col("chunk_index").cast("long"), "content")


@query("chunks_sentence_pack", f"with recursive {_PACK} select * from packed")
def chunks_sentence_pack(spark, sf_dir):
    return packed(spark, sf_dir)


_WIN = f"""{_SENT}, s as (select *, length(sentence) // 4 as tok from sent),
grow as (select doc_id, pos as i, pos as j, tok as total, tok <= 450 as ok from s
         union all select g.doc_id, g.i, s.pos, g.total + s.tok, true from grow g join s on s.doc_id = g.doc_id and s.pos = g.j + 1 where g.ok and g.total < 350 and g.total + s.tok <= 450),
size as (select doc_id, i, max(case when ok then j - i + 1 else 0 end) as n from grow group by doc_id, i),
walk as (select doc_id, i, n, i + greatest(1, n - 2) as nxt from size where i = 1 union all select z.doc_id, z.i, z.n, z.i + greatest(1, z.n - 2) from walk w join size z on z.doc_id = w.doc_id and z.i = w.nxt),
win as (select w.doc_id, (row_number() over (partition by w.doc_id order by w.i) - 1)::bigint as chunk_index, (select string_agg(s.sentence, ' ' order by s.pos) from s where s.doc_id = w.doc_id and s.pos between w.i and w.i + w.n - 1) as content from walk w where n > 0)"""


@query("chunks_sliding", f"with recursive {_WIN} select doc_id, chunk_index, content, length(content)::bigint as char_count from win")
def chunks_sliding(spark, sf_dir):
    return chunking.chunk(docs_of(spark, sf_dir), "sliding_window").select("doc_id", F.col("chunk_index").cast("long"), "content", F.col("char_count").cast("long"))


_WORDS = r"list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> '')"


@query("chunk_overlap", f"with recursive {_WIN}, w2 as (select *, lag(content) over (partition by doc_id order by chunk_index) as before from win) select doc_id, chunk_index, coalesce(len(list_intersect(list_distinct({_WORDS.format('before')}[-20:]), list_distinct({_WORDS.format('content')}[1:20]))), 0)::bigint as overlap from w2")
def chunk_overlap(spark, sf_dir):
    return chunking.chunk(docs_of(spark, sf_dir), "sliding_window").select("doc_id", F.col("chunk_index").cast("long"), F.col("overlap_with_previous").cast("long").alias("overlap"))


def _semantic_sql(source: str) -> str:
    """CTEs that end in ``parts`` (k, grp, part, content): the semantic chunks of texts (k, text)."""
    return rf"""para as (select k, p, row_number() over (partition by k order by i)::bigint as n, length(p) // 4 as tok from (select k, unnest(l) as p, generate_subscripts(l, 1) as i from (select k, list_filter(list_transform(string_split(text, chr(10)||chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from {source}))),
g as (select k, n, p, tok, tok > 450 as big, 0 as grp, case when tok > 450 then 0 else tok end as total, tok > 450 as closed from para where n = 1
      union all select q.k, q.n, q.p, q.tok, q.tok > 450, case when q.tok > 450 or g.closed or g.total + q.tok > 350 then g.grp + 1 else g.grp end, case when q.tok > 450 then 0 when g.closed or g.total + q.tok > 350 then q.tok else g.total + q.tok end, q.tok > 450 from g join para q on q.k = g.k and q.n = g.n + 1),
grp as (select k, grp, bool_or(big) as big, string_agg(p, chr(10)||chr(10) order by n) as body from g group by k, grp),
{_packed_sql("(select k, grp, body from grp where big)", "k, grp", "body")},
parts as (select k, grp, part, content from packed_parts union all select k, grp, 0, body from grp where not big)"""


def _packed_sql(source: str, key: str, text: str) -> str:
    """CTEs that end in ``packed_parts`` (key, part, content): packed sentences of each row's text."""
    on = " and ".join(f"s.{c} = pk.{c}" for c in key.split(", "))
    return rf"""cut as (select {key}, unnest(l) as sentence, generate_subscripts(l, 1)::bigint as pos from (select {key}, list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from {source})),
pk as (select {key}, pos, sentence, length(sentence) // 4 as total, 0 as part from cut where pos = 1
       union all select {", ".join("s." + c for c in key.split(", "))}, s.pos, s.sentence, case when pk.total + length(s.sentence) // 4 > 350 then length(s.sentence) // 4 else pk.total + length(s.sentence) // 4 end, case when pk.total + length(s.sentence) // 4 > 350 then pk.part + 1 else pk.part end from pk join cut s on {on} and s.pos = pk.pos + 1),
packed_parts as (select {key}, part, string_agg(sentence, ' ' order by pos) as content from pk group by {key}, part)"""


@query("chunks_semantic", f"with recursive {_semantic_sql('(select doc_id as k, text from documents)')} select k as doc_id, (row_number() over (partition by k order by grp, part) - 1)::bigint as chunk_index, content from parts")
def chunks_semantic(spark, sf_dir):
    return chunking.chunk(docs_of(spark, sf_dir), "semantic").select("doc_id", F.col("chunk_index").cast("long"), "content")


def _sections_sql(source: str) -> str:
    """CTEs that end in ``c`` (id, sec, section, content): the sections of texts (id, text)."""
    return rf"""l as (select id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from {source}),
t as (select *, regexp_replace(x, '^\s+|\s+$', '', 'g') as s, regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^#+\s+(.+)$|^([A-Z][^.!?]{{3,50}})$') and length(x) < 100 and not regexp_matches(x, '{_REFRX}') as head from l),
headed as (select *, sum(case when head then 1 else 0 end) over (partition by id order by i) as sec from t),
c as (select id, sec, coalesce(max(case when head then s end), 'Introduzione') as section, string_agg(x, chr(10) order by i) filter (not head) as content from headed group by id, sec having count(*) filter (not head) > 0)"""


@query("chunks_hierarchical", f"with {_sections_sql(X.values(X.SECTIONS, 'id, text'))} select id, (row_number() over (partition by id order by sec) - 1)::bigint as chunk_index, section, content from c")
def chunks_hierarchical(spark, sf_dir):
    return chunking.chunk(fixed(spark, X.SECTIONS), "hierarchical").select("id", F.col("chunk_index").cast("long"), "section", "content")


@query("chunks_hierarchical_documents", f"""with recursive {_sections_sql("(select doc_id as id, text from documents)")},
large as (select id || '/' || sec as k, id, sec, section, content as text from c where length(content) // 4 > 350), {_semantic_sql("large")},
every as (select id, sec, 0 as grp, 0 as part, section, content from c where length(content) // 4 <= 350 union all select large.id, large.sec, grp, part, section, content from parts join large on large.k = parts.k)
select id as doc_id, (row_number() over (partition by id order by sec, grp, part) - 1)::bigint as chunk_index, section, content from every""")
def chunks_hierarchical_documents(spark, sf_dir):
    return chunking.chunk(docs_of(spark, sf_dir), "hierarchical").select("doc_id", F.col("chunk_index").cast("long"), "section", "content")


_SEGMENTS = f"""{_PLACED}, b as (select *, greatest(0, position - 200) as lo, least(length(text), position + length(ref) + 200) as hi from placed),
w as (select *, lag(hi, 1, 0) over (partition by id order by position) as last_pos from b),
seg as (select id, position * 2 + 1 as o, substr(text, lo + 1, hi - lo) as text, case when ref like '[TABELLA%' then 'table' else 'multimodal' end as kind, regexp_extract(ref, '_([^\\]]+)\\]', 1) as ref_id from w
  union all select id, position * 2, regexp_replace(substr(text, last_pos + 1, greatest(0, position - last_pos)), '^\\s+|\\s+$', '', 'g'), 'text', null from w
  union all select t.id, 1000000, regexp_replace(substr(t.text, coalesce(m.hi, 0) + 1), '^\\s+|\\s+$', '', 'g'), 'text', null from {_MM} left join (select id, max(hi) as hi from b group by id) m on m.id = t.id),
segs as (select id, (row_number() over (partition by id order by o) - 1)::bigint as nth, text, kind, ref_id from seg where not (kind = 'text' and text = ''))"""


@query("segments_multimodal", f"with {_SEGMENTS} select * from segs")
def segments_multimodal(spark, sf_dir):
    d = _extended(spark, sf_dir, X.MM).select("id", F.posexplode(chunking.segments(F.col("text"))).alias("nth", "s"))
    return d.select("id", F.col("nth").cast("long"), "s.text", "s.kind", "s.ref_id")


@query("chunks_multimodal", f"""with recursive {_SEGMENTS}, {_packed_sql("(select id, nth, text from segs where kind <> 'table' and length(text) // 4 > 350)", "id, nth", "text")},
every as (select id, nth, 0 as part, text as content, kind = 'table' as is_table_chunk from segs where kind = 'table' or length(text) // 4 <= 350 union all select id, nth, part, content, false from packed_parts)
select id as doc_id, (row_number() over (partition by id order by nth, part) - 1)::bigint as chunk_index, content, is_table_chunk from every""")
def chunks_multimodal(spark, sf_dir):
    d = _extended(spark, sf_dir, X.MM).withColumnRenamed("id", "doc_id")
    return chunking.chunk(d, "multimodal_aware").select("doc_id", F.col("chunk_index").cast("long"), "content", "is_table_chunk")


# Statistics --------------------------------------------------------------------------------------------------------------------
@query("doc_stats", rf"select doc_id, length(text)::bigint as char_count, len({_WORDS.format('text')})::bigint as word_count, len(string_split(text, chr(10)))::bigint as line_count from documents")
def doc_stats(spark, sf_dir):
    return stats.document_stats(docs_of(spark, sf_dir)).select("doc_id", *[F.col(c).cast("long") for c in ("char_count", "word_count", "line_count")])


@query("token_histogram", "select ((length(text) // 4) // 50)::bigint as bucket, count(*) as n from documents group by 1")
def token_histogram(spark, sf_dir):
    return stats.token_histogram(read(spark, sf_dir, "documents"))


@query("line_frequency", "select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where length(line) > 10 and length(line) < 100 group by 1, 2 having count(*) >= 3")
def line_frequency(spark, sf_dir):
    return stats.line_frequency(read(spark, sf_dir, "documents"))


def _chunk_table(spark, sf_dir):
    return chunking.chunk(docs_of(spark, sf_dir), "sliding_window")


@query("chunk_validation", f"with recursive {_WIN}, c as (select length(content) as chars, length(content) // 4 as tok from win) select count(*) as total_chunks, round(avg(chars), 6) as avg_char_count, round(avg(tok), 6) as avg_token_count, min(tok)::bigint as min_tokens, max(tok)::bigint as max_tokens, count_if(tok > 512)::bigint as chunks_over_limit, count_if(tok < 100)::bigint as chunks_under_min, 0::bigint as multimodal_chunks, 0::bigint as total_multimodal_refs, 0::bigint as table_chunks from c")
def chunk_validation(spark, sf_dir):
    out = stats.chunk_validation(_chunk_table(spark, sf_dir))
    return out.select(*[F.col(c).cast("long") if t in ("int", "bigint") else F.col(c) for c, t in out.dtypes])


@query("pipeline_stats", f"with recursive {_WIN}, c as (select doc_id, length(content) as chars, length(content) // 4 as tok from win) select count(distinct doc_id) as total_documents, count(*) as total_chunks, sum(chars)::bigint as total_characters, sum(tok)::bigint as total_tokens, round(avg(tok), 6) as avg_tokens, round(stddev_pop(tok), 6) as std_tokens, min(tok)::bigint as min_tokens, max(tok)::bigint as max_tokens, median(tok)::double as median_tokens, round(avg(chars), 6) as avg_chars, count_if(tok > 512)::bigint as chunks_over_512, count_if(tok < 100)::bigint as chunks_under_100, 0::bigint as chunks_with_multimodal, round(count(*)::double / count(distinct doc_id), 6) as avg_chunks_per_doc from c")
def pipeline_stats(spark, sf_dir):
    out = stats.pipeline_stats(_chunk_table(spark, sf_dir)).drop("avg_refs_per_chunk", "max_refs_per_chunk")
    return out.select(*[F.col(c).cast("long") if t in ("int", "bigint") else F.col(c) for c, t in out.dtypes])


@query("count_by_type", "select lang, count(*) as n from documents group by lang")
def count_by_type(spark, sf_dir):
    return stats.count_by(read(spark, sf_dir, "documents"), "lang")


_MANIFEST = "m as (select doc_id, source || case when doc_id % 3 = 0 then '.pdf' else '.txt' end as name, n_chars as size, source || '/' || doc_id as path from documents), p as (select *, case when contains(lower(name), 'src1') then 'high' when name like '%.pdf' then 'medium' else 'low' end as priority from m)"


def _manifest(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, ".pdf").otherwise(".txt")
    m = d.select("doc_id", F.concat("source", ext).alias("name"), ext.alias("extension"), F.col("n_chars").alias("size"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return m.withColumn("priority", T.priority(F.col("name"), F.col("extension"), "src1"))


@query("count_by_priority", f"with {_MANIFEST} select priority, count(*) as n from p group by priority")
def count_by_priority(spark, sf_dir):
    return stats.count_by(_manifest(spark, sf_dir), "priority")


@query("manifest_priority_sort", f"with {_MANIFEST} select path, priority, case priority when 'high' then 0 when 'medium' then 1 else 2 end as rank, row_number() over (order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, path) as place from p")
def manifest_priority_sort(spark, sf_dir):
    placed = numbered(_manifest(spark, sf_dir), T.priority_rank(F.col("priority")), "path")
    return placed.select("path", "priority", T.priority_rank(F.col("priority")).alias("rank"), "place")


@query("manifest_limit", f"with {_MANIFEST} select path, priority from p order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, path limit 25")
def manifest_limit(spark, sf_dir):
    return files.by_priority(_manifest(spark, sf_dir), 25).select("path", "priority")


@query("consolidated_order", rf"select doc_id, case when doc_id % 3 = 0 then 'pdf' else 'text' end as file_type, len({_WORDS.format('text')})::bigint as word_count, length(text)::bigint as char_count, row_number() over (order by doc_id % 3 <> 0, len({_WORDS.format('text')}) desc, doc_id) as place from documents")
def consolidated_order(spark, sf_dir):
    d = docs_of(spark, sf_dir).withColumn("file_type", F.when(F.col("doc_id") % 3 == 0, "pdf").otherwise("text"))
    return stats.consolidated_order(d).select("doc_id", "file_type", F.col("word_count").cast("long"), F.col("char_count").cast("long"), "place")


@query("consolidated_totals", rf"select count(*) as documents, sum(len({_WORDS.format('text')}))::bigint as total_words, sum(length(text))::bigint as total_chars from documents")
def consolidated_totals(spark, sf_dir):
    return stats.totals(docs_of(spark, sf_dir))


@query("store_stats", "select count(*) as count, max(len(embedding))::bigint as dimension, 1::bigint as n_keys from embeddings")
def store_stats(spark, sf_dir):
    s = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    return stats.store_stats(s).select("count", F.col("dimension").cast("long"), F.size("metadata_keys").cast("long").alias("n_keys"))


# Links -----------------------------------------------------------------------------------------------------------------------------
_CH, _EL, _OW = X.values(X.CHUNKS, "doc_id, chunk_index, ref"), X.values(X.ELEMENTS, "doc_id, element_id, element_type"), X.values(X.OWNERS, "doc_id, name")
_MENTION = f"c as (select *, case when contains(ref, 'IMMAGINE_') then 'image' when contains(ref, 'TABELLA_') then 'table' end as element_type, replace(replace(replace(ref, '[IMMAGINE_', ''), '[TABELLA_', ''), ']', '') as element_id from {_CH})"


def _mm_chunks(spark):
    return fixed(spark, X.CHUNKS, "doc_id long, chunk_index int, ref string").groupBy("doc_id", "chunk_index").agg(F.sort_array(F.collect_list("ref")).alias("multimodal_refs"))


def _elements(spark):
    return fixed(spark, X.ELEMENTS, "doc_id long, element_id string, element_type string")


@query("link_elements", f"with {_MENTION}, e as (select * from {_EL}) select doc_id, chunk_index, element_type, element_id from c where exists (select 1 from e where e.doc_id = c.doc_id and e.element_type = c.element_type and e.element_id = c.element_id)")
def link_elements(spark, sf_dir):
    return linking.link_elements(_mm_chunks(spark), _elements(spark)).drop("nth")


@query("link_elements_anywhere", f"with {_MENTION}, e as (select * from {_EL}) select doc_id, chunk_index, element_type, element_id from c where exists (select 1 from e where e.element_type = c.element_type and e.element_id = c.element_id)")
def link_elements_anywhere(spark, sf_dir):
    return linking.link_elements(_mm_chunks(spark), _elements(spark), False).drop("nth")


@query("inverted_index", f"with {_MENTION} select distinct doc_id, element_type, element_id, chunk_index from c where element_type is not null")
def inverted_index(spark, sf_dir):
    return linking.inverted_index(_mm_chunks(spark)).select("doc_id", "element_type", "element_id", F.explode("chunks").alias("chunk_index"))


@query("element_chunks_substring", f"select distinct doc_id, chunk_index from {_CH} where contains(ref, 'p1_t1')")
def element_chunks_substring(spark, sf_dir):
    return linking.chunks_of_element(_mm_chunks(spark), "p1_t1", exact=False)


@query("element_chunks_exact", f"select distinct doc_id, chunk_index from {_CH} where ref = '[TABELLA_p1_t1]'")
def element_chunks_exact(spark, sf_dir):
    return linking.chunks_of_element(_mm_chunks(spark), "p1_t1")


@query("element_lookup", f"select * from {_EL} where element_id = 'p1_img1' and element_type = 'image'")
def element_lookup(spark, sf_dir):
    return linking.lookup(_elements(spark), "p1_img1")


@query("element_sources", f"select e.doc_id, e.element_id, e.element_type, o.name as source_doc from (select * from {_EL}) e left join (select * from {_OW}) o on o.doc_id = e.doc_id")
def element_sources(spark, sf_dir):
    return linking.source_of(_elements(spark), fixed(spark, X.OWNERS, "doc_id long, name string"))


@query("element_sources_first", f"with e as (select * from {_EL}), o as (select * from {_OW}) select e.doc_id, e.element_id, e.element_type, (select arg_min(o.name, o.doc_id) from o join e f on f.doc_id = o.doc_id where f.element_id = e.element_id and f.element_type = e.element_type) as source_doc from e")
def element_sources_first(spark, sf_dir):
    return linking.source_of(_elements(spark), fixed(spark, X.OWNERS, "doc_id long, name string"), False)


# Vectors -----------------------------------------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")


def _asked(spark, sf_dir):
    """The stated query set of searches: ids divisible by 100."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def _knn(k, where="true"):
    return f"""k as (select q.vec_id as query_id, v.vec_id as id, v.label, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) as sim from embeddings q join embeddings v on q.vec_id % 100 = 0 and {where}),
hits as (select query_id, row_number() over (partition by query_id order by sim desc, id)::integer as rank, id, round(1 - sim, 6) as distance, round(sim, 6) as score from k qualify rank <= {k})"""


@query("knn_topk", f"with {_knn(10)} select * from hits")
def knn_topk(spark, sf_dir):
    return vectors.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10)


@query("knn_batch", f"with {_knn(5)} select * from hits")
def knn_batch(spark, sf_dir):
    """As for more queries than one block holds: blocks of vectors meet blocks of queries."""
    return vectors.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, block=3)


@query("knn_threshold", f"with {_knn(5)} select * from hits where score >= 0.3")
def knn_threshold(spark, sf_dir):
    return vectors.search_with_threshold(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, 0.3)


@query("knn_filtered", f"with {_knn(5, 'v.label = 3')} select * from hits")
def knn_filtered(spark, sf_dir):
    return vectors.search(_vectors(spark, sf_dir), _asked(spark, sf_dir), 5, where="label = 3")


@query("rerank", f"with {_knn(10)} select query_id, row_number() over (partition by query_id order by score desc, rank)::integer as place, id, score from hits where score >= 0.1 qualify place <= 3")
def rerank(spark, sf_dir):
    return vectors.rerank(vectors.search_with_threshold(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10, 0.1)).select("query_id", "place", "id", "score")


@query("confidence", f"with {_knn(10)}, r as (select *, row_number() over (partition by query_id order by score desc, rank) as place from hits where score >= 0.1 qualify place <= 3) select query_id, round(avg(score), 6) as confidence from r group by query_id")
def confidence(spark, sf_dir):
    return vectors.confidence(vectors.rerank(vectors.search_with_threshold(_vectors(spark, sf_dir), _asked(spark, sf_dir), 10, 0.1)))


_HITS = [(1, 1, 0.75, "first text", "a.pdf", 3), (1, 2, 0.5, "second", None, None), (2, 1, 0.25, "only", "b.txt", 0)]


@query("context_format", f"select query_id, string_agg('[Fonte ' || place || ' - ' || coalesce(file_name, 'Sconosciuto') || ', Chunk #' || coalesce(chunk_index::varchar, 'N/A') || ' (Rilevanza: ' || printf('%.2f', score::double) || ')]' || chr(10) || text || chr(10) || '---', chr(10)||chr(10) order by place) as context from {X.values(_HITS, 'query_id, place, score, text, file_name, chunk_index')} group by query_id")
def context_format(spark, sf_dir):
    return vectors.context(fixed(spark, _HITS, "query_id long, place int, score double, text string, file_name string, chunk_index int"))


# Markup ------------------------------------------------------------------------------------------------------------------------------
@query("html_strip_tags", "select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as out from pages")
def html_strip_tags(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", markup.strip_tags(F.col("html")).alias("out"))


@query("html_title", "select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title from pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", markup.html_title(F.col("html")).alias("title"))


@query("html_sections", r"select page_id, level, regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') as title from (select page_id, regexp_extract(h, '(?is)<h([1-6])', 1)::integer as level, regexp_replace(regexp_replace(regexp_replace(h, '(?is)^<h[1-6][^>]*>|</h[1-6]>$', '', 'g'), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g') as t from (select page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')) as h from pages))")
def html_sections(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(markup.html_sections(F.col("html"))).alias("s")).select("page_id", "s.level", "s.title")


@query("html_parse")
def html_parse(spark, sf_dir):
    return markup.parse_html(read(spark, sf_dir, "pages"))


_BL = _extended_sql(X.BLOCKS)
_LN = "string_split(text, chr(10))"


@query("looks_like_table", f"select id, contains(text, chr(9)) or contains(text, '|') or (contains(text, '  ') and len({_LN}) > 2) as loader, contains(text, chr(9)) or contains(text, '|') or (contains(text, '   ') and len({_LN}) > 2 and len(list_filter({_LN}[1:5], lambda x: not contains(x, '  '))) = 0) as extractor from {_BL}")
def looks_like_table(spark, sf_dir):
    return _extended(spark, sf_dir, X.BLOCKS).select("id", T.looks_like_table(F.col("text")).alias("loader"), T.looks_like_table(F.col("text"), "extractor").alias("extractor"))


_ST = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_CELLS = lambda cut: f"list_transform({cut}, lambda c: {_ST.format('c')})"
_FULL = f"list_filter({_LN}, lambda l: {_ST.format('l')} <> '')"


def _rows_sql(row):
    return f"select id, array_to_string(list_transform(list_filter(list_transform({_FULL}, lambda l: {row}), lambda r: len(r) > 0), lambda r: array_to_string(r, ' | ')), chr(10)) as out from {_BL}"


@query("table_parse_loader", _rows_sql(f"case when contains(l, chr(9)) then string_split(l, chr(9)) when contains(l, '|') then {_CELLS('''string_split(l, '|')''')} else list_filter({_CELLS('''string_split(l, '  ')''')}, lambda c: c <> '') end"))
def table_parse_loader(spark, sf_dir):
    return _extended(spark, sf_dir, X.BLOCKS).select("id", T.table_to_text(T.parse_table(F.col("text"))).alias("out"))


@query("table_parse_extractor", _rows_sql(f"case when contains(l, chr(9)) then {_CELLS('string_split(l, chr(9))')} when contains(l, '|') then list_filter({_CELLS('''string_split(l, '|')''')}, lambda c: c <> '') else {_CELLS('''regexp_split_to_array(l, '  +')''')} end"))
def table_parse_extractor(spark, sf_dir):
    return _extended(spark, sf_dir, X.BLOCKS).select("id", T.table_to_text(T.parse_table(F.col("text"), "extractor")).alias("out"))


_MD = _extended_sql(X.MARKDOWN)


@query("markdown_sections", rf"select id, length(regexp_extract(h, '^(#+)', 1))::integer as level, regexp_replace(h, '^#+\s+', '') as title from (select id, unnest(regexp_extract_all(text, '(?m)^#{{1,6}}\s+.+$')) as h from {_MD})")
def markdown_sections(spark, sf_dir):
    return _extended(spark, sf_dir, X.MARKDOWN).select("id", F.explode(markup.markdown_sections(F.col("text"))).alias("s")).select("id", "s.level", "s.title")


@query("markdown_images", rf"select id, 'md_img_' || i as image_id, regexp_extract(m, '!\[([^\]]*)\]', 1) as alt, regexp_extract(m, '\]\(([^)]+)\)', 1) as path from (select id, unnest(l) as m, generate_subscripts(l, 1) as i from (select id, regexp_extract_all(text, '!\[[^\]]*\]\([^)]+\)') as l from {_MD}))")
def markdown_images(spark, sf_dir):
    return _extended(spark, sf_dir, X.MARKDOWN).select("id", F.explode(markup.markdown_images(F.col("text"))).alias("m")).select("id", "m.image_id", "m.alt", "m.path")


@query("documento_parser", rf"""with l as (select id as file_id, unnest({_LN}) as raw, generate_subscripts({_LN}, 1) as i from {X.values(X.DOCFILES, 'id, text')}),
s as (select *, {_ST.format('raw')} as line from l), g as (select *, sum(case when starts_with(line, 'DOCUMENTO') then 1 else 0 end) over (partition by file_id order by i)::bigint as nth from s)
select file_id, nth, max(case when starts_with(line, 'DOCUMENTO') then case when contains(line, ': ') then substr(line, strpos(line, ': ') + 2) else line end end) as name,
string_agg(line, chr(10) order by i) filter (not starts_with(line, 'DOCUMENTO') and line <> '' and not starts_with(line, '=')) as text from g where nth > 0 group by 1, 2 having count(*) filter (not starts_with(line, 'DOCUMENTO') and line <> '' and not starts_with(line, '=')) > 0""")
def documento_parser(spark, sf_dir):
    return markup.documento_blocks(fixed(spark, X.DOCFILES).withColumnRenamed("id", "file_id"))


@query("json_documents", f"select id as file_id, nth - 1 as nth, coalesce(d->>'name', 'document_' || (nth - 1)) as name, coalesce(d->>'content', '') as content from (select id, unnest(l) as d, generate_subscripts(l, 1) as nth from (select id, (text::json->'documents')::json[] as l from {X.values(X.JSONS, 'id, text')}))")
def json_documents(spark, sf_dir):
    return files.json_documents(fixed(spark, X.JSONS).withColumnRenamed("id", "file_id")).withColumn("nth", F.col("nth").cast("long"))


@query("event_metadata", "select event_id, props::json->>'ref' as ref from events where props is not null")
def event_metadata(spark, sf_dir):
    return read(spark, sf_dir, "events").where("props is not null").select("event_id", F.get_json_object("props", "$.ref").alias("ref"))


@query("retrieval_batch")
def retrieval_batch(spark, sf_dir):
    """Benchmark texts asked of hashed chunk vectors: the whole question path without the language model."""
    from .rag import Answering

    chunks = chunking.chunk(docs_of(spark, sf_dir), "semantic").select("doc_id", "chunk_index", "content")
    made = vectors.store(chunks, vectors.hashing_embedding(64))
    hits, _ = Answering(made, embed=vectors.hashing_embedding(64)).contexts(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return hits.select("query_id", "place", "id", "score")


@query("flagship", f"with recursive {_PACK}, c as (select d.lang, length(content) as chars, length(content) // 4 as tok from packed p join documents d on d.doc_id = p.doc_id) select lang, count(*) as chunks, sum(tok)::bigint as tokens, round(avg(tok), 6) as avg_tokens, max(tok)::bigint as max_tokens from c group by lang")
def flagship(spark, sf_dir):
    """Sentences packed into chunks, with token statistics by language."""
    d = docs_of(spark, sf_dir, "lang")
    c = d.select("lang", F.explode_outer(chunking.pack_sentences(F.col("text"), 350)).alias("content")).where("content is not null")
    tok = T.tokens(F.col("content"))
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(tok).alias("tokens"), F.round(F.avg(tok), 6).alias("avg_tokens"), F.max(tok).cast("long").alias("max_tokens"))
