"""Text functions from column to column: cleaning, references, sentences, tokens, tables.

Regexes follow Unicode white space and ``\\n``-only line ends, hence the ``(?U)`` and ``(?dm)`` flags. All of them
stay in the JVM but ``nfkc``, for which Spark has no function.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..slices import text_slices

# Reference kinds in the order in which they are looked for, and their type names.
REF_KINDS = {"IMMAGINE": "image", "TABELLA": "table", "GRAFICO": "chart", "FIGURA": "figure"}
REF = r"\[(IMMAGINE|TABELLA|GRAFICO|FIGURA)_([^\]]+)\]"
# Garbled sequences and what they stand for, in order.
MOJIBAKE = [("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ('â€"', "–"), ("Ã¨", "è"), ("Ã©", "é"), ("Ã", "à"), ("Ã¹", "ù"), ("Ã²", "ò"), ("â‚¬", "€")]
_SPACE = r"[\s\x1c-\x1f]"


# The patterns of the cleaners below are fixed values: their results must be these.


def strip(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def lines(c) -> Column:
    return F.split(c, "\n")


def normalize_whitespace(c) -> Column:
    """Runs of blanks to one, three line ends or more to two, then every line stripped."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.array_join(F.transform(lines(c), strip), "\n")


def drop_rules_and_numbers(c) -> Column:
    """Lines that are page numbers or rules become empty; white space after them goes too, line ends included."""
    return F.regexp_replace(F.regexp_replace(c, r"(?dmU)^\d+\s*$", ""), r"(?dmU)^[_\-=*]{3,}\s*$", "")


def drop_page_marks(c) -> Column:
    """As above for numbers of up to four digits, "Page n of m" and rules."""
    for pattern in (r"^\d{1,4}\s*$", r"^Page \d+ of \d+\s*$", r"^[_\-=*]{3,}\s*$"):
        c = F.regexp_replace(c, "(?dmU)" + pattern, "")
    return c


def join_hyphens(c) -> Column:
    return F.regexp_replace(c, r"([a-z])-\n([a-z])", "$1$2")


def space_capitals(c) -> Column:
    """A space between punctuation and a capital."""
    return F.regexp_replace(c, r"([.!?,:;])([A-Z])", "$1 $2")


def tidy_punctuation(c) -> Column:
    """A space after punctuation before a letter, none before punctuation, plain quotes, three dots at most."""
    c = F.regexp_replace(c, r"([.!?,:;])([A-Za-z])", "$1 $2")
    c = F.regexp_replace(c, rf"(?U){_SPACE}+([.!?,:;])", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "[“”]", '"'), "[‘’]", "'")
    return F.regexp_replace(c, r"\.{3,}", "...")


def fix_mojibake(c) -> Column:
    for wrong, right in MOJIBAKE:
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return c


def drop_control(c) -> Column:
    """Without control, format and other C* characters, but for tab and line end."""
    return F.regexp_replace(c, r"[\p{C}&&[^\t\n]]", "")


def mask(c) -> Column:
    """URLs, e-mail addresses and long codes masked; short lines dropped, empty ones kept."""
    c = F.regexp_replace(c, r"(?U)https?://\S+", "[URL]")
    c = F.regexp_replace(c, r"(?U)\S+@\S+\.\S+", "[EMAIL]")
    c = F.regexp_replace(c, r"(?U)\b[A-Z0-9]{10,}\b", "[CODE]")
    return F.array_join(F.filter(lines(c), lambda x: (F.length(x) > 10) | (x == "")), "\n")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once: a lambda's variable, where a column would be worked out at each use."""
    return F.transform(F.array(value), body)[0]


def repetitive_lines(c, least: int = 3) -> Column:
    """The distinct lines of 11 to 99 characters that occur ``least`` times or more."""
    some = F.filter(lines(c), lambda x: (F.length(x) > 10) & (F.length(x) < 100))

    def found(ordered):
        # In a sorted array a line is ``least``-fold where it equals the one ``least - 1`` places before.
        shifted = F.slice(ordered, least, F.greatest(F.size(ordered), F.lit(1)))
        return F.array_distinct(F.filter(F.zip_with(ordered, shifted, lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))

    return let(F.array_sort(some), found)


def drop_repetitive_lines(c) -> Column:
    def kept(t):
        return let(repetitive_lines(t), lambda bad: F.when(F.size(bad) == 0, t).otherwise(F.array_join(F.filter(lines(t), lambda x: ~F.array_contains(bad, x)), "\n")))

    return let(c, kept)


def arrow_function(kind: str):
    """A pandas UDF made on use: its type is parsed by the running session, and import must not need one."""
    def make(f):
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return make


def _nfkc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Slice by slice: of a batch only its own bytes are held, and neither its strings nor its result."""
    import unicodedata

    for array in texts:
        empty = True
        for part in text_slices(pa.RecordBatch.from_arrays([array], names=["text"]), limit=1 << 20):
            empty = False
            yield pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in part.column(0).to_pylist()], array.type)
        if empty:
            yield array


def nfkc(c) -> Column:
    """Compatibility composition; an Arrow function, as Spark has none."""
    return F.arrow_udf(_nfkc, "string")(c)


def protect(c, kinds=tuple(REF_KINDS)) -> tuple[Column, Column]:
    """(text with references replaced by numbered marks, the references): kind by kind, in order of occurrence."""
    refs = F.concat(*[F.regexp_extract_all(c, F.lit(rf"(\[{k}_[^\]]+\])"), 1) for k in kinds])
    numbered = F.transform(refs, lambda r, i: F.struct(r.alias("r"), F.concat(F.lit("<<<PROTECTED_"), i.cast("string"), F.lit(">>>")).alias("m")))
    return F.aggregate(numbered, c.cast("string"), lambda t, x: F.replace(t, x["r"], x["m"])), refs


def restore(c, refs) -> Column:
    numbered = F.transform(refs, lambda r, i: F.struct(r.alias("r"), F.concat(F.lit("<<<PROTECTED_"), i.cast("string"), F.lit(">>>")).alias("m")))
    return F.aggregate(numbered, c, lambda t, x: F.replace(t, x["m"], x["r"]))


def processor_clean(c, doc_type: str = "generic", compose: bool = True) -> Column:
    """The cleaner before chunking: references kept, then the steps in their order."""
    t, refs = protect(c)
    t = normalize_whitespace(nfkc(t) if compose else t)
    if doc_type == "pdf":
        t = drop_rules_and_numbers(t)
    t = space_capitals(join_hyphens(t))
    if doc_type == "pdf":
        t = drop_repetitive_lines(t)
    return restore(t, refs)


def extractor_clean(c, doc_type: str = "generic", aggressive: bool = False, compose: bool = True) -> Column:
    """The cleaner after extraction; another set of steps, not interchangeable with the other."""
    t, refs = protect(c, ("IMMAGINE", "TABELLA"))
    t = normalize_whitespace(drop_control(fix_mojibake(nfkc(t) if compose else t)))
    t = tidy_punctuation(join_hyphens(t))
    if doc_type == "pdf":
        t = drop_page_marks(t)
    return restore(mask(t) if aggressive else t, refs)


def refs_of(c) -> Column:
    """The full references in order of kind, then of place."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(rf"(\[{k}_[^\]]+\])"), 1) for k in REF_KINDS])


def refs_in_place(c) -> Column:
    """Array of (full_ref, kind, id, position from 0) in order of place."""
    found, gaps = F.regexp_extract_all(c, F.lit(f"({REF})"), 1), F.split(c, REF)
    kind = "array<struct<full_ref:string,position:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a, x):
        place = a["at"] + F.length(x["gap"])
        return F.struct((place + F.length(x["ref"])).alias("at"), F.array_append(a["out"], F.struct(x["ref"].alias("full_ref"), place.alias("position"))).alias("out"))

    zipped = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda r, g: F.struct(r.alias("ref"), g.alias("gap")))
    placed = F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(F.aggregate(zipped, start, step, lambda a: a["out"]))
    return F.transform(placed, lambda x: F.struct(x["full_ref"].alias("full_ref"), F.regexp_extract(x["full_ref"], REF, 1).alias("kind"), F.regexp_extract(x["full_ref"], REF, 2).alias("id"), x["position"].alias("position")))


def tokens(c) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return F.shiftright(F.length(c), 2)


_BREAK = rf"(?U)(?<=[.!?]){_SPACE}+(?=[A-Z])"


def sentences(c) -> Column:
    """Sentences, stripped: split where white space stands between an end mark and an ASCII capital, but not inside references."""
    inside = r"\[[A-Z]+_[^\]]+\]"
    held = F.regexp_extract_all(c, F.lit(f"({inside})"), 1)
    marked = F.aggregate(F.transform(held, lambda r, i: F.struct(r.alias("r"), F.concat(F.lit("<<<PROTECTED_SENT_"), i.cast("string"), F.lit(">>>")).alias("m"))), c.cast("string"), lambda t, x: F.replace(t, x["r"], x["m"]))
    back = lambda s: F.aggregate(F.transform(held, lambda r, i: F.struct(r.alias("r"), F.concat(F.lit("<<<PROTECTED_SENT_"), i.cast("string"), F.lit(">>>")).alias("m"))), s, lambda t, x: F.replace(t, x["m"], x["r"]))
    plain = F.split(c, _BREAK)
    parts = F.when(c.contains("["), F.transform(F.split(marked, _BREAK), back)).otherwise(plain)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def words(c) -> Column:
    return F.filter(F.split(c, rf"(?U){_SPACE}+"), lambda x: x != "")


def shared_words(before, after, n: int = 20) -> Column:
    """Distinct words among both the last ``n`` of one text and the first ``n`` of the next."""
    w = words(before)
    last = F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n)
    return F.size(F.array_intersect(last, F.slice(words(after), 1, n)))


def paragraphs(c, more_than: int = 0) -> Column:
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: F.length(p) > more_than)


def sections(c) -> Column:
    """Array of (title, position): lines of 4 to 99 characters that read as a title."""
    numbered = F.transform(lines(c), lambda x, i: F.struct(strip(x).alias("title"), i.alias("position"), F.length(x).alias("n")))
    kept = F.filter(numbered, lambda x: (x["n"] > 3) & (x["n"] < 100) & x["title"].rlike(r"(?d)^[A-Z][^.!?]*$"))
    return F.transform(kept, lambda x: F.struct(x["title"].alias("title"), x["position"].alias("position")))


def is_section_title(line) -> Column:
    """Whether a line opens a section in hierarchical chunking."""
    return strip(line).rlike(r"(?dU)^#+\s+(.+)$|^([A-Z][^.!?]{3,50})$") & (F.length(line) < 100) & ~line.rlike(REF)


def looks_like_table(c, mode: str = "loader") -> Column:
    ls = lines(c)
    if mode == "loader":
        spaced = c.contains("  ") & (F.size(ls) > 2)
    else:
        spaced = c.rlike("   ") & (F.size(ls) > 2) & F.forall(F.slice(ls, 1, 5), lambda x: x.rlike("  +"))
    return c.contains("\t") | c.contains("|") | spaced


def parse_table(c, mode: str = "loader") -> Column:
    """Rows of cells of a block; the two modes differ in empty cells and in stripping."""
    full = F.filter(lines(c), lambda x: strip(x) != "")
    filled = lambda a: F.filter(a, lambda x: x != "")
    cut = lambda x, sep: F.transform(F.split(x, sep), strip)
    if mode == "loader":
        row = lambda x: F.when(x.contains("\t"), F.split(x, "\t")).when(x.contains("|"), cut(x, r"\|")).otherwise(filled(cut(x, "  ")))
    else:
        row = lambda x: F.when(x.contains("\t"), cut(x, "\t")).when(x.contains("|"), filled(cut(x, r"\|"))).otherwise(cut(x, "  +"))
    return F.filter(F.transform(full, row), lambda r: F.size(r) > 0)


def table_to_text(rows) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def element_id(kind, content) -> Column:
    return F.concat(kind, F.lit("_"), F.substring(F.md5(content), 1, 8))


def priority(name, extension, keyword: str) -> Column:
    """high if the name holds the keyword, medium for PDF, else low."""
    return F.when(F.lower(name).contains(keyword), "high").when(F.lower(extension) == ".pdf", "medium").otherwise("low")


def priority_rank(p) -> Column:
    return F.when(p == "high", 0).when(p == "medium", 1).when(p == "low", 2).otherwise(3)


def describe_elements(content, images, tables) -> Column:
    """Placeholders of images and tables replaced by their descriptions (arrays of structs)."""
    def image(t, i):
        seen = F.when(F.coalesce(i["ocr_text"], F.lit("")) != "", F.concat(F.lit(" - Testo OCR: "), F.substring(i["ocr_text"], 1, 100), F.lit("..."))).otherwise("")
        size = F.concat(F.coalesce(i["width"].cast("string"), F.lit("")), F.lit("x"), F.coalesce(i["height"].cast("string"), F.lit("")))
        return F.replace(t, F.concat(F.lit("[IMMAGINE_"), i["image_id"], F.lit("]")), F.concat(F.lit("[Immagine: "), i["image_id"], F.lit(" - Dimensioni: "), size, F.lit("px"), seen, F.lit("]")))

    def table(t, x):
        told = F.concat(F.lit("[Tabella "), x["table_id"], F.lit(": "), x["rows"].cast("string"), F.lit(" righe x "), x["cols"].cast("string"), F.lit(" colonne]\n"), F.coalesce(x["text_representation"], F.lit("")))
        return F.replace(t, F.concat(F.lit("[TABELLA_"), x["table_id"], F.lit("]")), told)

    return F.aggregate(tables, F.aggregate(images, content, image), table)
