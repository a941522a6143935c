"""Small literal tables for behaviour that the data tables do not show; used on both sides of a comparison."""
from __future__ import annotations

MM = [
    (1, "Intro text here. [IMMAGINE_p1_img1] shows the plan. See [TABELLA_p1_t1] and [TABELLA_p1_t10]. " + "Filler words follow on. " * 30 + "[GRAFICO_g1] then [FIGURA_f1]"),
    (2, "[IMMAGINE_a] at the start. " + "Middle sentence goes here. " * 25 + "Repeated [IMMAGINE_a] again, ends with [TABELLA_z]"),
    (3, "No references at all. Just text."),
    (4, "Close [IMMAGINE_x1] by [IMMAGINE_x2]."),
    (5, ""),
]
CLEAN = [
    (1, "paro-\nla e paro-\nLa, A-\nb"),
    (2, "a.C.,per due.Tre:Quattro , fine ; basta !"),
    (3, "12\n\n\nfoo\nPage 3 of 9\n-----\nbar\n12345\n=====   \nend"),
    (4, "tab\tand  spaces\n \n \n \nnext   line  \n\n\n\nlast"),
    (5, "“quoted” ‘single’ wait....... ok"),
    (6, "visit https://example.org/a?b=c or mail a.b@example.org code ABCDEF123456 end\nshort\n\nlong enough line here"),
    (7, "header line repeated\nx\nheader line repeated\ny\nheader line repeated\ntwice only line\ntwice only line"),
    (8, "bell\x07 and\x00 soft"),
    (9, ""),
]
GARBLED = [(1, "â€œhello"), (2, "Ã© Ã¨ Ã"), (3, "â‚¬ 5 â€ x"), (4, "plain")]
BLOCKS = [
    (1, "a\tb\tc\n1\t2\t3"), (2, "a | b | c\n1 |  | 3\n\n| x |"), (3, "name  value\nfirst  1\nsecond  2"), (4, "one   two\nthree   four\nfive   six"),
    (5, "one   two\nthree   four\n"), (6, "just a line"), (7, "a  b\nc d\ne  f"), (8, ""),
]
SECTIONS = [(1, "# Title one\nbody a\nbody b.\nSecond Section\nmore text here\n\nEnd of it."), (2, "intro line.\n## Deep\nx [IMMAGINE_a] y\nLine With [TABELLA_t]\nPlain Heading\n"), (3, "Only Heading"), (4, "")]
MARKDOWN = [(1, "# Main title\n\ntext ![alt one](img/a.png) more\n## Sub part\n![](b.png)\n###### Deep one"), (2, "no title here\n### Third"), (3, "")]
DOCFILES = [(1, "before\nDOCUMENTO 1: First: part\n====\nline a\n\n  line b  \nDOCUMENTO 2: Empty\n=====\nDOCUMENTO three\nline c\n=== footer\nlast"), (2, "nothing here")]
CHUNKS = [(1, 0, "[IMMAGINE_p1_img1]"), (1, 1, "[TABELLA_p1_t1]"), (1, 1, "[TABELLA_p1_t10]"), (1, 2, "[IMMAGINE_none]"), (2, 0, "[IMMAGINE_p1_img1]"), (2, 3, "[TABELLA_p1_t1]"), (2, 4, "[GRAFICO_g1]")]
ELEMENTS = [(1, "p1_img1", "image"), (1, "p1_t1", "table"), (1, "p1_t10", "table"), (2, "p1_img1", "image"), (3, "p9_t1", "table")]
OWNERS = [(1, "first.pdf"), (2, "second.pdf"), (3, "third.pdf")]
JSONS = [(1, '{"documents":[{"name":"a","content":"text a"},{"content":"no name"},{"name":"c"}]}'), (2, '{"documents":[]}')]


def literal(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''").replace("\x00", "'||chr(0)||'") + "'"


def values(rows, columns: str) -> str:
    """A DuckDB table expression with these rows; the first column, an id, is a BIGINT."""
    return "(values " + ", ".join("(" + ", ".join([literal(r[0]) + "::bigint", *(literal(v) for v in r[1:])]) + ")" for r in rows) + f") as t({columns})"
