"""Chat formatting by quotation linking, in DataFrame operations only.

Lines that start with ``>`` are quotes, one level a mark; runs of lines of one level are passages. A passage's text
(marks off, lower-cased, white space collapsed) is hashed and joined to the message of the conversation that first
said it: its own words as a whole, one of its own runs of lines, or one of its own lines. A passage found by none
of these as a whole is linked by its first line. A message replies to the source of its last
first-level passage that has one. Conversations come out as messages without their quotes, with the thread's root,
depth, reply target and position: (conv_id, root, position) is reply order, each message before its replies and those
before its next sibling.

Each text key has one source, its first turn, found by a partial aggregate, so the join's rows do not grow with how
often a text is said. Roots and depths come by pointer doubling over replies only, positions by doubling along the walk
around each thread's tree, so a thread of any length is never gathered in one task.

Defined cases: a null text is empty; a message with a null conv_id or turn is neither linked nor a source; a passage
first said in the same or a later turn is not linked; repeated (conv_id, turn) rows share the reply target of the one with
the latest source; blank quote lines end no passage and count for nothing. A message of any length is worked on in its
row, in time that grows with its lines. Extra columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns of one parent that are put in order at once.
STRETCH = 4096
_MARKS = r"^((?:[ \t]*>)+)"


def _plain(c):
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\x0B\f]+", " ")))


def _let(value, body):
    """``body`` of a value that is worked out once, whatever ``body`` does with it."""
    return F.transform(F.array(value), body)[0]


def _lines(text):
    """Array of (level, body, plain) of the lines of a text."""
    def one(x):
        marks = F.regexp_extract(x, _MARKS, 1)
        body = F.regexp_replace(x, _MARKS, "")
        return F.struct(F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), body.alias("body"), _plain(body).alias("plain"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def _passages(lines):
    """Runs of one level: array of (level, text, first), blank lines left out of the text."""
    def cut(all_lines):
        starts = F.filter(F.sequence(F.lit(1), F.size(all_lines)), lambda i: (i == 1) | (F.element_at(all_lines, i)["level"] != F.element_at(all_lines, F.greatest(i - 1, F.lit(1)))["level"]))
        return _let(starts, lambda at: F.transform(at, lambda i, k: run(all_lines, i, F.coalesce(F.try_element_at(at, k + 2), F.size(all_lines) + 1))))

    def run(all_lines, i, end):
        said = F.filter(F.transform(F.slice(all_lines, i, end - i), lambda x: x["plain"]), lambda x: x != "")
        return _let(said, lambda v: F.struct(F.element_at(all_lines, i)["level"].alias("level"), F.array_join(v, " ").alias("text"), F.coalesce(F.try_element_at(v, F.lit(1)), F.lit("")).alias("first")))

    return F.filter(_let(lines, cut), lambda r: r["text"] != "")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), chat, reply_to, root, depth, position, n_quotes, n_linked of every message."""
    m = conversations.select(F.monotonically_increasing_id().alias("mid"), "conv_id", "turn", "role", _let(_lines(F.col("text")), lambda x: F.struct(x.alias("lines"), _passages(x).alias("runs"))).alias("p"))

    def parts(p):
        own, own_runs = F.filter(p["lines"], lambda x: x["level"] == 0), F.transform(F.filter(p["runs"], lambda x: x["level"] == 0), lambda x: x["text"])
        text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
        said = F.array_distinct(F.concat(F.transform(own, lambda x: x["plain"]), own_runs, F.array(F.array_join(own_runs, " "))))
        return F.struct(text.alias("text"), F.filter(said, lambda x: x != "").alias("said"), F.filter(p["runs"], lambda x: x["level"] > 0).alias("quoted"))

    m = m.select("mid", "conv_id", "turn", "role", _let(F.col("p"), parts).alias("p")).select("mid", "conv_id", "turn", "role", "p.*")
    m = materialise(m, "messages")

    known = m.where("conv_id is not null and turn is not null")
    key = lambda c: F.sha2(c, 256)
    # Only conversations' quoted keys are looked up, and each key has one source.
    asked = known.where(F.size("quoted") > 0).select("mid", "conv_id", "turn", F.posexplode("quoted").alias("nth", "q")).select("mid", "conv_id", "turn", "nth", F.col("q.level").alias("level"), key(F.col("q.text")).alias("whole"), key(F.col("q.first")).alias("first"))
    asked = materialise(asked, "quotes")
    if asked.isEmpty():
        return m.select("conv_id", "turn", "role", "text", _chat(), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("root"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("n_quotes"), F.lit(0).alias("n_linked"))
    source = known.select("conv_id", "turn", F.explode("said").alias("t")).groupBy("conv_id", key(F.col("t")).alias("k")).agg(F.min("turn").alias("source"))
    keys = asked.select("mid", "conv_id", "turn", "nth", "level", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("whole").alias("k")), F.struct(F.lit(1).alias("rank"), F.col("first").alias("k")))).alias("x")).select("mid", "conv_id", "turn", "nth", "level", "x.rank", "x.k")
    found = keys.join(source, ["conv_id", "k"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    passages = found.groupBy("mid", "conv_id", "turn", "nth", "level").agg(F.min(F.when(F.col("source").isNotNull(), F.struct("rank", "source")))["source"].alias("source"))
    counts = passages.groupBy("mid", "conv_id", "turn").agg(F.count("*").cast("int").alias("n_quotes"), F.count("source").cast("int").alias("n_linked"), F.max(F.when((F.col("level") == 1) & F.col("source").isNotNull(), F.struct("nth", "source")))["source"].alias("own_reply"))
    counts = materialise(counts, "links")
    replies = counts.where("own_reply is not null").groupBy("conv_id", "turn").agg(F.max("own_reply").alias("up"))
    # Pointer doubling: after k rounds ``up`` is 2^k replies away, or the root.
    ptr = materialise(replies.withColumn("depth", F.lit(1)), "pointers")
    while True:
        nxt = ptr.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        joined = ptr.join(nxt, ["conv_id", "up"], "left")
        moved = materialise(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moving")), "pointers")
        ptr = moved.drop("moving")
        if moved.where("moving").isEmpty():
            break
    out = m.join(counts.select("mid", "n_quotes", "n_linked"), "mid", "left").join(replies.withColumnRenamed("up", "reply_to"), ["conv_id", "turn"], "left").join(ptr, ["conv_id", "turn"], "left")
    coming = _coming(replies)
    out = out.withColumn("root", F.coalesce("up", "turn")).join(coming, ["conv_id", "turn"], "left").join(coming.select("conv_id", F.col("turn").alias("root"), F.col("n").alias("all")), ["conv_id", "root"], "left")
    return out.select("conv_id", "turn", "role", "text", _chat(), "reply_to", "root", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce(F.col("all") - F.col("n"), F.lit(0)).cast("long").alias("position"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def _coming(replies: DataFrame) -> DataFrame:
    """conv_id, turn, n of the messages in threads of two or more, by (conv_id, turn, up) of the replies: how many messages
    of the thread come from this one on, in reply order.

    The walk around a thread's tree enters every message (``out`` false) and leaves it (true): a message is followed by
    its first reply's entry or its own leaving, a leaving by the next sibling's entry or the parent's leaving. Pointer
    doubling along it counts the entries that are still to come.
    """
    # The next sibling: within stretches of turns, then from stretch to stretch, so that no parent is sorted in one task.
    kids = replies.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    inner = kids.withColumn("next", F.lead("turn").over(Window.partitionBy("conv_id", "up", "stretch").orderBy("turn")))
    heads = kids.groupBy("conv_id", "up", "stretch").agg(F.min("turn").alias("head")).withColumn("then", F.lead("head").over(Window.partitionBy("conv_id", "up").orderBy("stretch"))).drop("head")
    kids = inner.join(heads, ["conv_id", "up", "stretch"]).select("conv_id", "turn", "up", F.coalesce("next", "then").alias("next"))
    first = replies.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = kids.join(first, ["conv_id", "turn"], "full_outer")
    enter = nodes.select("conv_id", "turn", F.lit(False).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("n"))
    leave = nodes.select("conv_id", "turn", F.lit(True).alias("out"), F.coalesce("next", "up").alias("to"), (F.col("next").isNull() & F.col("up").isNotNull()).alias("to_out"), F.lit(0).cast("long").alias("n"))
    walk = materialise(enter.unionByName(leave), "walk")
    while True:
        on = walk.select("conv_id", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("to2"), F.col("to_out").alias("to_out2"), F.col("n").alias("n2"))
        after = walk.join(on, ["conv_id", "to", "to_out"], "left").select("conv_id", "turn", "out", F.col("to2").alias("to"), F.coalesce("to_out2", F.lit(False)).alias("to_out"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        walk = materialise(after, "walk")
        if walk.where("to is not null").isEmpty():
            break
    return walk.where("not out").select("conv_id", "turn", "n")


def _chat():
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text").alias("chat")


#: DuckDB's version of ``link`` over ``conversations``.
ORACLE = r"""
with recursive m as (select row_number() over () as mid, conv_id, turn, role, coalesce(text, '') as raw from conversations),
ln as (select mid, conv_id, turn, i, regexp_extract(x, '^((?:[ \t]*>)+)', 1) as marks, regexp_replace(x, '^((?:[ \t]*>)+)', '') as body
       from (select mid, conv_id, turn, unnest(string_split(raw, chr(10))) as x, generate_subscripts(string_split(raw, chr(10)), 1) as i from m)),
l as (select mid, conv_id, turn, i, length(regexp_replace(marks, '[^>]', '', 'g')) as level, body, lower(trim(regexp_replace(body, '[ \t\r\x0B\f]+', ' ', 'g'), ' ')) as plain from ln),
g as (select *, sum(case when level is distinct from prev then 1 else 0 end) over (partition by mid order by i) as run from (select *, lag(level) over (partition by mid order by i) as prev from l)),
runs as (select mid, conv_id, turn, run, any_value(level) as level, string_agg(plain, ' ' order by i) filter (plain <> '') as text, arg_min(plain, i) filter (plain <> '') as head from g group by mid, conv_id, turn, run having count(*) filter (plain <> '') > 0),
own as (select mid, regexp_replace(string_agg(body, chr(10) order by i), '^\s+|\s+$', '', 'g') as text from l where level = 0 group by mid),
said as (select conv_id, turn, plain as t from l where level = 0 and plain <> ''
         union all select conv_id, turn, text from runs where level = 0
         union all select conv_id, turn, string_agg(text, ' ' order by run) from runs where level = 0 group by mid, conv_id, turn),
source as (select conv_id, t, min(turn) as source from said where conv_id is not null and turn is not null group by conv_id, t),
q as (select r.mid, r.conv_id, r.turn, r.run, r.level, coalesce(case when a.source < r.turn then a.source end, case when b.source < r.turn then b.source end) as source
      from runs r left join source a on a.conv_id = r.conv_id and a.t = r.text left join source b on b.conv_id = r.conv_id and b.t = r.head
      where r.level > 0 and r.conv_id is not null and r.turn is not null),
c as (select mid, conv_id, turn, count(*) as n_quotes, count(source) as n_linked, arg_max(source, run) filter (level = 1 and source is not null) as own_reply from q group by mid, conv_id, turn),
replies as (select conv_id, turn, max(own_reply) as up from c where own_reply is not null group by conv_id, turn),
walk as (select conv_id, turn, up, 1 as depth from replies union all select w.conv_id, w.turn, r.up, w.depth + 1 from walk w join replies r on r.conv_id = w.conv_id and r.turn = w.up),
top as (select conv_id, turn, arg_max(up, depth) as root, max(depth) as depth from walk group by conv_id, turn),
path as (select distinct conv_id, root, root as turn, [root] as p from top union all select r.conv_id, path.root, r.turn, list_append(p, r.turn) from path join replies r on r.conv_id = path.conv_id and r.up = path.turn),
pos as (select conv_id, turn, row_number() over (partition by conv_id, root order by p) - 1 as position from path)
select m.conv_id, m.turn, m.role, coalesce(own.text, '') as text, '<|' || coalesce(m.role, 'user') || '|>' || chr(10) || coalesce(own.text, '') as chat,
       r.up as reply_to, coalesce(t.root, m.turn) as root, coalesce(t.depth, 0)::integer as depth, coalesce(pos.position, 0)::bigint as position, coalesce(c.n_quotes, 0)::integer as n_quotes, coalesce(c.n_linked, 0)::integer as n_linked
from m left join own on own.mid = m.mid left join c on c.mid = m.mid left join replies r on r.conv_id = m.conv_id and r.turn = m.turn left join top t on t.conv_id = m.conv_id and t.turn = m.turn left join pos on pos.conv_id = m.conv_id and pos.turn = m.turn
"""
