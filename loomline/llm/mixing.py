"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sizes are words. Targets share all sizes by source weight and stop at ``MOST`` times a source's own size, the excess
going to the others by weight. Slot i of the schedule sits at the golden-ratio point frac(i * phi), here the integer
Weyl sequence i * 2654435769 mod 2^32; the source whose stretch of the cumulative targets holds the point gets the
slot. Slots are ranked within their source, and slot r takes the source's block r modulo its number of blocks: its
documents in hash order, cut into blocks of equal words. A source's blocks are used up evenly, so a document is taken
at most ``MOST`` times.

Prefix sums run in two levels (within stretches of the hash order, which grow in number with the input, then over
them), so no source, however hot, is sorted in one task; one row a source is, as targets depend on all of them. The
number of slots is at most ``SLOTS``, whatever the input: a block grows with it. A source of fewer than ``LEAST`` such
blocks would miss its target by too much, so it is taken by words: in whole rounds, and the rest of its target from the
start of its order.

Defined cases: a null text has size 0 and is not taken; a null source is a source of its own, the last; null and
repeated ids are rows like others; an empty table, or one without words, takes nothing. A text of any length counts its
words in its row; it may span many blocks. Extra columns are ignored, and kept by ``mixed_documents``, whatever their
names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MOST, SLOTS, GOLDEN, ROUND = 3, 1 << 20, 2654435769, 1 << 32
#: Slots that are ranked at once; documents of one source that are laid out at once, about.
SLOT_PART, STRETCH_DOCS = 1024, 1 << 16
#: Blocks of more than one word that a source must have to be taken by blocks.
LEAST = 4096
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, src, place (hash order within the source) and size of every document."""
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))).alias("place"))


def targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """src, source_size, target, and the target's stretch [low, high) of 2^32 points: one row a source."""
    every = Window.partitionBy()
    s = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = s.withColumn("weight", ((F.row_number().over(Window.orderBy("src")) - 1) % 3 + 1).cast("long")).withColumn("total", F.sum("source_size").over(every))
    # Sources fill up in the order of cap / weight: the level is that of the first source that stays under its cap.
    s = s.withColumn("cap", most * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("fills_at", "src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("fills_at") >= F.col("level"), F.struct("fills_at", "src", "level"))).over(every)["level"])
    s = s.withColumn("target", F.when(F.col("cap") < F.col("level") * F.col("weight"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")))
    s = s.withColumn("whole", F.floor("target").cast("long"))
    s = s.withColumn("sum_to", F.sum("whole").over(Window.orderBy("src"))).withColumn("all_whole", F.greatest(F.sum("whole").over(every), F.lit(1)))
    point = lambda c: F.floor(c.cast("double") / F.col("all_whole").cast("double") * F.lit(float(ROUND))).cast("long")
    s = s.withColumn("low", point(F.col("sum_to") - F.col("whole"))).withColumn("high", point(F.col("sum_to")))
    return s.select("src", "source_size", "target", "low", "high", "total", F.sum("n_docs").over(every).alias("all_docs"))


def schedule(spark, n_slots: int, stretches: DataFrame) -> DataFrame:
    """slot, src, rank: every slot of the schedule with its source and its rank there."""
    cells = 4096
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN % ROUND).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") / (ROUND // cells)).cast("long"))
    held = stretches.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / (ROUND // cells)), F.floor((F.col("high") - 1) / (ROUND // cells)))))
    given = slots.join(held.select("cell", "src", "low", "high"), "cell").where("u >= low and u < high").select("slot", "src", F.floor(F.col("slot") / SLOT_PART).alias("part"))
    before = given.groupBy("src", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("src").orderBy("part")) - F.col("n"))
    ranked = given.withColumn("inner", F.row_number().over(Window.partitionBy("src", "part").orderBy("slot")) - 1)
    return ranked.join(before, ["src", "part"]).select("slot", "src", (F.col("inner") + F.col("before")).alias("rank"))


def mix(docs: DataFrame, most: int = MOST, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    spark = docs.sparkSession
    sized = materialise(sizes(docs), "sizes")
    goals = materialise(targets(sized, most), "targets")
    most_of = goals.agg(F.max("total").alias("total"), F.max("all_docs").alias("docs")).first()
    total, n_docs = most_of["total"] or 0, most_of["docs"] or 0
    # Stretches of the hash order, in bits of the place's first six digits: some ``STRETCH_DOCS`` documents each at most.
    bits = min(24, max(10, (n_docs // STRETCH_DOCS).bit_length()))
    sized = sized.withColumn("bucket", F.shiftright(F.conv(F.substring("place", 1, 6), 16, 10).cast("int"), 24 - bits))
    block = max(1, -(-total // slots))
    per_source = goals.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("by_words", F.lit(block > 1) & (F.col("blocks") < LEAST))
    per_source = per_source.withColumn("rounds", F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))).withColumn("rest", F.floor("target") - F.col("rounds") * F.col("source_size"))
    # Where each document starts in its source's order.
    order = Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "size")
    sums = sized.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n")
    laid = sized.withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).join(sums, ["src", "bucket"])
    laid = laid.withColumn("start", F.col("inner") + F.col("base")).withColumn("row", F.struct("place", "start", "doc_id"))
    laid = laid.join(per_source.select("src", "by_words", "rounds", "rest"), "src")
    # How often the schedule takes each block.
    given = schedule(spark, total // block, per_source.where("not by_words")).join(per_source.select("src", "blocks"), "src").where(F.col("rank") < most * F.col("blocks"))
    uses = given.groupBy("src", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))
    touched = laid.where("size > 0 and not by_words").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = touched.join(uses, ["src", "block"], "left").groupBy("src", "doc_id", "size", "start").agg(F.sum(words * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    part = F.greatest(F.least(F.col("start") + F.col("size"), F.col("rest")) - F.col("start"), F.lit(0))
    others = laid.where("size = 0 or by_words").select("src", "doc_id", "size", "start", F.when(F.col("by_words"), F.col("rounds") * F.col("size") + part).otherwise(0).cast("long").alias("taken"))
    return taken.unionByName(others).join(goals.select("src", "source_size", "target"), "src").select("doc_id", "size", "source_size", "target", "taken", F.when(F.col("src") != "t", F.substring("src", 2, 1 << 30)).alias("source"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each repeated as often as its words are taken, to the nearest whole text.

    Blocks of a source are used in turn, so all its documents but one at the turn are taken a whole number of times
    or nearly so. Columns as in ``docs``; a row taken for less than half its words is not in the mix.
    """
    times = mix(docs).groupBy("doc_id", "source", "size").agg(F.floor(F.avg(F.col("taken") / F.greatest(F.col("size"), F.lit(1))) + 0.5).cast("int").alias("times"))
    # The document goes as one column, so none of its own clashes with these.
    keyed = docs.select(F.struct("*").alias("d"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    on = F.expr("k.d.doc_id <=> t.doc_id and k.d.source <=> t.source and k.size = t.size")
    return keyed.alias("k").join(times.where("times > 0").alias("t"), on).select("k.d", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("d.*")


#: DuckDB's version of ``mix`` over ``documents``.
ORACLE = rf"""
with d as (
  select doc_id, coalesce('s' || source, 't') as src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '-') || '|' || coalesce(text, '')) as place from documents),
s0 as (select src, sum(size)::bigint as source_size from d group by src),
s1 as (select *, (row_number() over (order by src) - 1) % 3 + 1 as weight, sum(source_size) over ()::bigint as total, {MOST} * source_size as cap from s0),
s2 as (select *, cap::double / weight as fills_at, sum(weight) over ()::bigint as all_weight from s1),
s3 as (select *, coalesce(sum(cap) over w, 0)::bigint as filled, all_weight - coalesce(sum(weight) over w, 0)::bigint as unfilled from s2
       window w as (order by fills_at, src rows between unbounded preceding and 1 preceding)),
s4 as (select *, (total - filled)::double / unfilled as own_level from s3),
lv as (select own_level as level from s4 where fills_at >= own_level order by fills_at, src limit 1),
s5 as (select s4.*, case when cap < level * weight then cap::double else level * weight end as target from s4, lv),
s6 as (select *, floor(target)::bigint as whole from s5),
s7 as (select *, sum(whole) over (order by src)::bigint as sum_to, greatest(sum(whole) over (), 1)::bigint as all_whole from s6),
goal as (select src, source_size, target, total, greatest(1, (total + {SLOTS} - 1) // {SLOTS})::bigint as block,
         floor((sum_to - whole)::double / all_whole::double * {ROUND}.0::double)::bigint as low, floor(sum_to::double / all_whole::double * {ROUND}.0::double)::bigint as high from s7),
g2 as (select *, block > 1 and blocks < {LEAST} as by_words, floor(target)::bigint // greatest(source_size, 1) as rounds, floor(target)::bigint % greatest(source_size, 1) as rest
       from (select *, (source_size + block - 1) // block as blocks from goal)),
slots as (select i as slot, (i * {GOLDEN}) % {ROUND} as u from (select unnest(range((select coalesce(max(total // block), 0) from goal))) as i)),
given as (select slot, src, row_number() over (partition by src order by slot) - 1 as rnk, blocks from slots join g2 on u >= low and u < high and not by_words),
uses as (select src, rnk % blocks as b, count(*) as uses from given where rnk < {MOST} * blocks group by 1, 2),
laid as (select d.doc_id, d.src, d.size, block, by_words, rounds, rest, (sum(size) over (partition by d.src order by place, doc_id, size rows between unbounded preceding and current row) - size)::bigint as start
         from d join g2 on d.src = g2.src),
touched as (select *, unnest(range(start // block, (start + size - 1) // block + 1)) as b from laid where size > 0 and not by_words),
taken as (select t.src, doc_id, size, start, sum((least(start + size, (t.b + 1) * block) - greatest(start, t.b * block)) * coalesce(uses, 0))::bigint as taken
          from touched t left join uses u on t.src = u.src and t.b = u.b group by 1, 2, 3, 4),
every as (select * from taken union all select src, doc_id, size, start, case when by_words then rounds * size + greatest(least(start + size, rest) - start, 0) else 0 end from laid where size = 0 or by_words)
select doc_id, size, source_size, target, taken, case when e.src <> 't' then substr(e.src, 2) end as source from every e join goal on e.src = goal.src
"""
