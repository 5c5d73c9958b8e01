"""Operator 8: mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix takes the i-th golden-ratio point and gives it to the source whose share of the cumulative targets holds it. A source's documents,
shuffled by hash, lie on a line of words cut into blocks of equal length. Slots are ranked within their source, and the source's r-th slot is joined with
block r, from the first again after the last, until the source's target is reached to the word. mixed() gives these pieces of documents in slots; mix() sums them by document. Only DataFrame functions are used."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuebook.llm.common import BROADCAST_ROWS, Scratch, cut

#: Weights by position of the source.
WEIGHTS = (3, 1, 2)
#: Words of a block.
BLOCK = 64
#: The golden ratio's fraction of 2^31, odd, so that any 2^31 slots in turn meet every point once; whole numbers stay exact at any slot.
GOLDEN, POINTS = 1327217885, 1 << 31
CELLS = 4096
#: A source's line is ordered by hash; its parts, each summed in a task of its own, are the hashes that share so many hexadecimal digits.
PART_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size long) with target double: sources by code point, null last, share budget times all words by weight;
    a target stops at most times its source's size and the excess is shared again until none is above.

    In closed form: sources fill up in the order of size over weight; those before the level where the rest fits stop at their cap."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    t = t.withColumn("left", F.sum("source_size").over(every) * F.lit(budget) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("w_left"))
    # the first source whose cap lies above its level sets the level of all later ones
    final = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)["level"]
    return t.select("source", "source_size", F.when(F.col("ratio") <= F.coalesce(final, F.lit(float("inf"))), F.col("cap")).otherwise(final * F.col("w")).alias("target"))


def schedule(quota: DataFrame, block: int) -> DataFrame:
    """(slot, source): the golden-ratio point of each slot mapped through the cumulative targets. quota has source and target."""
    spark = quota.sparkSession
    total = quota.agg(F.sum("target")).first()[0] or 0.0
    n = math.ceil(total / block)
    run = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    hi = F.sum("target").over(run) / F.lit(total or 1.0)
    bounds = quota.where("target > 0").withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(run), F.lit(0.0)))
    last = Window.partitionBy(F.lit(1))
    bounds = bounds.withColumn("hi", F.when(F.col("hi") == F.max("hi").over(last), F.lit(2.0)).otherwise(F.col("hi")))
    cells = bounds.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    point = (F.col("slot") % POINTS * GOLDEN % POINTS) / float(POINTS)
    slots = spark.range(1, n + 1).select(F.col("id").alias("slot")).withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    return slots.join(cells, "cell").where("x >= lo and x < hi").select("slot", "source")


def ranked(slots: DataFrame) -> DataFrame:
    """schedule() with rank, the slot's place (from 0) among its source's; counted in chunks, so that no source is ranked in one task."""
    s = slots.withColumn("chunk", F.floor(F.col("slot") / 8192))
    before = s.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    here = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    b = before.select(F.col("source").alias("s2"), F.col("chunk").alias("c2"), "before")
    return s.withColumn("here", here).join(b, F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))).select("slot", "source", (F.col("here") + F.col("before")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights=WEIGHTS) -> DataFrame:
    """docs' rows as doc_id, size, source_size, target, taken, source.

    size counts runs of anything but ASCII white space (null: 0). taken, the words of the row in the mix, repeats counted, is at most 2 * size; a source's taken words are its target, rounded. Null sources are one
    source. Empty documents take 0; an empty table gives no rows. Repeated rows and null ids keep their rows, each with its own place on the line; rows alike in
    id, source and size may change places. Other columns are ignored."""
    keep = Scratch(docs.sparkSession)
    d, plan = laid(docs, id_col, text, source, block, weights, keep)
    taken = cut(pieces(d, plan, block, keep).groupBy("row").agg(F.sum("words").alias("taken")))
    keep.free()
    return d.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, weights=WEIGHTS) -> DataFrame:
    """The mix itself, one row for each piece of a document in a slot: slot, source, block, place, doc_id, at, words. Ordered by slot and place it is the mix in schedule
    order; place is the piece's first word in the block, at in the document. Rows of docs are treated as in mix(). The slots stay in the shared folder, as the result reads them."""
    keep = Scratch(docs.sparkSession)
    d, plan = laid(docs, id_col, text, source, block, weights, keep)
    return pieces(d, plan, block, keep).drop("row")


def owed(d: DataFrame) -> DataFrame:
    """(s, whole, words): size and words to take of each source with words, its target rounded."""
    return d.where("size > 0").groupBy("source").agg(F.first("source_size").alias("whole"), F.floor(F.first("target") + 0.5).alias("words")).select(F.col("source").alias("s"), "whole", "words")


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def turned(d: DataFrame, plan: DataFrame, block: int, keep: Scratch) -> DataFrame:
    """(slot, s, b, upto): the slots that a source needs for its words, with their block and the word of the line that they may reach. Slots beyond go; what a source with too few
    slots still owes follows in closing slots at the end of the schedule, a few for each source, as the schedule's discrepancy is small.

    Slots and the tables by source are written first: read several times in one plan, they would each be planned, compiled and run again, all of it in the driver's memory at once."""
    n, rest = F.ceil(F.col("whole") / block), F.col("words") % F.col("whole")
    need = small(keep.cut(owed(d).withColumn("n", n).withColumn("need", F.floor(F.col("words") / F.col("whole")) * n + F.ceil(rest / block))))
    slots = keep.cut(ranked(plan))
    same = F.col("source").eqNullSafe(F.col("s"))
    held = slots.join(need, same).where("rank < need")
    have = keep.cut(slots.groupBy("source").agg(F.count("*").alias("m"), F.max("slot").alias("last")))
    short = need.join(small(have.drop("last")), same, "left").withColumn("m", F.coalesce("m", F.lit(0))).where("m < need")
    end = have.agg(F.coalesce(F.max("last"), F.lit(0)).alias("end"))
    closing = short.select("s", "whole", "words", "n", "need", "m", F.explode(F.expr("sequence(m, need - 1)")).alias("rank"))
    place = F.row_number().over(Window.orderBy(F.col("rank") - F.col("m"), F.col("s").isNull(), F.encode("s", "UTF-8")))
    closing = closing.withColumn("slot", place + end.scalar())
    both = held.select("slot", "s", "rank", "n", "whole", "words").unionByName(closing.select("slot", "s", "rank", "n", "whole", "words"))
    return both.select("slot", "s", (F.col("rank") % F.col("n")).alias("b"), (F.col("words") - F.floor(F.col("rank") / F.col("n")) * F.col("whole")).alias("upto"))


def pieces(d: DataFrame, plan: DataFrame, block: int, keep: Scratch) -> DataFrame:
    """The slots joined with the pieces of documents in their blocks, the last one cut to what its source owes; a block is taken twice at most."""
    first, last = F.floor(F.col("a") / block), F.floor((F.col("a") + F.col("size") - 1) / block)
    parts = d.where("size > 0").select("row", "doc_id", "source", "a", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest("a", F.col("block") * block), F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block)
    parts = parts.select("row", "doc_id", "source", "block", (lo - F.col("block") * block).alias("place"), (lo - F.col("a")).alias("at"), lo.alias("lo"), hi.alias("hi"))
    met = turned(d, plan, block, keep).join(parts, F.col("s").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block"))).where("lo < upto")
    return met.select("row", "slot", "source", "block", "place", "doc_id", "at", (F.least("hi", "upto") - F.col("lo")).alias("words"))


def laid(docs: DataFrame, id_col: str, text: str, source: str, block: int, weights, keep: Scratch):
    """(documents on the lines of their sources, with first word a and the source's size and target; schedule)."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    d = d.withColumn("row", F.monotonically_increasing_id())
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string"))), F.lit(":mix")))  # null ids don't meet in one part
    d = cut(d.withColumn("h", h).withColumn("part", F.substring("h", 1, PART_DIGITS)))
    sums = keep.cut(d.groupBy("source", "part").agg(F.sum("size").alias("n")))
    quota = keep.cut(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights))
    q = quota.withColumnRenamed("source", "qs")
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.select(F.col("source").alias("s"), F.col("part").alias("p"), "start").join(q, F.col("s").eqNullSafe(F.col("qs"))).drop("qs")
    line = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(line), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return cut(d.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("start") + F.col("inner")).alias("a"))), schedule(quota, block)
