"""Free names for uploads: the first free stem(k).ext, where names that are asked for as they stand claim numbers too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.operators.ordered import MOST, Ordered, place, total_before
from cuebook.sources.scratch import written

#: A name with its extension apart; a dot in front begins none.
SPLIT = r"(?s)^(.+?)(\.[^.]+)?$"
#: A stem that holds a number as the counter writes it.
NUMBERED = r"(?s)^(.+)\(([1-9][0-9]{0,17})\)$"


def parts(name: Column) -> tuple[Column, Column]:
    return F.regexp_extract(name, SPLIT, 1), F.regexp_extract(name, SPLIT, 2)


def depth(stem: Column) -> Column:
    """How many numbers stand at a stem's end, one after the other."""
    tail = F.regexp_extract(stem, r"(?s)^.+?((?:\([1-9][0-9]{0,17}\))+)$", 1)
    return F.length(tail) - F.length(F.replace(tail, F.lit("("), F.lit("")))


def _claims(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of claims by base and number: a claim holds if fewer counted uploads came before it than numbers below it are free for them."""
    base, held = None, 0
    for b in batches:
        ok = []
        for name, k, earlier in zip(b["base"], b["k"], b["earlier"], strict=True):
            if name != base:
                base, held = name, 0
            ok.append(earlier < k - held)
            held += ok[-1]
        yield pd.DataFrame({"base": b["base"], "k": b["k"], "ok": ok})


def unique_names(files: DataFrame, name: str, order: str, most: int = MOST) -> DataFrame:
    """files with stored_name: in the order of uploads, the name itself if it is free, else stem(k).ext with the first k for which that is free. order must differ.

    A name such as a(1).mp3 that is asked for as it stands takes number 1 of a.mp3, if no earlier upload of a.mp3 was given it; else it is counted itself, as a(1)(k).mp3.
    So names are settled by how many numbers end them, the fewest first. Of one name the i-th counted upload gets the i-th number that no claim holds. Uploads of one name are
    placed in ranges; only its contested claims, a few numbers each, pass one task in order, and none of them is kept. Null names stay null."""
    stem, ext = parts(F.col(name))
    d = files.withColumn("_stem", stem).withColumn("_ext", ext).withColumn("_depth", depth(F.col("_stem")))
    d = d.withColumn("_base", F.when(F.col("_depth") > 0, F.concat(F.regexp_extract("_stem", NUMBERED, 1), "_ext"))).withColumn("_k", F.when(F.col("_depth") > 0, F.regexp_extract("_stem", NUMBERED, 2).cast("long")))
    d = written(Ordered(d, name, [order], most).scan(_place=place()).rows())
    deepest = d.agg(F.max("_depth")).first()[0] or 0
    out, lost = None, None  # lost: names that were given to another before they were first asked for
    for level in range(deepest + 1):
        here = d.where(F.col("_depth") == level) if level else d.where(F.coalesce("_depth", F.lit(0)) == 0)
        if lost is not None:
            here = here.join(lost, here[name] == F.col("_lost"), "left").withColumn("_i", F.col("_place") - F.when(F.col("_lost").isNull(), 1).otherwise(0)).drop("_lost")
        else:
            here = here.withColumn("_i", F.col("_place") - 1)
        lost = None
        if level < deepest:
            here, lost = _settled(here, d.where((F.col("_depth") == level + 1) & (F.col("_place") == 1)), name, order, most)
        else:
            here = here.withColumn("_number", F.col("_i"))
        out = here if out is None else out.unionByName(here)
    stored = F.when(F.col("_i") == 0, F.col(name)).otherwise(F.concat("_stem", F.lit("("), F.col("_number").cast("string"), F.lit(")"), "_ext"))
    return out.withColumn("stored_name", stored).select(*files.columns, "stored_name")


def _settled(here: DataFrame, asked: DataFrame, name: str, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """here, uploads with _i (0: under their own name), with _number; and the names, claimed by asked, that they take away."""
    counted = here.where("_i > 0").select(F.col(name).alias("base"), F.col(order).alias("at"), "_i")
    bases = counted.groupBy("base").agg(F.count("*").alias("_n"))
    claims = asked.select(F.col("_base").alias("base"), F.col(order).alias("at"), "_k")
    many = claims.groupBy("base").agg(F.count("*").alias("_c"))
    claims = claims.join(bases.join(many, "base"), "base").where("_k <= _n + _c").select("base", "at", "_k")  # beyond, no counted upload comes
    both = claims.withColumn("_i", F.lit(None).cast("long")).unionByName(counted.join(claims.select("base").distinct(), "base", "left_semi"), allowMissingColumns=True)
    both = Ordered(both, "base", ["at"], most).scan(earlier=total_before(F.col("_i").isNotNull().cast("long"))).rows()
    one = both.where("_k is not null").select("base", F.col("_k").alias("k"), "earlier").repartition("base").sortWithinPartitions("base", "k")
    judged = written(one.mapInPandas(_claims, "base string, k long, ok boolean"))
    # the i-th number that is free: i and the claims k held with k less their place below i
    held = Ordered(judged.where("ok"), "base", ["k"], most).scan(nth=place()).rows().select("base", (F.col("k") - F.col("nth")).alias("value"), F.lit(1).alias("claim"))
    line = counted.select("base", F.col("_i").alias("value"), F.lit(0).alias("claim")).unionByName(held)
    free = Ordered(line, "base", ["value", "claim"], most).scan(passed=total_before("claim")).rows().where("claim = 0")
    free = free.select(F.col("base").alias("_b"), F.col("value").alias("_v"), (F.col("value") + F.col("passed")).alias("_number"))
    numbered = here.join(free, (F.col(name) == F.col("_b")) & (F.col("_i") == F.col("_v")), "left").drop("_b", "_v")
    stem, ext = parts(F.col("base"))
    return numbered, judged.where("not ok").select(F.concat(stem, F.lit("("), F.col("k").cast("string"), F.lit(")"), ext).alias("_lost"))
