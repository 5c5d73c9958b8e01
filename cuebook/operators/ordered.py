"""Windows over the rows of a key in order, however many rows a key has.

Keys of up to `most` rows take Spark's own window. Rows of larger keys are dealt into ranges of key and order and written once; a window runs within each range, one carry row
for each key and range is scanned over the key, and a second pass puts the carry of the earlier (or the next) ranges in. So no task holds all rows of a key."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuebook.sources.scratch import written

MOST = 1_000_000
_CHUNK, _UP = "_chunk", Window.unboundedPreceding


@dataclass(frozen=True)
class Scan:
    """kind: what of col, and of which rows of the key in order, a row gets."""

    kind: str
    col: Column


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def place() -> Scan:
    """The row's place, from 1."""
    return Scan("place", F.lit(1))


def total(c) -> Scan:
    """The sum up to the row, itself included."""
    return Scan("total", _col(c))


def total_before(c) -> Scan:
    """The sum of the earlier rows; 0 for the first."""
    return Scan("total_before", _col(c))


def top_before(c) -> Scan:
    """The greatest of the earlier rows; null for the first."""
    return Scan("top_before", _col(c))


def previous(c) -> Scan:
    """The value of the row before."""
    return Scan("previous", _col(c))


def following(c) -> Scan:
    """The value of the row after."""
    return Scan("following", _col(c))


def latest(c) -> Scan:
    """The last value up to the row, itself included, that isn't null."""
    return Scan("latest", _col(c))


def _window(s: Scan, w) -> Column:
    upto, before = w.rowsBetween(_UP, 0), w.rowsBetween(_UP, -1)
    return {
        "place": lambda: F.row_number().over(w).cast("long"),
        "total": lambda: F.sum(s.col).over(upto),
        "total_before": lambda: F.coalesce(F.sum(s.col).over(before), F.lit(0)),
        "top_before": lambda: F.max(s.col).over(before),
        "previous": lambda: F.lag(s.col).over(w),
        "following": lambda: F.lead(s.col).over(w),
        "latest": lambda: F.last(s.col, ignorenulls=True).over(upto),
    }[s.kind]()


def _carry(s: Scan, order: Column) -> Column:
    """What a range hands on: in a struct, so that a null value isn't taken for none."""
    return {
        "place": lambda: F.struct(F.count("*").alias("x")),
        "total": lambda: F.struct(F.sum(s.col).alias("x")),
        "total_before": lambda: F.struct(F.sum(s.col).alias("x")),
        "top_before": lambda: F.struct(F.max(s.col).alias("x")),
        "previous": lambda: F.max_by(F.struct(s.col.alias("x")), order),
        "following": lambda: F.min_by(F.struct(s.col.alias("x")), order),
        "latest": lambda: F.struct(F.max_by(s.col, F.when(s.col.isNotNull(), order)).alias("x")),
    }[s.kind]()


def _carried(s: Scan, name: str, w) -> Column:
    x, before = F.col(name)["x"], w.rowsBetween(_UP, -1)
    if s.kind in ("place", "total", "total_before"):
        return F.sum(x).over(before)
    if s.kind == "top_before":
        return F.max(x).over(before)
    if s.kind == "latest":
        return F.last(x, ignorenulls=True).over(before)
    return (F.lag(x) if s.kind == "previous" else F.lead(x)).over(w)


def _both(s: Scan, here: Column, carry: Column, edge: Column) -> Column:
    if s.kind in ("place", "total_before"):
        return here + F.coalesce(carry, F.lit(0))
    if s.kind == "total":
        return F.when(here.isNull(), carry).otherwise(here + F.coalesce(carry, F.lit(0)))
    if s.kind == "top_before":
        return F.greatest(here, carry)
    if s.kind == "latest":
        return F.coalesce(here, carry)
    return F.when(edge, carry).otherwise(here)


class Ordered:
    """rows of keys in the ascending order of columns, nulls first; rows that tie may change places, as in any window. most: rows of a key that one task may order."""

    def __init__(self, rows: DataFrame, key: str | list[str], order: list, most: int = MOST):
        self.key, self.order = [key] if isinstance(key, str) else list(key), [_col(o) for o in order]
        large = rows.groupBy(*self.key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
        counts = large.collect()  # keys of over `most` rows: at most one for each `most` rows of the table
        self.small, self.large = rows, None
        if counts:
            keys = F.broadcast(rows.sparkSession.createDataFrame(counts, large.schema).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)]))
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)])
            self.small = rows.join(keys, same, "left_anti")
            ranges = rows.join(keys, same, "left_semi").repartitionByRange(math.ceil(2 * sum(r["_rows"] for r in counts) / most), *self.key, *self.order)
            self.large = written(ranges.withColumn(_CHUNK, F.spark_partition_id()))

    def _each(self, small, large=None) -> Ordered:
        out = object.__new__(Ordered)
        out.key, out.order = self.key, self.order
        out.small, out.large = small(self.small), None if self.large is None else (large or small)(self.large)
        return out

    def with_column(self, name: str, value: Column) -> Ordered:
        """A column of the row alone."""
        return self._each(lambda d: d.withColumn(name, value))

    def scan(self, **scans: Scan) -> Ordered:
        """With a column for each scan."""
        whole = Window.partitionBy(*self.key).orderBy(*self.order)
        return self._each(lambda d: d.withColumns({n: _window(s, whole) for n, s in scans.items()}), lambda d: self._in_ranges(d, scans))

    def _in_ranges(self, d: DataFrame, scans: dict[str, Scan]) -> DataFrame:
        here = Window.partitionBy(*self.key, _CHUNK).orderBy(*self.order)
        carry = d.groupBy(*self.key, _CHUNK).agg(*[_carry(s, F.struct(*self.order)).alias(n) for n, s in scans.items()])
        ranges = Window.partitionBy(*self.key).orderBy(_CHUNK)
        carry = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)], F.col(_CHUNK).alias("_c"), *[_carried(s, n, ranges).alias(f"_carry_{n}") for n, s in scans.items()])
        edges = {"_first": F.row_number().over(here) == 1, "_last": F.lead(F.lit(1)).over(here).isNull()}
        d = d.withColumns({f"_here_{n}": _window(s, here) for n, s in scans.items()} | edges)
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.key)]
        d = d.join(carry, reduce(lambda a, b: a & b, same, F.col(_CHUNK) == F.col("_c")))
        d = d.withColumns({n: _both(s, F.col(f"_here_{n}"), F.col(f"_carry_{n}"), F.col("_last" if s.kind == "following" else "_first")) for n, s in scans.items()})
        return d.drop("_c", "_first", "_last", *[f"_k{i}" for i in range(len(self.key))], *[f"_{x}_{n}" for n in scans for x in ("here", "carry")])

    def rows(self) -> DataFrame:
        return self.small if self.large is None else self.small.unionByName(self.large.drop(_CHUNK))
