"""Task-log operators: filters, paging, statistics, active view, latest state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cuebook.functions.scalars import half_even
from cuebook.operators import pages


def matching(log: DataFrame, status: str | None = None, is_batch: bool | None = None, since=None, until=None, keyword: str | None = None) -> DataFrame:
    """Rows that meet every given condition; a null column meets none. Empty texts are no condition. keyword is a pattern of file name or title, without case: %
    and _ are wildcards, and a backslash before one of them, or before itself, takes it literally."""
    out = log
    if status:
        out = out.where(F.col("status") == status)
    if is_batch is not None:
        out = out.where(F.col("is_batch") == is_batch)
    if since:
        out = out.where(F.col("requested_at") >= F.to_timestamp_ntz(F.lit(since)))
    if until:
        out = out.where(F.col("requested_at") <= F.to_timestamp_ntz(F.lit(until)))
    if keyword:
        safe = re.sub(r"\\(.?)", lambda m: m[0] if m[1] in ("%", "_", "\\") and m[1] else "\\\\" + m[1], keyword)
        out = out.where(F.col("filename").ilike(f"%{safe}%") | F.col("title").ilike(f"%{safe}%"))
    return out


def page(log: DataFrame, number: int, size: int, near: int = pages.NEAR) -> DataFrame:
    """One page (from 1) of 1 to 100 rows of the newest-first list; null times come first. At most `near` rows are sorted past; see pages.deep()."""
    number, size = max(1, number), min(100, max(1, size))
    return pages.deep(log, (number - 1) * size, size, near)


def page_counts(log: DataFrame, size: int) -> DataFrame:
    """total rows and pages, one page for no rows."""
    return log.agg(F.count("*").alias("total")).select("total", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("pages"))


def stats(log: DataFrame, *keys: str) -> DataFrame:
    """Counts, success rate over all rows, and sums over all rows; processing is the mean of completed rows. An empty table gives zeros. Rounded half even on the binary value."""
    done = F.col("status") == "COMPLETED"
    total, ok = F.count("*"), F.count(F.when(done, 1))
    aggs = [
        total.alias("total"),
        ok.alias("completed"),
        F.count(F.when(F.col("status") == "FAILED", 1)).alias("failed"),
        F.coalesce(half_even(ok / F.nullif(total, F.lit(0)) * 100, 1), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(half_even(F.sum(F.col("cost").cast("decimal(24,9)")).cast("double"), 6), F.lit(0.0)).alias("cost"),
        F.coalesce(half_even(F.sum("duration"), 1), F.lit(0.0)).alias("duration"),
        F.coalesce(half_even(F.avg(F.when(done, F.col("processing"))), 1), F.lit(0.0)).alias("processing"),
    ]
    return log.groupBy(*keys).agg(*aggs) if keys else log.agg(*aggs)


def active(log: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Single tasks in progress, and finished or failed ones asked for within the last hours (the bound included). A null is_batch is not single."""
    edge = F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return log.where(~F.col("is_batch") & ((F.col("status") == "PROCESSING") | (F.col("status").isin("COMPLETED", "FAILED") & (F.col("requested_at") >= edge))))


def archived(log: DataFrame, as_of: str, hours: int = 24, seen: Observation | None = None) -> DataFrame:
    """log with completed rows older than the given hours (strictly) set to RETRIEVED. seen gets n, their number, in the pass that reads the result."""
    old = (F.col("status") == "COMPLETED") & (F.col("requested_at") < F.to_timestamp_ntz(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return _set_where(log, old, "RETRIEVED", seen)


def with_status(log: DataFrame, key: str, value, status: str, seen: Observation | None = None) -> DataFrame:
    """log with the status of one key set. seen gets n, the rows that have the key."""
    return _set_where(log, F.col(key) == value, status, seen)


def _set_where(log: DataFrame, hit: Column, status: str, seen: Observation | None) -> DataFrame:
    log = log if seen is None else log.observe(seen, F.count(F.when(hit, 1)).alias("n"))
    return log.withColumn("status", F.when(hit, status).otherwise(F.col("status")))


def in_states(rows: DataFrame, states, column: str = "status") -> DataFrame:
    """Rows in one of the states."""
    return rows.where(F.col(column).isin(*states))


def lookup(log: DataFrame, key: str, value: str | None) -> DataFrame:
    """The row of a key given as text, one at most; text that isn't a key of this type finds nothing."""
    return log.where(F.col(key) == F.lit(value).try_cast(dict(log.dtypes)[key])).limit(1)


def response(log: DataFrame) -> DataFrame:
    """log's rows for a client: times as text, nulls kept, has_transcript for a transcript column that isn't null."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    plain = [c for c in log.columns if c not in ("requested_at", "completed_at", "lrc_content", "transcript")]
    return log.select(text("requested_at"), text("completed_at"), *plain, F.col("transcript").isNotNull().alias("has_transcript"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row per key: a partial aggregate before the shuffle, no sort."""
    rest = [c for c in rows.columns if c != key]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(key).agg(top).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without the given keys."""
    return rows.join(keys, key, "left_anti")


def share(log: DataFrame, key: str) -> DataFrame:
    """Rows and their share in percent per key."""
    n = log.groupBy(key).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def price(tokens: Column, rate: Column, discounted: Column) -> Column:
    """Cost of tokens at a rate per million, halved when discounted."""
    return tokens / F.lit(1e6) * rate * F.when(discounted, 0.5).otherwise(1.0)
