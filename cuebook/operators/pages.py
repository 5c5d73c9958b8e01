"""Pages far down a newest-first list: by counts of times, by ranges written in the list's order, or by the last row seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

#: Spans of time whose rows are counted, each within the ones before.
SPANS = ("year", "day", "hour", "minute", "second", "millisecond")
#: Rows that may be sorted past for a page.
NEAR = 10_000
#: Rows of a file of a written list, at least, and the name of the column with a row's place in its file.
FILE_ROWS, AT = 250_000, "_place in file"


def newest_first(time: str = "requested_at", key: str = "task_id") -> list[Column]:
    return [F.col(time).desc_nulls_first(), F.col(key).desc()]


def deep(log: DataFrame, skip: int, size: int, near: int = NEAR, time: str = "requested_at", key: str = "task_id") -> DataFrame:
    """Rows skip + 1 to skip + size of the newest-first list (null times first, ties by key).

    Rows are counted by year, then by day within the years that the page touches, and so on until at most `near` rows are left to sort past; only these spans are then read. A round
    counts a thousand spans or so, whatever the table's size. Rows of one millisecond aren't told apart; more than `near` of them are sorted."""
    rows = log
    for span in SPANS:
        if skip + size <= near:
            break
        cell = F.date_trunc(span, F.col(time).cast("timestamp")).alias("cell")
        counts = rows.groupBy(cell).agg(F.count("*").alias("n"), F.min(time).alias("low"), F.max(time).alias("high")).collect()
        counts.sort(key=lambda r: (r.cell is not None, -r.cell.timestamp() if r.cell is not None else 0))
        upto, held = 0, []
        for r in counts:
            if upto + r.n > skip and upto < skip + size:
                held.append((r, upto))
            upto += r.n
        if not held:
            return rows.where("false")
        skip -= held[0][1]
        times = [r for r, _ in held if r.cell is not None]
        inside = F.lit(False) if not times else F.col(time).between(F.lit(min(r.low for r in times)), F.lit(max(r.high for r in times)))
        rows = rows.where(inside | F.col(time).isNull()) if any(r.cell is None for r, _ in held) else rows.where(inside)
    return rows.orderBy(*newest_first(time, key)).offset(skip).limit(size)


def after(log: DataFrame, last_time, last_key, size: int, time: str = "requested_at", key: str = "task_id") -> DataFrame:
    """The size rows that follow the row of a time (None: null) and key in the newest-first list: sought, not counted."""
    at, k = F.col(time), F.col(key) < F.lit(last_key)
    rest = at.isNotNull() | k if last_time is None else (at < F.lit(last_time)) | ((at == F.lit(last_time)) & k)
    return log.where(rest).orderBy(*newest_first(time, key)).limit(size)


class Pages:
    """A list written once in its order, in files of FILE_ROWS rows or so, for many pages: each reads the files that hold it, and of these, by the place of their rows, the Parquet pages
    of rows_a_part rows that hold it. So small ranges don't make as many files."""

    def __init__(self, spark: SparkSession, folder: str, time: str = "requested_at", key: str = "task_id"):
        self.spark, self.folder, self.time, self.key = spark, folder, time, key

    def write(self, log: DataFrame, rows_a_part: int = 100_000) -> None:
        order = newest_first(self.time, self.key)
        parts = max(1, -(-log.count() // max(FILE_ROWS, rows_a_part)))
        d = log.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order)
        d = d.withColumn(AT, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))  # the row's place in its partition
        log.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        d.write.mode("overwrite").option("parquet.page.row.count.limit", rows_a_part).partitionBy("part").parquet(f"{self.folder}/rows")
        self._rows().groupBy("part").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/counts")

    def _rows(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        return self.spark.read.schema(schema.add(AT, LongType()).add("part", IntegerType())).parquet(f"{self.folder}/rows")

    def page(self, number: int, size: int) -> DataFrame:
        """Page number (from 1) of size rows; none beyond the end."""
        skip = (max(1, number) - 1) * size
        counts = self.spark.read.parquet(f"{self.folder}/counts")
        upto = F.expr("sum(n) over (order by part)")
        held = counts.withColumn("upto", upto).where((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + size)).orderBy("part").collect()
        if not held:
            return self._rows().where("false").drop("part", AT)
        low = skip - (held[0].upto - held[0].n)
        rows = self._rows().where(F.col("part").isin([r.part for r in held]))
        rows = rows.where(F.col(AT).between(low, low + size - 1)) if len(held) == 1 else rows.where((F.col("part") > held[0].part) | (F.col(AT) >= low))
        rows = rows.drop("part", AT).orderBy(*newest_first(self.time, self.key))
        return rows.limit(size)
