"""A table kept as a log of changes: appends only, the newest state by key on reading, and compaction of the buckets that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN = "_version long, _order long, _set array<string>, _gone boolean, _base boolean, _bucket int"


class ChangeLog:
    """Rows by key under one folder, in buckets of the key's hash, a partition folder each.

    A change is a whole row (insert or upsert), some columns of a row (update; of a key that isn't there it changes nothing), or a deletion. Later versions win, and within a version
    the greater order. Nothing is rewritten until compact(), which reads and replaces the buckets with changes since the last one and leaves the other files as they are.
    Null keys aren't kept. A frame read before a compaction isn't valid after it. One writer at a time; a compaction that is cut off is repeated from the start."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType | str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        empty = spark.createDataFrame([], schema)
        self.columns, self.schema = empty.columns, spark.createDataFrame([], f"{empty._jdf.schema().toDDL()}, {_OWN}").schema

    def _append(self, rows: DataFrame, version: int, order: Column | None, names: list[str] | None, gone: bool) -> None:
        kinds = {f.name: f.dataType for f in self.schema}
        given = [F.col(c).cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns]
        own = {"_version": F.lit(version).cast("long"), "_order": (order if order is not None else F.lit(0)).cast("long"), "_set": F.array(*map(F.lit, names)) if names is not None else F.lit(None).cast("array<string>"), "_gone": F.lit(gone), "_base": F.lit(False), "_bucket": F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")}
        out = rows.where(F.col(self.key).isNotNull()).select(*given, *[c.alias(n) for n, c in own.items()])
        out.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(self.folder)

    def put(self, rows: DataFrame, version: int, order: Column | None = None) -> None:
        """Insert or replace whole rows."""
        self._append(rows, version, order, None, False)

    def update(self, rows: DataFrame, version: int, order: Column | None = None) -> None:
        """Set the columns that rows has, null too, in the rows of its keys."""
        self._append(rows, version, order, [c for c in rows.columns if c != self.key], False)

    def delete(self, keys: DataFrame, version: int, order: Column | None = None) -> None:
        self._append(keys.select(self.key), version, order, None, True)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def _folded(self, log: DataFrame) -> DataFrame:
        """One row a key that is there: each column's newest value; a partial aggregate before the one shuffle."""
        at = F.struct("_version", "_order")
        whole = F.col("_set").isNull() & ~F.col("_gone")
        newest = [F.max_by(c, F.when(~F.col("_gone") & (F.col("_set").isNull() | F.array_contains("_set", c)), at)).alias(c) for c in self.columns if c != self.key]
        marks = [F.max(F.when(whole, at)).alias("_put"), F.max(F.when(F.col("_gone"), at)).alias("_taken"), F.max(at).alias("_at"), F.first("_bucket").alias("_bucket")]
        return log.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*newest, *marks).where("_put is not null and (_taken is null or _taken < _put)")

    def current(self) -> DataFrame:
        return self._folded(self.changes()).select(*self.columns)

    def touched(self) -> list[int]:
        """Buckets with changes since they were compacted."""
        return sorted(r[0] for r in self.changes().where("not _base").select("_bucket").distinct().collect())

    def compact(self) -> list[int]:
        """Replace each touched bucket by its current rows; the buckets. A mark without a key keeps a bucket that lost all its rows from being left as it was."""
        buckets = self.touched()
        if not buckets:
            return []
        log = self.changes().where(F.col("_bucket").isin(buckets))
        kept = self._folded(log).select(*self.columns, F.col("_at._version").alias("_version"), F.col("_at._order").alias("_order"), F.lit(None).cast("array<string>").alias("_set"), F.lit(False).alias("_gone"), F.lit(True).alias("_base"), "_bucket")
        marks = self.spark.range(1).select(F.explode(F.array(*map(F.lit, buckets))).alias("_bucket"), F.lit(True).alias("_gone"), F.lit(True).alias("_base"))
        out = kept.unionByName(marks, allowMissingColumns=True).repartition("_bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.folder)
        return buckets
