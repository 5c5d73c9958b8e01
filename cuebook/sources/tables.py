"""Table reader and the adapters that give driver tables their task-log roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders in the role of the task log. is_batch is null for a third of the rows; costs go below a cent."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED")
    return o.select(
        key.alias("task_id"),
        F.col("o_orderdate").alias("requested_at"),
        F.when(status != "PROCESSING", F.col("o_orderdate") + F.expr("INTERVAL 90 SECONDS")).alias("completed_at"),
        status.alias("status"),
        (F.col("o_totalprice") / 1e5).alias("cost"),
        F.floor("o_totalprice").cast("long").alias("tokens"),
        (key % 4000 / 8).alias("duration"),
        F.when(status != "PROCESSING", key % 50 + 0.25).alias("processing"),
        F.col("o_orderpriority").alias("model"),
        F.col("o_custkey").alias("batch_id"),
        F.when(F.col("o_custkey") % 3 < 2, F.col("o_custkey") % 3 == 0).alias("is_batch"),
        F.concat(F.lit("audio_"), key.cast("string"), F.lit(".mp3")).alias("filename"),
        F.concat(F.lit("Talk "), F.col("o_custkey").cast("string"), F.lit("%")).alias("title"),
        F.when(key % 5 > 0, F.concat(F.lit("s-"), (F.col("o_custkey") % 100).cast("string"))).alias("session_id"),
        F.concat(F.lit("f"), key.cast("string")).alias("file_uid"),
        F.when(key % 2 == 0, F.concat(F.lit("[00:01.00] "), "o_orderpriority")).alias("lrc_content"),
        F.when(key % 4 == 0, "Google").when(key % 4 == 1, "OpenAI").alias("provider"),
        F.when(key % 3 > 0, "ja-JP").alias("source_language"),
        F.when(key % 6 == 1, "zh-TW").alias("target_language"),
        F.when(status == "FAILED", F.concat(F.lit("code "), (key % 5 + 500).cast("string"))).alias("error_message"),
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations in the role of timed subtitle lines; times in centiseconds and, for texts, in milliseconds."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("file_id"),
        F.col("turn").alias("line_no"),
        (F.col("turn") * 725 + (F.col("conv_id") % 10) * 10).alias("start_cs"),
        (F.col("turn") * 7250 + F.col("conv_id") % 10 * 101).alias("start_ms"),
        F.regexp_replace("text", r"[\r\n]+", " ").alias("text"),
        F.col("role").alias("speaker"),
    )


def lyrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as one timed text a file: lines with speaker labels, two or three digits of a second's fraction, and lines without a time."""
    c = cues(spark, sf_dir)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    ms = F.col("start_ms")
    fraction = F.when(F.col("line_no") % 2 == 0, F.lpad((ms % 1000).cast("string"), 3, "0")).otherwise(two(F.floor(ms % 1000 / 10)))
    stamp = F.concat(F.lit("["), two(F.floor(ms / 60000)), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), fraction, F.lit("]"))
    line = F.when(F.col("line_no") % 5 == 4, F.concat(F.lit("note "), "text")).otherwise(F.concat(stamp, F.when(F.col("line_no") % 2 == 0, " Speaker A: ").otherwise(" "), F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("line_no", line.alias("s"))))
    return c.groupBy("file_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("lrc"))
