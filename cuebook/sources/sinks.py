"""Writers: appended rows, audit records, texts by format and status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuebook.functions.scalars import folder_name, stem
from cuebook.sources.files import Channel, write_documents


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Rows appended under one folder, columns that came later filled with null in older rows."""
    return spark.read.option("mergeSchema", "true").parquet(folder)


def record(operations: DataFrame, folder: str) -> None:
    """Append operations (task_id, operation, and columns of their own, as one JSON text) to the audit log of a folder, in a folder for each task as the task's files have one;
    nothing is read or rewritten. Null ids are one task."""
    rest = [c for c in operations.columns if c not in ("task_id", "operation")]
    task = F.coalesce(F.col("task_id").cast("string"), F.lit(""))
    out = operations.select("task_id", "operation", F.to_json(F.struct(*rest)).alias("details"), F.current_timestamp().alias("recorded_at"), folder_name(F.lit("task"), task).alias("task_folder"))
    out.write.mode("append").partitionBy("task_folder").json(folder)


def manifest(spark: SparkSession, folder: str, task_id: str) -> DataFrame:
    """The operations recorded for a task, oldest first; only the task's own folder is read."""
    held = spark.read.schema("task_id string, operation string, details string, recorded_at timestamp, task_folder string").json(folder)
    own = spark.range(1).select(folder_name(F.lit("task"), F.lit(str(task_id))).alias("f")).first().f
    return held.where((F.col("task_folder") == own) & (F.col("task_id") == str(task_id))).orderBy("recorded_at").drop("task_folder")


def texts(documents: DataFrame, folder: str, name: str = "name", fmt: str = "fmt", text: str = "text") -> None:
    """Each document's text as a file of its own, in a folder for each format: fmt/name.fmt. Names of a format must differ."""
    named = documents.withColumn("_name", F.concat(F.col(fmt), F.lit("/"), F.col(name), F.lit("."), F.col(fmt)))
    write_documents(named, folder, "_name", text)


def bundle(log: DataFrame, folder: str, fmt: str) -> None:
    """texts() of the completed rows of a log with a transcript, in one format, rebuilt from the timed text; file names that several rows share are numbered by task_id."""
    from cuebook.operators.names import unique_names
    from cuebook.operators.queue import downloadable
    from cuebook.operators.timeline import converted

    done = converted(downloadable(log, F.lit(fmt), "transcript"), "transcript").withColumn("text", F.col(fmt.lower())).where("text <> ''")
    named = done.select("task_id", "text", F.concat(stem(F.col("filename")), F.lit(f".{fmt.lower()}")).alias("file"))
    write_documents(unique_names(named, "file", "task_id"), folder, "stored_name")


def publish(events: DataFrame, folder: str, checkpoint: str):
    """Streaming sink of status events: one JSON text an event under folder, exactly once; the query, started."""
    out = events.select(F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_to(events: DataFrame, channel: str, checkpoint: str):
    """Streaming sink of status events to a channel: one JSON message an event; the query, started."""
    events.sparkSession.dataSource.register(Channel)
    out = events.select(F.to_json(F.struct("*")).alias("message"))
    return out.writeStream.format("cuebook_channel").option("path", channel).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
