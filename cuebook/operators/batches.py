"""Batch jobs: transcripts kept as JSON, positional joins, registries, liveness and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.functions.labels import trimmed
from cuebook.operators.ordered import MOST, Ordered, place, previous

#: States of a batch and the changes between them.
LIVE = ("UPLOADING", "POLLING", "RECOVERING")
MOVES = {"UPLOADING": ("POLLING", "FAILED"), "POLLING": ("COMPLETED", "FAILED", "RECOVERING"), "RECOVERING": ("POLLING", "COMPLETED", "FAILED"), "COMPLETED": ("RETRIEVED",), "FAILED": ("RECOVERING",), "RETRIEVED": ()}


def transcripts(log: DataFrame, jobs: DataFrame, task: str = "task_id", batch: str = "batch_id") -> DataFrame:
    """log with transcript: its own lrc_content unless blank, else the text that its batch's JSON holds for it; null where there is none.

    jobs has batch_id, file_log_uuids_json (file to task) and results_json (file to result). Each job's maps are opened once, so that a batch of n files costs n
    rows and one equality join, not a search of the whole map for each of its n tasks. Broken JSON counts as absent."""
    files = F.from_json("file_log_uuids_json", "map<string, string>")
    results = F.from_json("results_json", "map<string, struct<transcripts: map<string, string>>>")
    each = jobs.select(F.col(batch).alias("_b"), results.alias("_r"), F.explode(files).alias("_file", "_task"))
    text = F.element_at(F.element_at("_r", F.col("_file"))["transcripts"], "lrc")
    held = each.select("_b", "_task", nonblank(text).alias("_text")).where("_text is not null").groupBy("_b", "_task").agg(F.min("_text").alias("_text"))
    own = nonblank(F.col("lrc_content")) if "lrc_content" in log.columns else F.lit(None).cast("string")
    met = log.join(held, (F.col(batch) == F.col("_b")) & (F.col(task).cast("string") == F.col("_task")), "left")
    return met.withColumn("transcript", F.coalesce(own, "_text")).drop("_b", "_task", "_text")


def nonblank(text: Column) -> Column:
    """The text without white space at its ends, or null where nothing is left."""
    return F.nullif(trimmed(text), F.lit(""))


def positional(left: DataFrame, right: DataFrame, key: str, left_order: str | Column, right_order: str | Column, most: int = MOST) -> DataFrame:
    """Rows of a key joined by their place in order; what the longer side has beyond the shorter goes."""
    at = lambda d, o: Ordered(d, key, [o], most).scan(place=place()).rows()
    return at(left, left_order).join(at(right, right_order), [key, "place"])


def registered(files: DataFrame, registry: DataFrame, file: str = "file_id") -> DataFrame:
    """files with the session of the newest registry entry that lists them, else null. registry: session_id, files (array), place (0 is newest)."""
    entry = registry.select(F.explode("files").alias(file), "session_id", "place").groupBy(file).agg(F.min_by("session_id", F.struct("place", "session_id")).alias("session_id"))
    return files.join(entry, file, "left")


def labelled(rows: DataFrame, labels: DataFrame, key: str, label: str, default: Column | None = None) -> DataFrame:
    """rows with the label of their key, or the default (the key itself) where the key isn't listed."""
    names = labels.groupBy(key).agg(F.min(label).alias(label))
    return rows.join(names, key, "left").withColumn(label, F.coalesce(label, default if default is not None else F.col(key).cast("string")))


def liveness(status: Column, known: Column, elapsed_s: Column, limit_s: int = 300) -> Column:
    """For live states what is known of the worker, false when nothing is known after limit_s, else null."""
    return F.when(status.isin(*LIVE), F.when(known.isNotNull(), known).when(elapsed_s > limit_s, F.lit(False)))


def task_rows(jobs: DataFrame, known: Column, as_of: Column) -> DataFrame:
    """jobs as tasks at a time: file_count (the number of files where it is 0 or null), is_alive, created_at and updated_at as text, elapsed seconds (null without a start), files
    (file_uid, original_filename) in the order of their numbers, and the session, which is the batch itself where none is named. Broken JSON names no files."""
    entries = F.map_entries(F.from_json("file_mapping_json", "map<string, struct<file_uid: string, original_filename: string>>"))
    placed = F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("file"))))
    files = F.transform(placed, lambda e: e["file"])
    count = F.coalesce(F.nullif("file_count", F.lit(0)), F.greatest(F.size(files), F.lit(0)))
    session = F.coalesce(F.nullif("session_id", F.lit("")), F.col("batch_id").cast("string"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    elapsed = (micros(as_of) - micros(F.col("created_at"))) / 1e6
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    alive = liveness(F.col("status"), known, F.nullif(elapsed, F.lit(0.0)))
    return jobs.select("batch_id", "status", count.alias("file_count"), alive.alias("is_alive"), text("created_at"), text("updated_at"), elapsed.alias("elapsed_seconds"), files.alias("files"), session.alias("session_id"))


def seeded(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """rows, or the seeds where there are no rows."""
    return rows.unionByName(seeds) if rows.isEmpty() else rows


def state_changes(events: DataFrame, key: str, order: list[str], status: str = "status", most: int = MOST) -> DataFrame:
    """events with before, the key's state until then, and valid: a first state, the same again, or a change that MOVES lists."""
    d = Ordered(events, key, order, most).scan(before=previous(status)).rows()
    allowed = F.lit(False)
    for state, nexts in MOVES.items():
        allowed = allowed | ((F.col("before") == state) & F.col(status).isin(*nexts)) if nexts else allowed
    return d.withColumn("valid", F.col("before").isNull() | (F.col("before") == F.col(status)) | allowed)


def session_tasks(batches: DataFrame, singles: DataFrame) -> DataFrame:
    """Batches (session_id, started_at, file_count, and files, an array) and single tasks (session_id, started_at) as one row per session: its kinds, files and
    earliest start. A file_count of 0 or null gives way to the number of files."""
    listed = F.greatest(F.size("files"), F.lit(0)) if "files" in batches.columns else F.lit(0)
    both = batches.select("session_id", "started_at", F.lit("batch").alias("kind"), F.coalesce(F.nullif("file_count", F.lit(0)), listed).alias("n"))
    both = both.unionByName(singles.select("session_id", "started_at", F.lit("single").alias("kind"), F.lit(1).alias("n")))
    return both.groupBy("session_id").agg(F.count("*").alias("tasks"), F.sum("n").cast("long").alias("files"), F.count(F.when(F.col("kind") == "batch", 1)).alias("batches"), F.min("started_at").alias("started_at"))


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the rows of changes put in by key; changes win, and must hold a key once."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)
