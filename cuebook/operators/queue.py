"""Upload queue, sessions and provider settings: predicates, defaults, merges and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuebook.operators.ordered import MOST, Ordered, place

#: States of tasks that count as running or done, and the formats of a download.
RUNNING, DONE = ("POLLING", "UPLOADING", "RECOVERING"), ("COMPLETED", "RETRIEVED")
FORMATS = ("lrc", "srt", "vtt", "txt")
#: Media types that the server takes, those that the client offers, and the client's size limit.
SERVER_TYPES = (
    "audio/wav", "audio/x-wav", "audio/wave", "audio/mpeg", "audio/mp3", "audio/flac", "audio/opus", "audio/m4a", "audio/x-m4a", "audio/mp4",
    "audio/aac", "audio/webm", "video/mp4", "video/mpeg", "video/webm", "video/quicktime", "video/x-flv", "video/x-ms-wmv", "video/3gpp",
)
CLIENT_TYPES = ("audio/mpeg", "audio/wav", "audio/mp4", "audio/x-m4a", "audio/ogg", "audio/flac", "audio/webm")
CLIENT_LIMIT = 1 << 30


def flags(status: Column, alive: Column, single: Column | None = None) -> dict[str, Column]:
    """What a status says of a batch or, where single is true, of a single task: running, done (a failed single task too), an upload whose worker is known to be gone, and
    whether it is shown."""
    one = F.coalesce(single, F.lit(False)) if single is not None else F.lit(False)
    running = F.when(one, status == "PROCESSING").otherwise(status.isin(*RUNNING))
    done = F.when(one, status.isin("COMPLETED", "FAILED")).otherwise(status.isin(*DONE))
    return {"running": running, "done": done, "dead_upload": F.coalesce(~one & (status == "UPLOADING") & (alive == F.lit(False)), F.lit(False)), "shown": running | done}


def any_of(rows: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """One row per key with, for each condition, whether any of its rows meets it."""
    return rows.groupBy(key).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def accepted(files: DataFrame, kind: str, size: str, types, most: int | None = None) -> DataFrame:
    """Files of an accepted type, not empty, and no larger than most."""
    ok = F.col(kind).isin(*types) & (F.col(size) > 0)
    return files.where(ok if most is None else ok & (F.col(size) <= most))


def downloadable(log: DataFrame, fmt: Column, content: str) -> DataFrame:
    """Completed rows with a known format, whatever its case, and content that isn't blank; fmt is added in lower case."""
    out = log.withColumn("fmt", F.lower(fmt))
    return out.where((F.col("status") == "COMPLETED") & F.col("fmt").isin(*FORMATS) & F.col(content).rlike(r"(?U)\S"))


def captured(results: DataFrame, key: str, item: str, payload: str) -> DataFrame:
    """(key, results): the payloads of completed items as a map; items without one are left out. Items of a key must differ."""
    kept = results.where((F.col("status") == "COMPLETED") & F.col(payload).isNotNull())
    return kept.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(item, payload)))).alias("results"))


def merged_settings(base: DataFrame, patch: DataFrame, key: str, filled: dict[str, Column]) -> DataFrame:
    """base with patch's values of its columns over it; a null patch value keeps base's, and the columns in filled take a default where both are null or ''."""
    names = [c for c in patch.columns if c != key]
    side = patch.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in names])
    met = base.join(side, base[key] == F.col("_k"), "full").withColumn(key, F.coalesce(key, "_k"))
    for c in names:
        met = met.withColumn(c, F.coalesce(f"_{c}", c) if c not in filled else F.coalesce(F.nullif(f"_{c}", F.lit("")), F.nullif(c, F.lit("")), filled[c]))
    return met.drop("_k", *[f"_{c}" for c in names])


def either(own: Column, default: Column, blank_counts: bool = False) -> Column:
    """own, or the default where own is null, and where it is '' unless that counts."""
    return F.coalesce(own if blank_counts else F.nullif(own, F.lit("")), default)


def renewed(rows: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """rows with the columns of changes, which has a key once, put in by key where a change isn't null."""
    names = [c for c in changes.columns if c != key]
    side = changes.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    met = rows.join(side, key, "left")
    return met.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns if c != key])


def restarted(rows: DataFrame, key: str, value) -> DataFrame:
    """rows with the one of the key set back to waiting: no progress, tokens or cost, and no result."""
    hit = F.col(key) == value
    fresh = {"status": F.lit("waiting"), "percent": F.lit(0), "tokens": F.lit(0), "cost": F.lit(0.0), "result": F.lit(None)}
    return rows.select(*[F.when(hit, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in rows.columns])


def taken_in(rows: DataFrame) -> DataFrame:
    """rows as the queue takes them in: status `waiting` where null or '', percent 0 where null."""
    return rows.withColumn("status", either(F.col("status"), F.lit("waiting"))).withColumn("percent", F.coalesce("percent", F.lit(0)))


def queue_totals(rows: DataFrame) -> DataFrame:
    """Megabytes of all files, tokens and cost of completed ones, and how many wait or failed; zeros for an empty queue."""
    done = F.col("status") == "completed"
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind)
    return rows.agg(zero(F.sum("size") / (1 << 20), "double").alias("megabytes"), zero(F.sum(F.when(done, F.col("tokens"))), "long").alias("tokens"), zero(F.sum(F.when(done, F.col("cost"))), "double").alias("cost"), F.count(F.when(F.col("status") == "waiting", 1)).alias("waiting"), F.count(F.when(F.col("status") == "error", 1)).alias("failed"))


def quota(used: Column, total: Column) -> dict[str, Column]:
    """Percentage used, rounded, null for no quota, and whether it is above 80."""
    percent = F.round(F.try_divide(used * 100.0, total)).cast("long")
    return {"percent": percent, "high": F.coalesce(percent > 80, F.lit(False))}


def grouped(rows: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """(key, first, items): items of a key in order, and the place of its first, by which the groups are ordered."""
    listed = F.array_sort(F.collect_list(F.struct(order, item)))
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.transform(listed, lambda r: r[item]).alias("items"))


def by_start(sessions: DataFrame, start: Column, order: str, most: int = MOST) -> DataFrame:
    """sessions with place (from 1), the latest start first; a start in milliseconds, 0 for what is no time, and ties in their order."""
    d = sessions.withColumns({"_all": F.lit(0), "_start": -F.coalesce(start, F.lit(0))})
    return Ordered(d, "_all", ["_start", order], most).scan(place=place()).rows().drop("_all", "_start")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, tokens, cost and seconds of results, over all or by keys; nulls count as nothing."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "cost", "duration")]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def split(rows: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that meet a condition, and all others; a null condition isn't met."""
    met = F.coalesce(condition, F.lit(False))
    return rows.where(met), rows.where(~met)


def members(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys."""
    return rows.join(keys, key, "left_semi")


def looked_up(rows: DataFrame, values: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns of values, which has a key once, by key; a default where a key isn't listed or its value is null."""
    met = rows.join(values.select(key, *defaults), key, "left")
    return met.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})


def widened(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; a column that one of them lacks is null there."""
    return rows.unionByName(more, allowMissingColumns=True)


def filled_keys(keys: Column) -> Column:
    """The keys of a list that aren't blank."""
    return F.filter(keys, lambda x: F.trim(x) != "")


def settings(rows: DataFrame, keys: str = "keys_json") -> DataFrame:
    """Stored provider settings with their list of keys read from JSON text; a broken text is an empty list."""
    from cuebook.functions.scalars import text_list

    return rows.withColumn("keys", text_list(F.col(keys))).drop(keys)


def newest(rows: DataFrame, time: Column, tie: str, n: int = 80) -> DataFrame:
    """The n newest rows; a null time is the oldest, ties by tie."""
    return rows.orderBy(F.coalesce(time, F.lit(0)).desc(), tie).limit(n)


def preview(items: Column, n: int = 20) -> dict[str, Column]:
    return {"preview": F.slice(items, 1, n), "truncated": F.size(items) > n}


def routed(events: DataFrame, connections: DataFrame, client: str = "client_id") -> DataFrame:
    """events with the newest connection (highest seq) of their client; events of a client without one go. events may be a stream."""
    live = connections.groupBy(client).agg(F.max_by("connection", "seq").alias("connection"))
    return events.join(live, client)


def addressed(events: DataFrame, files: DataFrame) -> DataFrame:
    """(event_id, file_uid, text): an event with a file_uid goes to that file, one without to every processing file of its batch."""
    own = events.where("file_uid is not null").join(files.select("file_uid"), "file_uid", "left_semi").select("event_id", "file_uid", "text")
    wide = events.where("file_uid is null").select("event_id", "batch_id", "text").join(files.where("status = 'processing'").select("batch_id", "file_uid"), "batch_id")
    return own.unionByName(wide.select("event_id", "file_uid", "text"))


def folded(events: DataFrame, key: str = "file_uid", order: str = "seq") -> DataFrame:
    """One row per key of its events (status, text): the first COMPLETED or FAILED one ends it, else the last one counts. One aggregate, no sort."""
    ends = F.col("status").isin("COMPLETED", "FAILED")
    end = F.min_by(F.when(ends, F.struct("status", "text")), F.when(ends, F.col(order)))
    last = F.max_by(F.struct("status", "text"), order)
    return events.groupBy(key).agg(F.coalesce(end, last).alias("r")).select(key, "r.status", "r.text")


#: States of a job at the service that end it, and the one that has results.
ENDED, SUCCEEDED = ("JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"), "JOB_STATE_SUCCEEDED"
_FILE = "file_uid: string, original_filename: string, vad_segments: array<struct<start: double, end: double>>"


def recovered(jobs: DataFrame) -> DataFrame:
    """The files of stored jobs, rebuilt from their four JSON columns (file_mapping_json, file_durations_json, file_log_uuids_json, task_params_json): batch_id, place, nth (from 0 among
    the job's files in the order of their places, null for a row without a file), file_uid, filename, duration (0 if not stored), task_id ('' if not stored), segments, model, provider, source_lang, target_lang, prompt, and the status that work goes on from.

    A job that isn't at an end goes on polling; one at an end keeps its status. One whose mapping is broken, empty or null, or any of whose other columns is broken, has failed, and
    keeps a row without a file. Other columns that are null, blank or not there count as empty."""
    kinds = {"file_mapping_json": f"map<string, struct<{_FILE}>>", "file_durations_json": "map<string, double>", "file_log_uuids_json": "map<string, string>", "task_params_json": "struct<model: string, provider: string, source_lang: string, target_lang: string, prompt: string>"}
    names = dict(zip(kinds, ("_files", "_durations", "_logs", "_params"), strict=True))
    d = jobs.withColumns({c: F.lit(None).cast("string") for c in kinds if c not in jobs.columns})
    d = d.withColumns({names[c]: F.from_json(c, k) for c, k in kinds.items()})
    whole = {c: F.from_json(c, "map<string, string>") for c in kinds}
    broken = F.lit(False)
    for c in kinds:
        blank = F.coalesce(F.trim(c), F.lit("")) == ""
        broken = broken | ~blank & whole[c].isNull()
    empty = F.coalesce(F.size("_files"), F.lit(0)) <= 0
    d = d.withColumn("_bad", broken | empty)
    over = F.col("status").isin("COMPLETED", "FAILED", "RETRIEVED")
    state = F.when(over, F.col("status")).when(F.col("_bad"), "FAILED").otherwise("POLLING")
    # a job's files are one value, so they are put in order in it (null places first), those without an id last
    entry = F.transform(F.map_entries("_files"), lambda e: F.struct(e["value"]["file_uid"].isNull().alias("none"), e["key"].try_cast("int").alias("place"), e["value"].alias("f")))
    files = F.array_sort(entry)
    rows = d.withColumn("status", state).withColumn("_files", F.when(~F.col("_bad"), files)).select("batch_id", "status", "_durations", "_logs", "_params", F.posexplode_outer("_files").alias("nth", "e")).withColumns({"place": F.col("e.place"), "f": F.col("e.f")})
    uid = F.col("f.file_uid")
    params = [F.when(uid.isNotNull(), F.coalesce(F.col("_params")[p], F.lit(default))).alias(p) for p, default in (("model", ""), ("provider", "google"), ("source_lang", ""), ("target_lang", None), ("prompt", ""))]
    known = lambda m, x: F.when(uid.isNotNull(), F.coalesce(F.try_element_at(m, uid), x))
    return rows.select("batch_id", "place", F.when(uid.isNotNull(), F.col("nth").cast("long")).alias("nth"), uid.alias("file_uid"), F.col("f.original_filename").alias("filename"), known("_durations", F.lit(0.0)).alias("duration"), known("_logs", F.lit("")).alias("task_id"), F.col("f.vad_segments").alias("segments"), *params, "status")


def replayed(files: DataFrame, responses: DataFrame, states: DataFrame) -> DataFrame:
    """recovered() files met by the service's state of their job (batch_id, state) and its answers (batch_id, place from 0 among the job's files, text, null for a failed one):
    files with text and status. A job not at an end, or of no known state, goes on polling; one that failed fails its files; of one that succeeded a file with an answer is
    COMPLETED, one with a null answer FAILED, and files beyond the answers keep RECOVERING."""
    nth = files.where("file_uid is not null").withColumnRenamed("nth", "_nth")
    side = responses.select(F.col("batch_id").alias("_b"), F.col("place").alias("_p"), "text", F.lit(True).alias("_answered"))
    met = nth.join(states.select(F.col("batch_id").alias("_s"), "state"), F.col("batch_id") == F.col("_s"), "left").join(side, (F.col("batch_id") == F.col("_b")) & (F.col("_nth") == F.col("_p")), "left")
    ended = F.when(F.col("_answered").isNull(), "RECOVERING").when(F.col("text").isNull(), "FAILED").otherwise("COMPLETED")
    status = F.when(~F.coalesce(F.col("state").isin(*ENDED), F.lit(False)), "POLLING").when(F.col("state") != SUCCEEDED, "FAILED").otherwise(ended)
    return met.withColumn("status", status).withColumn("text", F.when(F.col("status") == "COMPLETED", F.col("text"))).drop("_nth", "_s", "_b", "_p", "_answered", "state")


def delays(rows: DataFrame, n: Column, base: float, factor: float, most: float) -> DataFrame:
    """rows with attempt (from 0) and delay of n attempts each: base * factor ^ attempt, most at the longest."""
    from cuebook.functions.labels import back_off

    return rows.withColumn("attempt", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("delay", back_off(F.col("attempt"), base, factor, most))


def by_number(rows: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """rows with place (from 1), the order of their text read as a whole number within the key; text that is no number comes first."""
    return Ordered(rows, key, [F.col(text).try_cast("bigint"), text], most).scan(place=place()).rows()
