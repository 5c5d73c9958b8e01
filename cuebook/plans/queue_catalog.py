"""Queries of the upload queue, sessions, settings, routing and status events, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuebook.functions.scalars import millis
from cuebook.operators import batches, queue, tasklog, timeline
from cuebook.plans.shared_sql import LOG
from cuebook.sources.tables import table, task_log

QUERIES, ORACLES = {}, {}
NOW = "2024-01-01 00:00:00"
JOBS = "(SELECT c_custkey AS batch_id, CASE c_nationkey % 6 WHEN 0 THEN 'UPLOADING' WHEN 1 THEN 'POLLING' WHEN 2 THEN 'RECOVERING' WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' ELSE 'RETRIEVED' END AS status, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS alive, CASE WHEN c_custkey % 13 > 0 THEN c_custkey % 600 END AS elapsed FROM customer)"
STATE = "CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _jobs(spark, d):
    """customer in the role of batch jobs, with two to twelve files each in their JSON. The few bytes of a row become long texts, so rows are dealt first: a small file is one task else."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)
    state = F.element_at(F.array(*map(F.lit, ("UPLOADING", "POLLING", "RECOVERING", "COMPLETED", "FAILED", "RETRIEVED"))), (F.col("c_nationkey") % 6 + 1).cast("int"))
    entry = lambda i: F.struct(F.concat(F.lit("u"), i.cast("string")).alias("file_uid"), F.concat(F.lit("f"), i.cast("string"), F.lit(".mp3")).alias("original_filename"))
    places = F.sequence(F.lit(0), (k % 11 + 1).cast("int"))
    files = F.map_from_arrays(F.transform(places, lambda i: i.cast("string")), F.transform(places, entry))
    return c.select(k.alias("batch_id"), state.alias("status"), F.when(k % 3 < 2, k % 3 == 0).alias("alive"), F.when(k % 13 > 0, F.expr(f"timestamp_ntz'{NOW}'") - F.make_interval(secs=(k % 600).cast("decimal(18,6)"))).alias("created_at"), F.when(k % 2 == 0, F.expr(f"timestamp_ntz'{NOW}'")).alias("updated_at"), F.when(k % 2 == 0, k % 4).alias("file_count"), F.when(k % 5 > 0, F.concat(F.lit("s"), (k % 50).cast("string"))).otherwise("").alias("session_id"), F.when(k % 7 > 0, F.to_json(files)).otherwise('{"broken').alias("file_mapping_json"))


@query(f"""SELECT batch_id, status, CASE WHEN status IN ('UPLOADING', 'POLLING', 'RECOVERING') THEN CASE WHEN alive IS NOT NULL THEN alive WHEN elapsed > 300 THEN false END END AS is_alive,
 CASE WHEN batch_id % 2 = 0 AND batch_id % 4 > 0 THEN batch_id % 4 WHEN batch_id % 7 > 0 THEN batch_id % 11 + 2 ELSE 0 END AS file_count, strftime(TIMESTAMP '2024-01-01' - to_seconds(elapsed), '%Y-%m-%d %H:%M:%S') AS created_at, CASE WHEN batch_id % 2 = 0 THEN '2024-01-01 00:00:00' END AS updated_at, CAST(elapsed AS DOUBLE) AS elapsed_seconds, CASE WHEN batch_id % 5 > 0 THEN 's' || (batch_id % 50) ELSE CAST(batch_id AS VARCHAR) END AS session_id,
 CASE WHEN batch_id % 7 > 0 THEN (SELECT string_agg('u' || i || ':f' || i || '.mp3', ',' ORDER BY i) FROM generate_series(0, batch_id % 11 + 1) t(i)) END AS names FROM {JOBS} j""")
def batch_tasks(spark, d):
    t = batches.task_rows(_jobs(spark, d), F.col("alive"), F.expr(f"timestamp_ntz'{NOW}'"))
    named = F.array_join(F.transform("files", lambda f: F.concat(f["file_uid"], F.lit(":"), f["original_filename"])), ",")
    return t.withColumn("names", named).withColumn("file_count", F.col("file_count").cast("long")).drop("files")


#: Batches and single tasks as items of sessions.
ITEMS = f"""(SELECT 'b' || batch_id AS id, batch_id % 50 AS session, false AS single, status, alive FROM {JOBS} j UNION ALL SELECT 't' || task_id, batch_id % 90, true, status, NULL FROM {LOG} l)"""
IS_RUNNING = "CASE WHEN single THEN status = 'PROCESSING' ELSE status IN ('POLLING', 'UPLOADING', 'RECOVERING') END"
IS_DONE = "CASE WHEN single THEN status IN ('COMPLETED', 'FAILED') ELSE status IN ('COMPLETED', 'RETRIEVED') END"


def _kinds(spark, d):
    jobs = _jobs(spark, d).select(F.concat(F.lit("b"), F.col("batch_id").cast("string")).alias("id"), (F.col("batch_id") % 50).alias("session"), F.lit(False).alias("single"), "status", "alive")
    tasks = task_log(spark, d).select(F.concat(F.lit("t"), F.col("task_id").cast("string")).alias("id"), (F.col("batch_id") % 90).alias("session"), F.lit(True).alias("single"), "status")
    return queue.widened(jobs, tasks)


@query(f"SELECT id, {IS_RUNNING} AS running, {IS_DONE} AS done, coalesce(NOT single AND status = 'UPLOADING' AND NOT alive, false) AS dead_upload, single OR status <> 'FAILED' AS shown FROM {ITEMS} i")
def status_flags(spark, d):
    f = queue.flags(F.col("status"), F.col("alive"), F.col("single"))
    return _kinds(spark, d).select("id", *[c.alias(n) for n, c in f.items()])


@query(f"SELECT session, bool_or({IS_RUNNING}) AS running, bool_or({IS_DONE}) AS done FROM {ITEMS} i GROUP BY 1")
def session_flags(spark, d):
    f = queue.flags(F.col("status"), F.col("alive"), F.col("single"))
    return queue.any_of(_kinds(spark, d), "session", running=f["running"], done=f["done"])


@query("SELECT event_id, event_type, p IS NULL OR p = event_type AS same, p AS before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)")
def state_before(spark, d):
    c = batches.state_changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return c.select("event_id", "event_type", F.coalesce("valid", F.lit(False)).alias("same"), "before")


MOVES = " OR ".join(f"(p = '{a}' AND s IN ({', '.join(repr(b) for b in bs)}))" for a, bs in batches.MOVES.items() if bs)


@query(f"""SELECT event_id, s AS status, p IS NULL OR p = s OR {MOVES} AS valid FROM (SELECT event_id, s, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM
 (SELECT *, CASE event_id % 5 WHEN 0 THEN 'UPLOADING' WHEN 1 THEN 'POLLING' WHEN 2 THEN 'COMPLETED' WHEN 3 THEN 'FAILED' ELSE 'RECOVERING' END AS s FROM events))""")
def state_moves(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("UPLOADING", "POLLING", "COMPLETED", "FAILED", "RECOVERING"))), (F.col("event_id") % 5 + 1).cast("int"))
    return batches.state_changes(table(spark, d, "events").withColumn("status", s), "user_id", ["ts", "event_id"]).select("event_id", "status", F.coalesce("valid", F.lit(False)).alias("valid"))


@query(f"SELECT task_id, CASE task_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'vtt' END AS fmt FROM {LOG} l WHERE status = 'COMPLETED' AND lrc_content IS NOT NULL AND task_id % 3 < 2")
def downloads(spark, d):
    k = F.col("task_id") % 3
    return queue.downloadable(task_log(spark, d), F.when(k == 0, "SRT").when(k == 1, "vtt").otherwise("exe"), "lrc_content").select("task_id", "fmt")


@query(f"SELECT batch_id, count(*) AS n, string_agg(task_id || '=' || lrc_content, ',' ORDER BY task_id) AS results FROM {LOG} l WHERE status = 'COMPLETED' AND lrc_content IS NOT NULL GROUP BY 1")
def captured_results(spark, d):
    c = queue.captured(task_log(spark, d), "batch_id", "task_id", "lrc_content")
    text = F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")
    return c.select("batch_id", F.size("results").cast("long").alias("n"), text.alias("results"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'patched' WHEN n_nationkey % 4 = 3 THEN 'first' ELSE n_name END AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'p' ELSE CAST(n_regionkey AS VARCHAR) END AS prompt FROM nation""")
def settings_merge(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    base = n.select("n_nationkey", F.when(k % 4 == 3, "").otherwise(F.col("n_name")).alias("model"), F.col("n_regionkey").cast("string").alias("prompt"))
    patch = n.where(k % 2 == 0).select("n_nationkey", F.when(k % 4 == 0, "patched").otherwise("").alias("model"), F.lit("p").alias("prompt"))
    return queue.merged_settings(base, patch, "n_nationkey", {"model": F.lit("first")})


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'batch' END AS either, CASE c_custkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN '' ELSE 'batch' END AS given, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE 'waiting' END AS status, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS percent, 'k1' AS keys FROM customer")
def queue_intake(spark, d):
    k = F.col("c_custkey")
    own = F.when(k % 3 == 0, "own").when(k % 3 == 1, "")
    c = queue.taken_in(table(spark, d, "customer").select("c_custkey", own.alias("status"), F.when(k % 2 == 0, k).alias("percent")))
    keys = F.array_join(queue.filled_keys(F.array(F.lit(" "), F.lit("k1"), F.lit(""))), ",")
    return c.select("c_custkey", queue.either(own, F.lit("batch")).alias("either"), queue.either(own, F.lit("batch"), True).alias("given"), "status", "percent", keys.alias("keys"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_by_key(spark, d):
    c, k = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    return queue.renewed(c, "c_custkey", c.where(k % 5 == 0).select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.when(k % 10 == 0, -1.0).alias("c_acctbal")))


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'waiting' ELSE 'completed' END AS status, CASE WHEN c_custkey = 7 THEN 0 ELSE 100 END AS percent, CASE WHEN c_custkey = 7 THEN 0.0 ELSE c_acctbal END AS cost, CASE WHEN c_custkey <> 7 THEN c_name END AS result FROM customer")
def restart_row(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.lit("completed").alias("status"), F.lit(100).alias("percent"), F.col("c_acctbal").alias("cost"), F.col("c_name").alias("result"))
    return queue.restarted(rows, "c_custkey", 7)


@query("SELECT sum(p_size) / CAST(1048576 AS DOUBLE) AS megabytes, CAST(sum(p_partkey) FILTER (WHERE p_size % 3 = 0) AS BIGINT) AS tokens, round(sum(p_retailprice) FILTER (WHERE p_size % 3 = 0), 2) AS cost, count(*) FILTER (WHERE p_size % 3 = 1) AS waiting, count(*) FILTER (WHERE p_size % 3 = 2) AS failed FROM part")
def queue_totals(spark, d):
    k = F.col("p_size") % 3
    rows = table(spark, d, "part").select(F.col("p_size").alias("size"), F.when(k == 0, "completed").when(k == 1, "waiting").otherwise("error").alias("status"), F.col("p_partkey").alias("tokens"), F.col("p_retailprice").alias("cost"))
    return queue.queue_totals(rows).withColumn("cost", F.round("cost", 2))


@query(f"SELECT count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 7) AS cost, round(sum(duration), 3) AS duration, count(DISTINCT coalesce(session_id, '')) AS groups FROM {LOG} l")
def result_summary(spark, d):
    log = task_log(spark, d)
    whole = queue.summary(log).select("n", "tokens", F.round("cost", 7).alias("cost"), F.round("duration", 3).alias("duration"))
    return whole.withColumn("groups", log.select(F.coalesce("session_id", F.lit(""))).distinct().agg(F.count("*")).scalar())


@query(f"SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 7) AS cost FROM {LOG} l GROUP BY 1")
def group_totals(spark, d):
    return queue.summary(task_log(spark, d), "session_id").select("session_id", "tokens", F.round("cost", 7).alias("cost"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > 0 THEN CAST(round(s_suppkey % 30 * 100.0 / s_nationkey) AS BIGINT) END AS percent, coalesce(round(s_suppkey % 30 * 100.0 / nullif(s_nationkey, 0)) > 80, false) AS high FROM supplier")
def quotas(spark, d):
    q = queue.quota(F.col("s_suppkey") % 30, F.col("s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", q["percent"].alias("percent"), q["high"].alias("high"))


@query(f"SELECT session_id, min(task_id) AS first, string_agg(filename, ',' ORDER BY task_id) AS items FROM {LOG} l GROUP BY 1")
def session_items(spark, d):
    return queue.grouped(task_log(spark, d), "session_id", "task_id", "filename").withColumn("items", F.array_join("items", ","))


@query(f"SELECT task_id, requested_at FROM {LOG} l WHERE session_id IS NULL ORDER BY requested_at DESC, task_id LIMIT 80")
def newest_orphans(spark, d):
    return queue.newest(task_log(spark, d).where("session_id is null"), F.unix_micros(F.col("requested_at").cast("timestamp")), "task_id").select("task_id", "requested_at")


@query("""SELECT event_id, CAST(sum(CASE WHEN p IS NOT NULL AND epoch_us(ts) - epoch_us(p) <= 600000000 AND event_type = k THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster
 FROM (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS p, lag(event_type) OVER (ORDER BY ts, event_id) AS k FROM events)""")
def task_clusters(spark, d):
    return timeline.clusters(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", "event_type", "event_id").select("event_id", F.col("cluster").cast("long").alias("cluster"))


@query(f"SELECT task_id, CASE WHEN session_id IS NULL THEN 'orphan' ELSE 'held' END AS part FROM {LOG} l UNION ALL SELECT min(task_id), 'path' FROM {LOG} l GROUP BY title")
def orphan_split(spark, d):
    log = task_log(spark, d).select("task_id", "session_id", "title")
    orphans, held = queue.split(log, F.col("session_id").isNull())
    paths = log.groupBy("title").agg(F.min("task_id").alias("task_id"))
    tag = lambda rows, name: rows.select("task_id", F.lit(name).alias("part"))
    return tag(orphans, "orphan").unionByName(tag(held, "held")).unionByName(tag(paths, "path"))


@query(f"SELECT batch_id, k AS place, 'f' || (k - 1) || '.mp3' AS name FROM {JOBS} j, generate_series(1, 12) t(k) WHERE batch_id % 7 > 0 AND k <= batch_id % 11 + 2")
def numeric_keys(spark, d):
    """Entries of a JSON map in the order of their keys as numbers: "10" after "9"."""
    kind = "map<string, struct<file_uid: string, original_filename: string>>"
    e = _jobs(spark, d).select("batch_id", F.explode(F.from_json("file_mapping_json", kind)).alias("k", "v"))
    return queue.by_number(e, "batch_id", "k").select("batch_id", F.col("place").cast("long").alias("place"), F.col("v.original_filename").alias("name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE coalesce(r_name, 'Google') END AS provider FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def model_provider(spark, d):
    n = table(spark, d, "nation").withColumn("model", F.when(F.col("n_nationkey") % 5 < 4, F.col("n_regionkey").cast("string")))
    known = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("model"), F.col("r_name").alias("provider"))
    return batches.labelled(n, known, "model", "provider", F.when(F.col("model").isNotNull(), "Google")).select("n_nationkey", "provider")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, 0.0) AS duration, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, '') AS log FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def file_values(spark, d):
    known = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("duration"), F.col("p_name").alias("log"))
    files = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return queue.looked_up(files, known, "l_partkey", {"duration": F.lit(0.0), "log": F.lit("")})


@query("SELECT event_id, c AS connection FROM events JOIN (SELECT o_custkey AS user_id, max(o_orderkey) AS c FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1) o ON events.user_id = o.user_id")
def event_routing(spark, d):
    live = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("connection"), F.col("o_orderkey").alias("seq"))
    return queue.routed(table(spark, d, "events").select("event_id", "user_id"), live, "user_id").select("event_id", "connection")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def uploaded_members(spark, d):
    bought = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return queue.members(table(spark, d, "orders"), bought, "o_custkey").select("o_orderkey")


@query(f"""SELECT user_id, coalesce(first(s ORDER BY ts, event_id) FILTER (WHERE s <> 'PROCESSING'), last(s ORDER BY ts, event_id)) AS status, coalesce(first(event_id ORDER BY ts, event_id) FILTER (WHERE s <> 'PROCESSING'), last(event_id ORDER BY ts, event_id)) AS event_id
 FROM (SELECT *, {STATE} AS s FROM events) GROUP BY 1""")
def folded_state(spark, d):
    kind = F.col("event_type")
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.when(kind == "purchase", "COMPLETED").when(kind == "error", "FAILED").otherwise("PROCESSING").alias("status"), F.col("event_id").alias("text"))
    return queue.folded(e, "user_id").select("user_id", "status", F.col("text").alias("event_id"))


@query("""SELECT event_id, 'u' || o_orderkey AS file_uid FROM events JOIN orders ON o_orderkey = event_id % 4000 WHERE event_id % 3 > 0
 UNION ALL SELECT event_id, 'u' || o_orderkey FROM events JOIN orders ON o_custkey = user_id WHERE event_id % 3 = 0 AND o_orderstatus = 'O'""")
def event_targets(spark, d):
    files = table(spark, d, "orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("file_uid"), F.col("o_custkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed").alias("status"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("u"), (F.col("event_id") % 4000).cast("string"))).alias("file_uid"), F.col("user_id").alias("batch_id"), F.col("event_type").alias("text"))
    return queue.addressed(e, files).select("event_id", "file_uid")


BROKEN = "batch_id % 7 = 0 OR batch_id % 17 = 0"
ENDED = "status IN ('COMPLETED', 'FAILED', 'RETRIEVED')"


def _stored(spark, d):
    """Jobs with durations, log ids and parameters in their JSON, some of it broken or missing."""
    k = F.col("batch_id")
    each = F.sequence(F.lit(0), (k % 11 + 1).cast("int"))
    uids = F.transform(each, lambda i: F.concat(F.lit("u"), i.cast("string")))
    durations = F.to_json(F.map_from_arrays(F.filter(uids, lambda u: u != "u1"), F.transform(F.filter(each, lambda i: i != 1), lambda i: i * 1.5)))
    logs = F.to_json(F.map_from_arrays(uids, F.transform(each, lambda i: F.concat(k.cast("string"), F.lit("-"), i.cast("string")))))
    params = F.to_json(F.struct(F.lit("m").alias("model"), F.when(k % 2 == 0, "openai").alias("provider"), F.lit("ja").alias("source_lang")))
    return _jobs(spark, d).withColumns({"file_durations_json": durations, "file_log_uuids_json": F.when(k % 3 > 0, logs), "task_params_json": F.when(k % 17 > 0, params).otherwise("[broken")})


@query(f"""SELECT batch_id, k - 1 AS place, 'u' || (k - 1) AS file_uid, CASE WHEN k = 2 THEN 0.0 ELSE (k - 1) * CAST(1.5 AS DOUBLE) END AS duration, CASE WHEN batch_id % 3 > 0 THEN batch_id || '-' || (k - 1) ELSE '' END AS task_id, 'm' AS model,
 CASE WHEN batch_id % 2 = 0 THEN 'openai' ELSE 'google' END AS provider, 'ja' AS source_lang, CASE WHEN {ENDED} THEN status ELSE 'POLLING' END AS status FROM {JOBS} j, generate_series(1, 12) t(k) WHERE NOT ({BROKEN}) AND k <= batch_id % 11 + 2
 UNION ALL SELECT batch_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN {ENDED} THEN status ELSE 'FAILED' END FROM {JOBS} j WHERE {BROKEN}""")
def recovered_jobs(spark, d):
    r = queue.recovered(_stored(spark, d))
    return r.select("batch_id", F.col("place").cast("long").alias("place"), "file_uid", "duration", "task_id", "model", "provider", "source_lang", "status")


@query(f"""SELECT batch_id, k - 1 AS place, CASE WHEN batch_id % 4 = 0 THEN 'POLLING' WHEN batch_id % 4 = 1 THEN 'FAILED' WHEN k > 3 THEN 'RECOVERING' WHEN k = 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
 CASE WHEN batch_id % 4 > 1 AND k IN (1, 3) THEN 'said ' || (k - 1) END AS text FROM {JOBS} j, generate_series(1, 12) t(k) WHERE NOT ({BROKEN}) AND k <= batch_id % 11 + 2""")
def replayed_jobs(spark, d):
    """Recovered files met by the service's state of each job and its first three answers, the second of them failed."""
    jobs, k = _stored(spark, d), F.col("batch_id")
    states = jobs.where(k % 8 > 0).select("batch_id", F.when(k % 4 == 0, "JOB_STATE_RUNNING").when(k % 4 == 1, "JOB_STATE_EXPIRED").otherwise("JOB_STATE_SUCCEEDED").alias("state"))
    answers = jobs.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place")).withColumn("text", F.when(F.col("place") != 1, F.concat(F.lit("said "), F.col("place").cast("string"))))
    return queue.replayed(queue.recovered(jobs), answers, states).select("batch_id", F.col("place").cast("long").alias("place"), "status", "text")


@query("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 40 AND p_partkey % 3 < 2")
def accepted_uploads(spark, d):
    k = F.col("p_partkey") % 3
    files = table(spark, d, "part").select("p_partkey", F.when(k == 0, "audio/mpeg").when(k == 1, "audio/flac").otherwise("text/html").alias("kind"), (F.greatest(F.col("p_size") - 10, F.lit(0)).cast("long") * (1 << 25) + F.when(F.col("p_size") > 40, 1 << 30).otherwise(0)).alias("bytes"))
    limit = (1 << 25) * 30
    return queue.accepted(queue.accepted(files, "kind", "bytes", queue.SERVER_TYPES), "kind", "bytes", queue.CLIENT_TYPES, min(queue.CLIENT_LIMIT, limit)).select("p_partkey")


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 AS own FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL, NULL FROM region")
def new_columns(spark, d):
    base = table(spark, d, "nation").withColumn("own", F.col("n_nationkey") % 2 == 0)
    return queue.widened(base, table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")))


@query("SELECT c_custkey, c_name, 'empty' AS was FROM customer UNION ALL SELECT c_custkey, c_name, 'full' FROM customer WHERE c_custkey % 2 = 0")
def seeded(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    full = c.where("c_custkey % 2 = 0")
    return batches.seeded(c.where("c_custkey < 0"), c).withColumn("was", F.lit("empty")).unionByName(batches.seeded(full, c).withColumn("was", F.lit("full")))


@query(f"SELECT batch_id, status FROM {JOBS} j WHERE status IN ('UPLOADING', 'POLLING', 'RECOVERING', 'COMPLETED')")
def live_jobs(spark, d):
    return tasklog.in_states(_jobs(spark, d), (*batches.LIVE, "COMPLETED")).select("batch_id", "status")


@query("SELECT n_name AS provider, r_name AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'a,b' ELSE '' END AS keys FROM nation JOIN region ON n_regionkey = r_regionkey")
def provider_settings(spark, d):
    """nation in the role of stored provider settings, key lists as JSON, some of them broken."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.when(F.col("n_nationkey") % 2 == 0, '["a","b"]').otherwise("{broken")
    stored = n.select(F.col("n_name").alias("provider"), F.col("r_name").alias("model"), text.alias("keys_json"))
    return queue.settings(stored).withColumn("keys", F.array_join("keys", ","))


@query(f"""SELECT session_id, started_at, row_number() OVER (ORDER BY coalesce(epoch_ms(TRY_CAST(started_at AS TIMESTAMP)), 0) DESC, first) AS place FROM
 (SELECT session_id, min(task_id) AS first, CASE WHEN min(task_id) % 4 = 0 THEN 'no time' ELSE strftime(min(requested_at), '%Y-%m-%d') END AS started_at FROM {LOG} l WHERE session_id IS NOT NULL GROUP BY 1)""")
def sessions_by_start(spark, d):
    s = task_log(spark, d).where("session_id is not null").groupBy("session_id").agg(F.min("task_id").alias("first"), F.date_format(F.min("requested_at"), "yyyy-MM-dd").alias("started_at"))
    s = s.withColumn("started_at", F.when(F.col("first") % 4 == 0, "no time").otherwise(F.col("started_at")))
    return queue.by_start(s, millis(F.col("started_at")), "first").drop("first")
