"""Queries over speech segments, batches and labels, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuebook.functions import labels
from cuebook.operators import batches, names, segments
from cuebook.sources.tables import cues, table, task_log

QUERIES, ORACLES = {}, {}
CUES = "(SELECT conv_id AS file_id, turn AS line_no, turn * 725 + (conv_id % 10) * 10 AS start_cs FROM conversations)"
SEGMENTS = '(SELECT conv_id AS file_id, turn AS seg_no, turn * 1500 + conv_id % 7 * 40 AS start, turn * 1500 + 600 + turn % 3 * 350 AS "end" FROM conversations)'
TOTALS = '(SELECT conv_id AS file_id, max(turn) * 1500 + 2000 AS total FROM conversations GROUP BY 1)'


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def _segments(spark, d):
    """conversations in the role of speech segments, in centiseconds."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), (F.col("turn") * 1500 + F.col("conv_id") % 7 * 40).alias("start"), (F.col("turn") * 1500 + 600 + F.col("turn") % 3 * 350).alias("end"))


def _totals(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("file_id")).agg((F.max("turn") * 1500 + 2000).alias("total"))


@query(f'SELECT file_id, seg_no, CAST(coalesce(sum("end" - start) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM {SEGMENTS} s')
def segment_offsets(spark, d):
    return segments.with_offsets(_segments(spark, d)).select("file_id", "seg_no", F.col("before").cast("long").alias("before"))


@query(f"""WITH s AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {SEGMENTS} x)
 SELECT c.file_id, c.line_no, CAST(s.start + c.start_cs - s.before AS BIGINT) AS start_cs FROM {CUES} c JOIN s ON c.file_id = s.file_id AND c.start_cs >= s.before AND c.start_cs < s.before + s."end" - s.start""")
def cue_remap(spark, d):
    return segments.remapped(cues(spark, d).select("file_id", "line_no", "start_cs"), _segments(spark, d)).select("file_id", "line_no", F.col("start_cs").cast("long").alias("start_cs"))


@query(f"""WITH g AS (SELECT file_id, seg_no, "end" AS e, lead(start) OVER (PARTITION BY file_id ORDER BY seg_no) AS n FROM {SEGMENTS} s),
 r AS (SELECT g.file_id, (e + n) / 2 AS mid, row_number() OVER (PARTITION BY g.file_id ORDER BY abs((e + n) / 2 - total / 2), seg_no) AS k FROM g JOIN {TOTALS} t ON g.file_id = t.file_id WHERE n - e >= 100)
 SELECT t.file_id, coalesce(mid, total / 2) AS split_at FROM {TOTALS} t LEFT JOIN r ON t.file_id = r.file_id AND k = 1""")
def split_points(spark, d):
    return segments.split_points(_segments(spark, d), _totals(spark, d))


@query(f"""SELECT t.file_id, sum("end" - start) / total AS ratio, sum("end" - start) / total < 0.8 AS use_speech FROM {TOTALS} t JOIN {SEGMENTS} s ON t.file_id = s.file_id GROUP BY t.file_id, total""")
def speech_ratio(spark, d):
    return segments.speech_ratio(_segments(spark, d), _totals(spark, d))


@query("""WITH f AS (SELECT user_id, event_type <> 'error' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events),
 r AS (SELECT *, place - row_number() OVER (PARTITION BY user_id, flag ORDER BY place) AS g FROM f)
 SELECT user_id, CAST(greatest(0, (min(place) - 1) * 50 - 300) AS BIGINT) AS start_ms, CAST(least(max(n) * 50, max(place) * 50 + 300) AS BIGINT) AS end_ms FROM r WHERE flag GROUP BY user_id, g HAVING count(*) >= 2""")
def padded_runs(spark, d):
    flags = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("flag"))
    return segments.padded_runs(flags, "user_id", ["ts", "event_id"])


@query("""WITH x AS (SELECT vec_id, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
 SELECT vec_id, CAST(i // 10 AS BIGINT) AS frame, round(sqrt(sum(v * v) / 10 + 1e-10), 6) AS rms FROM x WHERE n >= 10 GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY vec_id, i // 10"))
def frame_blocks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(segments.frames("embedding", 10)).alias("frame", "rms"))
    return e.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"))


@query("SELECT l_orderkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens, bool_and(l_returnflag <> 'R') AS all_flex, string_agg(CAST(l_partkey AS VARCHAR), chr(10) ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS text FROM lineitem GROUP BY 1")
def split_results(spark, d):
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("long").alias("tokens"), (F.col("l_returnflag") != "R").alias("flex"), F.col("l_partkey").cast("string").alias("text"))
    return segments.joined_results(parts, "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN '[00:01.00] ' || o_orderpriority END AS transcript FROM orders""")
def batch_transcripts(spark, d):
    o, file = table(spark, d, "orders"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    text = F.create_map(F.lit("lrc"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("[00:01.00] "), "o_orderpriority")).otherwise(" "))
    entries = lambda v: F.to_json(F.map_from_entries(F.collect_list(F.struct(file, v))))
    jobs = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(entries(F.col("o_orderkey").cast("string")).alias("file_log_uuids_json"), entries(F.struct(text.alias("transcripts"))).alias("results_json"))
    return batches.transcripts(task_log(spark, d), jobs).select("task_id", "transcript")


@query("""SELECT l.k, l.p AS place, l.l_partkey, e.event_type FROM (SELECT l_orderkey AS k, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem) l
 JOIN (SELECT user_id AS k, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) e ON l.k = e.k AND l.p = e.p""")
def positional_results(spark, d):
    left = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("k"), "l_linenumber", "l_partkey")
    right = table(spark, d, "events").select(F.col("user_id").cast("long").alias("k"), "event_id", "event_type")
    return batches.positional(left, right, "k", F.struct("l_linenumber", "l_partkey"), "event_id").select("k", "place", "l_partkey", "event_type")


@query("""SELECT c_custkey AS file_id, session_id FROM customer LEFT JOIN (SELECT o_custkey, min_by(o_orderkey, -o_orderkey) AS session_id FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def registered_sessions(spark, d):
    registry = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.array("o_custkey").alias("files"), (-F.col("o_orderkey")).alias("place"))
    return batches.registered(table(spark, d, "customer").select(F.col("c_custkey").alias("file_id")), registry)


@query("SELECT n_nationkey, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, CAST(n_regionkey AS VARCHAR)) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def labels_with_default(spark, d):
    known = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("label"))
    return batches.labelled(table(spark, d, "nation"), known, "n_regionkey", "label").select("n_nationkey", "label")


@query("""SELECT o_custkey AS session_id, count(*) AS tasks, CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 4 + 2 ELSE 1 END) AS BIGINT) AS files, count(*) FILTER (WHERE o_custkey % 3 = 0) AS batches, min(o_orderdate) AS started_at FROM orders GROUP BY 1""")
def session_tasks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_custkey") % 4 + 2).alias("file_count"))
    return batches.session_tasks(o.where("session_id % 3 = 0"), o.where("session_id % 3 <> 0"))


@query("SELECT c_custkey, coalesce(n, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT c_custkey AS k, 'NEW' AS n FROM customer WHERE c_custkey % 5 = 0) x ON k = c_custkey")
def upsert_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return batches.upserted(c, c.where("c_custkey % 5 = 0").withColumn("c_mktsegment", F.lit("NEW")), "c_custkey")


#: Uploads of parts, one brand's in turn: some ask for a numbered name as it stands.
UPLOADS = """(SELECT p_partkey, p_brand, p_brand || CASE p_partkey % 7 WHEN 3 THEN '(' || (p_partkey % 50 + 1) || ')' WHEN 5 THEN '(' || (p_partkey % 3 + 1) || ')(1)' ELSE '' END || '.mp3' AS name FROM part)"""


@query(f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM {UPLOADS} x),
 s(p_brand, n, p_partkey, stored_name, taken) AS (SELECT p_brand, n, p_partkey, name, [name] FROM u WHERE n = 1
 UNION ALL SELECT p_brand, n, p_partkey, stored, list_append(taken, stored) FROM (SELECT u.*, taken, CASE WHEN list_contains(taken, name) THEN list_filter(list_transform(generate_series(1, len(taken)), lambda k: left(name, -4) || '(' || k || ').mp3'), lambda x: NOT list_contains(taken, x))[1] ELSE name END AS stored
  FROM s JOIN u ON u.p_brand = s.p_brand AND u.n = s.n + 1))
 SELECT p_partkey, stored_name FROM s""")
def stored_names(spark, d):
    k = F.col("p_partkey")
    number = F.when(k % 7 == 3, F.concat(F.lit("("), (k % 50 + 1).cast("string"), F.lit(")"))).when(k % 7 == 5, F.concat(F.lit("("), (k % 3 + 1).cast("string"), F.lit(")(1)"))).otherwise("")
    p = table(spark, d, "part").select("p_partkey", F.concat("p_brand", number, F.lit(".mp3")).alias("name"))
    return names.unique_names(p, "name", "p_partkey").select("p_partkey", "stored_name")


@query("""SELECT event_id, CASE WHEN s < 60 THEN CASE WHEN s <= 0 THEN '' ELSE '<1m' END WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS ago,
 CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, event_id * 37 % 200000 AS s FROM events)""")
def age_labels(spark, d):
    s = F.col("event_id") * 37 % 200000
    return table(spark, d, "events").select("event_id", labels.ago(s).alias("ago"), labels.clock_short(s).alias("clock"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_type = 'error' THEN 'transient' ELSE 'permanent' END AS kind FROM events")
def error_classes(spark, d):
    code = F.when(F.col("event_id") % 7 == 0, 429).otherwise(400)
    return table(spark, d, "events").select("event_id", labels.error_class(code, F.when(F.col("event_type") == "error", "Service UNAVAILABLE").otherwise("bad request")).alias("kind"))
