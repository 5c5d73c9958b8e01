"""Registered queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from cuebook.functions import scalars
from cuebook.operators import tasklog, timeline
from cuebook.plans import history_catalog, queue_catalog, segment_catalog
from cuebook.plans.shared_sql import CUES, ENDS, LOG, STATS
from cuebook.sources import sinks
from cuebook.sources.scratch import new_folder
from cuebook.sources.tables import cues, lyrics, table, task_log

from_ = (segment_catalog, history_catalog, queue_catalog)
QUERIES, ORACLES = {k: v for c in from_ for k, v in c.QUERIES.items()}, {k: v for c in from_ for k, v in c.ORACLES.items()}
AS_OF = "1998-08-01 00:00:00"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def sql_clock(ms: str, mark: str) -> str:
    two = lambda x: f"CASE WHEN {x} < 100 THEN lpad(CAST({x} AS VARCHAR), 2, '0') ELSE CAST({x} AS VARCHAR) END"
    return f"{two(f'{ms} // 3600000')} || ':' || {two(f'({ms} // 60000) % 60')} || ':' || {two(f'({ms} // 1000) % 60')} || '{mark}' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0')"


@query(f"SELECT {STATS} FROM {LOG} l")
def stats_overview(spark, d):
    return tasklog.stats(task_log(spark, d))


@query(f"SELECT model, {STATS} FROM {LOG} l GROUP BY model")
def stats_by_model(spark, d):
    return tasklog.stats(task_log(spark, d), "model")


@query(f"SELECT strftime(requested_at, '%Y-%m') AS month, {STATS} FROM {LOG} l GROUP BY 1")
def stats_by_month(spark, d):
    return tasklog.stats(task_log(spark, d).withColumn("month", F.date_format("requested_at", "yyyy-MM")), "month")


@query(f"SELECT strftime(requested_at, '%Y-%m-%d') AS day, {STATS} FROM {LOG} l GROUP BY 1")
def stats_by_day(spark, d):
    return tasklog.stats(task_log(spark, d).withColumn("day", F.date_format("requested_at", "yyyy-MM-dd")), "day")


@query(f"SELECT dayofweek(requested_at) AS weekday, {STATS} FROM {LOG} l GROUP BY 1")
def stats_by_weekday(spark, d):
    return tasklog.stats(task_log(spark, d).withColumn("weekday", (F.dayofweek("requested_at") - 1).cast("long")), "weekday")


@query(f"SELECT model, count(*) AS n, round(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER (), 2) AS share FROM {LOG} l GROUP BY model")
def stats_share_by_model(spark, d):
    return tasklog.share(task_log(spark, d), "model")


@query(f"SELECT task_id, status, cost FROM {LOG} l WHERE status = 'FAILED'")
def filter_status(spark, d):
    return tasklog.matching(task_log(spark, d), status="FAILED").select("task_id", "status", "cost")


@query(f"SELECT task_id, batch_id FROM {LOG} l WHERE is_batch")
def filter_is_batch(spark, d):
    return tasklog.matching(task_log(spark, d), is_batch=True).select("task_id", "batch_id")


@query(f"SELECT task_id, requested_at FROM {LOG} l WHERE requested_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'")
def filter_date_range(spark, d):
    return tasklog.matching(task_log(spark, d), since="1995-01-01 00:00:00", until="1995-12-31 00:00:00").select("task_id", "requested_at")


@query(f"SELECT task_id, filename FROM {LOG} l WHERE contains(lower(filename), 'audio_12') OR lower(filename) LIKE '%audio_12%'")
def keyword_search(spark, d):
    return tasklog.matching(task_log(spark, d), keyword="Audio_12").select("task_id", "filename")


@query(f"SELECT task_id FROM {LOG} l WHERE filename ILIKE '%o_1_5%' OR title ILIKE '%o_1_5%'")
def keyword_wildcard(spark, d):
    return tasklog.matching(task_log(spark, d), keyword="O_1_5").select("task_id")


@query(f"SELECT task_id FROM {LOG} l WHERE contains(lower(title), 'k 12%') OR contains(lower(filename), 'k 12%')")
def keyword_literal(spark, d):
    return tasklog.matching(task_log(spark, d), keyword="k 12\\%").select("task_id")


@query(f"SELECT count(*) AS n FROM {LOG} l")
def empty_filters(spark, d):
    return tasklog.matching(task_log(spark, d), status="", since="", until="", keyword="").agg(F.count("*").alias("n"))


@query(f"SELECT task_id FROM {LOG} l WHERE status = 'COMPLETED' AND is_batch = false AND (contains(lower(filename), '7') OR contains(title, '7')) AND requested_at >= TIMESTAMP '1994-01-01'")
def combined_filters(spark, d):
    return tasklog.matching(task_log(spark, d), "COMPLETED", False, "1994-01-01 00:00:00", keyword="7").select("task_id")


@query(f"SELECT task_id, requested_at FROM {LOG} l ORDER BY requested_at DESC NULLS FIRST, task_id DESC LIMIT 20 OFFSET 20")
def page_two(spark, d):
    return tasklog.page(task_log(spark, d), 2, 20).select("task_id", "requested_at")


@query(f"SELECT task_id, requested_at, status FROM {LOG} l WHERE is_batch = false AND (status = 'PROCESSING' OR (status IN ('COMPLETED', 'FAILED') AND requested_at >= TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR))")
def active_tasks(spark, d):
    return tasklog.active(task_log(spark, d), AS_OF).select("task_id", "requested_at", "status")


@query(f"SELECT task_id, CASE WHEN status = 'COMPLETED' AND requested_at < TIMESTAMP '1995-01-01' - INTERVAL 24 HOUR THEN 'RETRIEVED' ELSE status END AS status FROM {LOG} l")
def archive_completed(spark, d):
    return tasklog.archived(task_log(spark, d), "1995-01-01 00:00:00").select("task_id", "status")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def event_latest_state(spark, d):
    return tasklog.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query(f"SELECT task_id FROM {LOG} l WHERE batch_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_keys(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("batch_id"))
    return tasklog.without(task_log(spark, d), gone, "batch_id").select("task_id")


@query(f"SELECT count(*) AS n FROM {LOG} l WHERE status = 'COMPLETED' AND requested_at < TIMESTAMP '1995-01-01' - INTERVAL 24 HOUR")
def archive_count(spark, d):
    seen = Observation("archived")
    tasklog.archived(task_log(spark, d), "1995-01-01 00:00:00", seen=seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"],)], "n long")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphan_batches(spark, d):
    used = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return tasklog.without(table(spark, d, "customer").select("c_custkey"), used, "c_custkey")


@query("""SELECT l_linestatus AS model, count(*) AS items, round(sum(l_quantity * 1000 / 1e6 * CASE l_returnflag WHEN 'A' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 1.0 END), 4) AS cost FROM lineitem GROUP BY 1""")
def price_totals(spark, d):
    cost = tasklog.price(F.col("l_quantity") * 1000, F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.3), F.col("l_linenumber") % 2 == 0)
    return table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("model")).agg(F.count("*").alias("items"), F.round(F.sum(cost), 4).alias("cost"))


@query(f"SELECT file_id, line_no, {sql_clock('start_ms', ',')} AS begins, {sql_clock('end_ms', ',')} AS ends FROM {ENDS} e")
def cue_srt_rows(spark, d):
    c = timeline.with_ends(cues(spark, d))
    return c.select("file_id", "line_no", timeline.clock(F.col("start_ms"), ",").alias("begins"), timeline.clock(F.col("end_ms"), ",").alias("ends"))


#: lyrics() of the reader, in SQL, as lines.
LINES = rf"""(SELECT file_id, line_no, start_ms, CASE WHEN line_no % 5 = 4 THEN 'note ' || text ELSE '[' || lpad(CAST(start_ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(start_ms // 1000 % 60 AS VARCHAR), 2, '0') || '.'
 || CASE WHEN line_no % 2 = 0 THEN lpad(CAST(start_ms % 1000 AS VARCHAR), 3, '0') ELSE lpad(CAST(start_ms % 1000 // 10 AS VARCHAR), 2, '0') END || ']' || CASE WHEN line_no % 2 = 0 THEN ' Speaker A: ' ELSE ' ' END || text END AS line,
 CASE WHEN line_no % 2 = 0 THEN start_ms ELSE start_ms // 10 * 10 END AS ms, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM {CUES} c)"""
TIMED = f"(SELECT *, coalesce(lead(ms) OVER w, ms + 5000) AS end_ms, row_number() OVER w AS number FROM {LINES} l WHERE line_no % 5 <> 4 WINDOW w AS (PARTITION BY file_id ORDER BY line_no))"


@query(f"SELECT file_id, number, ms AS start_ms, text FROM {TIMED} t")
def cue_parse(spark, d):
    lines = lyrics(spark, d).select("file_id", F.posexplode(F.split("lrc", "\n")).alias("line_no", "line"))
    return timeline.with_ends(timeline.parse_lines(lines)).select("file_id", F.col("number").cast("long").alias("number"), "start_ms", "text")


def sql_blocks(mark: str, number: str) -> str:
    return f"string_agg({number}{sql_clock('ms', mark)} || ' --> ' || {sql_clock('end_ms', mark)} || chr(10) || text || chr(10), chr(10) ORDER BY line_no)"


@query(f"""SELECT l.file_id, string_agg(line, chr(10) ORDER BY line_no) AS lrc, coalesce(srt, '') AS srt, coalesce(vtt, '') AS vtt, coalesce(txt, '') AS txt FROM {LINES} l LEFT JOIN
 (SELECT file_id, {sql_blocks(',', 'number || chr(10) || ')} AS srt, 'WEBVTT' || chr(10) || chr(10) || {sql_blocks('.', '')} AS vtt, string_agg(text, chr(10) ORDER BY line_no) AS txt FROM {TIMED} t GROUP BY file_id) m
 ON l.file_id = m.file_id GROUP BY l.file_id, srt, vtt, txt""")
def convert_formats(spark, d):
    return timeline.converted(lyrics(spark, d), "lrc")


@query("".join(f"{' UNION ALL ' if i else ''}SELECT 'talk_' || file_id || '.{fmt}' AS file, {fmt} AS content FROM ({ORACLES['convert_formats']}) c" for i, fmt in enumerate(("lrc", "srt", "vtt", "txt"))))
def document_files(spark, d):
    """Every file in four formats, each text written as a file of its own and read again."""
    folder = new_folder(spark, "documents")
    made = timeline.converted(lyrics(spark, d), "lrc").select(F.concat(F.lit("talk_"), F.col("file_id").cast("string")).alias("name"), "lrc", "srt", "vtt", "txt")
    sinks.texts(made.unpivot(["name"], ["lrc", "srt", "vtt", "txt"], "fmt", "text"), folder)
    back = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return back.select(F.regexp_extract("_metadata.file_name", "([^/]+)$", 1).alias("file"), F.col("value").alias("content"))


@query(f"""SELECT file_id, string_agg(CASE WHEN line_no % 5 = 4 THEN line ELSE '[' || lpad(CAST((ms + 65500) // 60000 AS VARCHAR), 2, '0') || ':' || printf('%05.2f', ((ms + 65500) / 1000 + 0e0) - 60 * ((ms + 65500) // 60000)) || ']'
 || substr(line, strpos(line, ']') + 1) END, chr(10) ORDER BY line_no) AS lrc FROM (SELECT file_id, line_no, line, ms - ms % 10 AS ms FROM {LINES} x) l GROUP BY file_id""")
def shift_times(spark, d):
    even = F.regexp_replace("lrc", r"(?m)^(\[\d\d:\d\d\.\d\d)\d\]", "$1]")  # two digits, so that no rounding of a half is asked for
    return lyrics(spark, d).select("file_id", timeline.shifted(even, 65.5).alias("lrc"))


def _document(style: str):
    def run(spark, d):
        return timeline.document(timeline.with_ends(cues(spark, d)), style)

    mark, head, number = ("," if style == "srt" else "."), ("'WEBVTT' || chr(10) || chr(10) || " if style == "vtt" else ""), ("number || chr(10) || " if style == "srt" else "")
    body = "text" if style == "txt" else f"{number}{sql_clock('start_ms', mark)} || ' --> ' || {sql_clock('end_ms', mark)} || chr(10) || text || chr(10)"
    QUERIES[f"{style}_document"] = run
    ORACLES[f"{style}_document"] = f"SELECT file_id, {head}string_agg({body}, chr(10) ORDER BY line_no) AS content FROM {ENDS} e GROUP BY file_id"


for _style in ("srt", "vtt", "txt"):
    _document(_style)

FLAGS = "(SELECT user_id, event_id, event_type <> 'error' AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)"


def _flags(spark, d):
    return table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("flag"))


@query(f"SELECT user_id, flag, min(place) AS first, max(place) AS last, count(*) AS length FROM (SELECT *, place - row_number() OVER (PARTITION BY user_id, flag ORDER BY place) AS g FROM {FLAGS} f) r GROUP BY user_id, flag, g")
def speech_runs(spark, d):
    return timeline.runs(_flags(spark, d), "user_id", ["ts", "event_id"]).drop("run")


@query(f"""WITH c AS (SELECT *, CASE WHEN flag = lag(flag) OVER w THEN 0 ELSE 1 END AS turn FROM {FLAGS} f WINDOW w AS (PARTITION BY user_id ORDER BY place)),
 n AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY place) AS run FROM c), r AS (SELECT user_id, run, flag, min(place) AS first, max(place) AS last, count(*) AS length FROM n GROUP BY 1, 2, 3),
 s AS (SELECT *, flag OR (length < 2 AND run < max(run) OVER (PARTITION BY user_id)) AS "on" FROM r), t AS (SELECT *, CASE WHEN "on" = lag("on") OVER (PARTITION BY user_id ORDER BY run) THEN 0 ELSE 1 END AS turn FROM s),
 g AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY run) AS g FROM t) SELECT user_id, "on", min(first) AS first, max(last) AS last FROM g GROUP BY user_id, "on", g""")
def silence_fill(spark, d):
    return timeline.filled(_flags(spark, d), "user_id", ["ts", "event_id"], gap=2)


@query("""WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS e FROM events),
 m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM i),
 g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
 SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, g""")
def merge_intervals(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return timeline.merged(table(spark, d, "events").select("user_id", at.alias("start"), (at + F.floor("value").cast("long") * 60000000).alias("end")), "user_id")


@query("""WITH l AS (SELECT *, lag(ts) OVER w AS p, lag(event_type) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT event_id, CAST(sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) > 600000000 OR event_type <> k THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l""")
def session_clusters(spark, d):
    return timeline.sessions(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id").select("event_id", "session")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len(embedding) + 1e-10), 6) AS rms FROM embeddings")
def frame_rms(spark, d):
    return timeline.frame_rms(table(spark, d, "embeddings"), "embedding").select("vec_id", F.round("rms", 6).alias("rms"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_state_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT p_partkey, regexp_replace(p_name || '.v1.mp3', '\\.[^.]+$', '') AS stem FROM part")
def file_stems(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.stem(F.concat("p_name", F.lit(".v1.mp3"))).alias("stem"))


@query("SELECT doc_id, 'len=' || length(text) || ' md5=' || substr(md5(text), 1, 8) AS mark FROM documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.fingerprint(F.col("text")).alias("mark"))
