"""Queries of the history list, prices and scalar functions, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuebook.functions import labels, scalars
from cuebook.operators import batches, pages, pricing, queue, segments, tasklog, timeline
from cuebook.plans.shared_sql import CUES, LOG
from cuebook.sources import changelog
from cuebook.sources.scratch import new_folder
from cuebook.sources.tables import cues, table, task_log

QUERIES, ORACLES = {}, {}
PRICES = "(VALUES " + ", ".join(f"('{m}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for m, a, b, c in pricing.PRICES) + ") p(model, text, audio, output)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@query(f"SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 20) AS BIGINT), 1) AS pages FROM {LOG} l WHERE status = 'FAILED'")
def page_counts(spark, d):
    return tasklog.page_counts(tasklog.matching(task_log(spark, d), status="FAILED"), 20)


@query(f"SELECT task_id FROM {LOG} l ORDER BY requested_at DESC NULLS FIRST, task_id DESC LIMIT 100")
def page_bounds(spark, d):
    return tasklog.page(task_log(spark, d), 0, 5000).select("task_id")


@query(f"SELECT task_id FROM {LOG} l ORDER BY requested_at DESC NULLS FIRST, task_id DESC LIMIT 20 OFFSET 11980")
def page_deep(spark, d):
    return tasklog.page(task_log(spark, d), 600, 20).select("task_id")


@query(f"SELECT task_id, status FROM {LOG} l ORDER BY requested_at DESC NULLS FIRST, task_id DESC LIMIT 50 OFFSET 700")
def page_in_ranges(spark, d):
    """The log written in the list's order; a page from the middle of it."""
    held = pages.Pages(spark, new_folder(spark, "pages"))
    held.write(task_log(spark, d), 400)
    return held.page(15, 50).select("task_id", "status")


@query(f"SELECT task_id FROM (SELECT * FROM {LOG} l ORDER BY requested_at DESC NULLS FIRST, task_id DESC LIMIT 40 OFFSET 300) ORDER BY 1")
def page_after_row(spark, d):
    log = task_log(spark, d)
    last = tasklog.page(log, 6, 50).orderBy(F.col("requested_at"), "task_id").first()
    return pages.after(log, last.requested_at, last.task_id, 40).select("task_id")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 'ADDED', NULL FROM customer WHERE c_custkey % 11 = 0)
 SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'LAST' WHEN c_custkey % 7 = 0 AND c_custkey < 1000000 THEN 'PUT' WHEN c_custkey % 5 = 0 AND c_custkey < 1000000 THEN 'SET' ELSE c_mktsegment END AS c_mktsegment,
 CASE WHEN c_custkey % 7 = 0 AND c_custkey < 1000000 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM c WHERE c_custkey % 13 > 0""")
def change_log(spark, d):
    """Customers kept as a log of changes: set, put, added, deleted, compacted and set again."""
    c, k = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_custkey")
    log = changelog.ChangeLog(spark, new_folder(spark, "changes"), "c_custkey", c.schema, 8)
    log.put(c, 1)
    log.update(c.where(k % 5 == 0).select("c_custkey", F.lit("SET").alias("c_mktsegment")), 2)
    log.put(c.where(k % 7 == 0).select("c_custkey", F.lit("PUT").alias("c_mktsegment"), F.lit(-1.0).alias("c_acctbal")).unionByName(c.where(k % 11 == 0).select((k + 1000000).alias("c_custkey"), F.lit("ADDED").alias("c_mktsegment")), allowMissingColumns=True), 3)
    log.delete(log.current().where(k % 13 == 0), 4)
    log.compact()
    log.update(spark.range(1, 3_000_000).where("id % 3 = 0").select(F.col("id").alias("c_custkey"), F.lit("LAST").alias("c_mktsegment")), 5)
    return log.current()


@query(f"""SELECT strftime(requested_at, '%Y-%m-%d %H:%M:%S') AS requested_at, strftime(completed_at, '%Y-%m-%d %H:%M:%S') AS completed_at, task_id, status, cost, tokens, duration, processing, model, batch_id, is_batch,
 filename, title, session_id, file_uid, provider, source_language, target_language, error_message, lrc_content IS NOT NULL OR task_id % 3 = 0 AS has_transcript FROM {LOG} l""")
def history_rows(spark, d):
    log = task_log(spark, d)
    held = log.where("task_id % 3 = 0").groupBy("batch_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("file_uid", F.col("task_id").cast("string"))))).alias("file_log_uuids_json"), F.to_json(F.map_from_entries(F.collect_list(F.struct("file_uid", F.struct(F.create_map(F.lit("lrc"), F.lit(" x ")).alias("transcripts")))))).alias("results_json"))
    return tasklog.response(batches.transcripts(log, held))


@query(f"SELECT task_id, status FROM {LOG} l WHERE task_id = 7")
def point_lookup(spark, d):
    log = task_log(spark, d).select("task_id", "status")
    return tasklog.lookup(log, "task_id", "7").unionByName(tasklog.lookup(log, "task_id", "no key"))


@query(f"SELECT task_id, CASE WHEN task_id = 7 THEN 'RETRIEVED' ELSE status END AS status FROM {LOG} l")
def dismiss_task(spark, d):
    return tasklog.with_status(task_log(spark, d), "task_id", 7, "RETRIEVED").select("task_id", "status")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'error')")
def live_states(spark, d):
    return tasklog.in_states(table(spark, d, "events"), ("click", "view", "error"), "event_type").select("event_id", "event_type")


ITEMS = "(SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'gemini-3.5-flash' WHEN 'N' THEN 'gemini-1.5-pro-latest' ELSE 'other' END AS model, CAST(floor(l_quantity) AS BIGINT) * 1000 AS input_tokens, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_linenumber AS BIGINT) * 500 END AS output_tokens, CASE WHEN l_linenumber % 2 = 0 THEN 'audio' ELSE 'text' END AS content_type FROM lineitem)"
PRICED = f"""(SELECT i.*, i.input_tokens / 1e6 * CASE WHEN content_type = 'audio' THEN coalesce(p.audio, q.audio) ELSE coalesce(p.text, q.text) END AS input_cost, coalesce(i.output_tokens, 0) / 1e6 * coalesce(p.output, q.output) AS output_cost
 FROM {ITEMS} i LEFT JOIN {PRICES} ON i.model = p.model JOIN {PRICES.replace(') p(', ') q(')} ON q.model = 'default')"""


def _items(spark, d):
    """lineitem in the role of priced items."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    model = F.when(flag == "A", "gemini-3.5-flash").when(flag == "N", "gemini-1.5-pro-latest").otherwise("other")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", model.alias("model"), (F.floor("l_quantity").cast("long") * 1000).alias("input_tokens"), F.when(line % 4 > 0, line.cast("long") * 500).alias("output_tokens"), F.when(line % 2 == 0, "audio").otherwise("text").alias("content_type"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(input_cost, 9) AS input_cost, round(output_cost, 9) AS output_cost, round(input_cost + output_cost, 9) AS cost FROM {PRICED} x")
def price_items(spark, d):
    p = pricing.priced(_items(spark, d), pricing.price_table(spark))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 9).alias(c) for c in ("input_cost", "output_cost", "cost")])


@query(f"""SELECT l_orderkey, CAST(sum(input_tokens + coalesce(output_tokens, 0)) AS BIGINT) AS tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, round(sum(input_cost + output_cost) * CASE WHEN bool_or(l_linenumber = 5) THEN 0.5 ELSE 1 END, 6) AS cost, round(sum(input_cost + output_cost), 6) AS listed,
 string_agg(content_type || ':' || input_tokens, ',' ORDER BY l_linenumber, content_type, input_tokens) AS items FROM {PRICED} x GROUP BY 1""")
def price_breakdown(spark, d):
    p = pricing.priced(_items(spark, d), pricing.price_table(spark)).withColumn("flex", F.col("l_linenumber") == 5)
    t = pricing.totals(p, "l_orderkey", "l_linenumber", "flex")
    listed = F.aggregate("breakdown", F.lit(0.0), lambda a, b: a + b["cost"])
    items = F.array_join(F.transform("breakdown", lambda b: F.concat(b["content_type"], F.lit(":"), b["input_tokens"].cast("string"))), ",")
    return t.select("l_orderkey", "tokens", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), F.round(listed, 6).alias("listed"), items.alias("items"))


@query("SELECT l_orderkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(l_linenumber) AS BIGINT) AS input_tokens, CAST(sum(l_linenumber * 2) AS BIGINT) AS output_tokens, bool_and(l_returnflag <> 'R') AS all_flex, CASE WHEN bool_or(l_returnflag = 'R') THEN 'standard' ELSE 'flex' END AS tier FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linenumber = 6)")
def split_rollup(spark, d):
    line = F.col("l_linenumber").cast("long")
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("long").alias("tokens"), line.alias("input_tokens"), (line * 2).alias("output_tokens"), (F.col("l_returnflag") != "R").alias("flex"), (line == 6).alias("failed"), F.lit("").alias("text"))
    done = segments.joined_results(parts, "l_orderkey", "l_linenumber", tokens=("tokens", "input_tokens", "output_tokens"), failed="failed")
    return done.select("l_orderkey", "tokens", "input_tokens", "output_tokens", "all_flex", labels.tier(F.lit(None).cast("string"), F.when(F.col("all_flex"), "flex").otherwise("standard")).alias("tier"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'flex' WHEN 1 THEN 'priority' ELSE 'standard' END AS tier FROM events")
def tiers(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select("event_id", labels.tier(F.when(k == 0, "FLEX").when(k == 1, "Priority").when(k == 2, "odd"), F.lit("standard")).alias("tier"))


@query("SELECT event_id, attempt, least(60, 10 * pow(1.5, attempt)) AS delay FROM (SELECT event_id, unnest(generate_series(0, 7)) AS attempt FROM events WHERE event_type = 'signup')")
def retry_delays(spark, d):
    e = table(spark, d, "events").where("event_type = 'signup'").select("event_id")
    return queue.delays(e, F.lit(8), 10, 1.5, 60).select("event_id", F.col("attempt").cast("long").alias("attempt"), "delay")


@query("""SELECT vec_id, round(max(abs(v)), 6) AS loudest, round(avg(v * v), 6) AS mean_square, round(CASE WHEN max(abs(v)) >= 1e-4 THEN greatest(max(abs(v)) * 0.005, 0.0005) END, 9) AS level
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1""")
def frame_levels(spark, d):
    e = segments.levels(table(spark, d, "embeddings"), "embedding")
    return e.select("vec_id", F.round("loudest", 6).alias("loudest"), F.round("mean_square", 6).alias("mean_square"), F.round(labels.threshold(F.col("loudest")), 9).alias("level"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 0.75)), 6) AS total FROM embeddings")
def down_mix(spark, d):
    mixed = scalars.down_mix(F.col("embedding"), F.transform("embedding", lambda x: x.cast("double") / 2))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"""WITH s AS (SELECT conv_id AS file_id, turn * 1500 + conv_id % 7 * 40 AS start, turn * 1500 + 600 + turn % 3 * 350 AS "end", turn AS seg_no FROM conversations),
 b AS (SELECT *, coalesce(sum("end" - start) OVER (PARTITION BY file_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
 c AS (SELECT file_id, line_no, line_no * 725 + file_id % 10 * 10 AS cs, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM {CUES} x),
 m AS (SELECT c.file_id, line_no, CAST(b.start + cs - before AS BIGINT) AS t, text FROM c JOIN b ON c.file_id = b.file_id AND cs >= before AND cs < before + b."end" - b.start)
 SELECT f.file_id, coalesce(string_agg('[' || lpad(CAST(t // 6000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0') || ']' || text, chr(10) ORDER BY line_no), '') AS lrc
 FROM (SELECT DISTINCT file_id FROM c) f LEFT JOIN m ON f.file_id = m.file_id GROUP BY f.file_id""")
def remap_text(spark, d):
    t = table(spark, d, "conversations")
    parts = t.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("seg_no"), (F.col("turn") * 1500 + F.col("conv_id") % 7 * 40).alias("start"), (F.col("turn") * 1500 + 600 + F.col("turn") % 3 * 350).alias("end"))
    c = cues(spark, d).select("file_id", "line_no", "start_cs", F.concat(F.lit(" Speaker B: "), F.regexp_replace("text", r"^\s+", "")).alias("text"))
    return timeline.remapped_text(c, parts)


@query("SELECT p_partkey, regexp_replace(p_brand, '#', '_') || '_' || replace(p_name, ' ', '_') || '_' || 'T' || substr(CAST(p_partkey * 7919 AS VARCHAR), 1, 11) AS folder FROM part")
def folder_names(spark, d):
    name = F.concat(F.lit("/up/ "), F.regexp_replace("p_brand", "#", ":"), F.lit("?"), F.translate("p_name", " ", "*"), F.lit(". .mp3"))
    return table(spark, d, "part").select("p_partkey", scalars.folder_name(name, F.concat(F.lit("T-"), (F.col("p_partkey") * 7919).cast("string"))).alias("folder"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'audio/mpeg' WHEN 1 THEN 'audio/mp4' WHEN 2 THEN 'audio/opus' END AS mime FROM part")
def mime_types(spark, d):
    k = F.col("p_size") % 4
    return table(spark, d, "part").select("p_partkey", labels.mime(F.concat("p_name", F.when(k == 0, ".MP3").when(k == 1, ".m4a").when(k == 2, ".opus").otherwise(".xyz"))).alias("mime"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^\\s*Speaker\\s+[A-Z]:\\s*', '') AS said FROM documents")
def speaker_strip(spark, d):
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  Speaker Q:  "), labels.trimmed(F.col("text")))).otherwise(labels.trimmed(F.col("text")))
    return table(spark, d, "documents").select("doc_id", labels.without_speaker(said).alias("said"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN '0a0b0c0d-0000-1111-2222-' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS id, CASE WHEN event_id % 3 <> 1 THEN '0a0b0c0d000011112222' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS plain FROM events")
def uuid_lookup(spark, d):
    number = F.lpad(F.col("event_id").cast("string"), 12, "0")
    made = labels.valid_uuid(F.concat(F.when(F.col("event_id") % 3 == 1, "odd-").otherwise("0A0B0C0D-"), F.lit("0000-1111-2222-"), number))
    return table(spark, d, "events").select("event_id", made.alias("id"), scalars.plain_id(made).alias("plain"))


@query("SELECT event_id, CAST(round(m * 800) AS BIGINT) AS tokens, round(round(m * 800) * 1.5e-5, 6) AS cost, greatest(1.0, round(m * CAST(0.3 AS DOUBLE))) AS processing FROM (SELECT event_id, event_id % 97 * CAST(0.5 AS DOUBLE) AS m FROM events)")
def upload_estimates(spark, d):
    e = labels.estimate(F.col("event_id") % 97 * 0.5)
    return table(spark, d, "events").select("event_id", e["tokens"].alias("tokens"), F.round(e["cost"], 6).alias("cost"), e["processing"].alias("processing"))


@query("""SELECT event_id, strftime(ts, '%m/%d %H:%M') AS at, (s // 3600) || 'h ' || (s // 60 % 60) || 'm' AS length, CASE WHEN s >= 1000000 THEN printf('%.2fM', s / 1e6) WHEN s >= 1000 THEN printf('%.1fk', s / 1e3) ELSE CAST(s AS VARCHAR) END AS short, format('{:,}', s) AS full, printf('$%.4f', floor(s * 156.25e0 + 0.5e0) / 10000) AS price
 FROM (SELECT *, event_id * 311 % 5000000 // 100 * 100 + 30 AS s FROM events)""")
def display_texts(spark, d):
    s = F.floor(F.col("event_id") * 311 % 5000000 / 100) * 100 + 30
    return table(spark, d, "events").select("event_id", scalars.short_date(F.col("ts")).alias("at"), scalars.hours_minutes(s).alias("length"), scalars.short_number(s).alias("short"), scalars.thousands(s).alias("full"), scalars.money(s / 64.0).alias("price"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a,b' ELSE '' END AS keys, CASE WHEN doc_id % 3 = 0 THEN 'deep' END AS nested FROM documents")
def json_fallback(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, '["a","b"]').when(F.col("doc_id") % 3 == 1, '["a",')
    deep = F.when(F.col("doc_id") % 3 == 0, '{"f1": {"transcripts": {"lrc": " deep "}}}').otherwise('{"f1": {"transcripts": {"lrc": "  "}}}')
    return table(spark, d, "documents").select("doc_id", F.array_join(scalars.text_list(text), ",").alias("keys"), scalars.nested_text(deep, "f1", "transcripts", "lrc").alias("nested"))


@query("""SELECT page_id, contains(url, 'youtube.com') OR contains(url, 'youtu.be') OR page_id % 4 = 0 AS video, CASE WHEN page_id % 2 = 0 THEN 0 ELSE 86400000 * (page_id % 300) END AS ms, page_id % 3 = 0 AS family,
 CAST(format('{:.2f}', page_id + CASE page_id % 4 WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.675e0 WHEN 2 THEN 0.125e0 ELSE 0.005e0 END) AS DOUBLE) AS even, 'session-' || (86400000 * (page_id % 300)) || '-z' AS client FROM pages""")
def odd_scalars(spark, d):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, "https://youtu.be/x").otherwise(F.col("url"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (k % 300).cast("int"))
    model = F.when(k % 3 == 0, "gemini-3.5-flash").otherwise("gemini-2.5-flash")
    half = k + F.element_at(F.array(*map(F.lit, (0.25, 0.675, 0.125, 0.005))), (k % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", scalars.is_video_site(url).alias("video"), scalars.millis(F.when(k % 2 == 0, "no time").otherwise(day.cast("string"))).alias("ms"), scalars.of_family(model, "gemini-3").alias("family"), scalars.half_even(half, 2).alias("even"), scalars.client_id("session", day, F.lit(35)).alias("client"))


@query("SELECT doc_id, 'From ' || CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END || ': ' || CASE WHEN doc_id % 2 = 0 THEN 'many. ' ELSE '' END || CASE WHEN lang <> 'en' THEN (CASE WHEN doc_id % 2 = 0 THEN '7' ELSE '6' END) || ' to English' ELSE '' END AS prompt FROM documents WHERE lang IS NOT NULL")
def prompts(spark, d):
    names = F.create_map(*map(F.lit, ("en", "English", "de", "German")))
    made = scalars.prompt(F.lit("From {source_lang}: {speaker_instruction}{translate_instruction}\n\n"), F.col("lang"), F.lit("en"), F.col("doc_id") % 2 == 0, names, F.lit("many. "), F.lit("{n} to {target_lang}"))
    return table(spark, d, "documents").where("lang is not null").select("doc_id", made.alias("prompt"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n, count(*) > 20 AS truncated, least(count(*), 20) AS shown FROM conversations GROUP BY 1")
def previews(spark, d):
    listed = queue.grouped(table(spark, d, "conversations"), "conv_id", "turn", "role")
    p = queue.preview(F.col("items"))
    return listed.select("conv_id", F.size("items").cast("long").alias("n"), p["truncated"].alias("truncated"), F.size(p["preview"]).cast("long").alias("shown"))

