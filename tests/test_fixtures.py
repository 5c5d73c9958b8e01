"""Hand-worked cases of formats, history, batches and writers."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from cuebook.functions import labels, scalars
from cuebook.operators import batches, pricing, queue, segments, tasklog, timeline
from cuebook.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_timed_lines(spark):
    lines = ["[00:01.00] Hello", "[00:05.5] no", "[01:30.123] Speaker A: World ", "[100:00.00] no", " [00:01.00] no", "[00:01.50]x"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "file_id int, line_no int, line string")
    got = [(r.start_ms, r.end_ms, r.number, r.text) for r in timeline.with_ends(timeline.parse_lines(df)).orderBy("line_no").collect()]
    assert got == [(1000, 90123, 1, "Hello"), (90123, 1500, 2, "World"), (1500, 6500, 3, "x")]


def test_clock_cuts_and_clamps(spark):
    ms = lambda x: one(spark, timeline.clock(F.lit(x), ","))
    assert [ms(4349.6), ms(-5000), ms(5025500), ms(100 * 3600000)] == ["00:00:04,349", "00:00:00,000", "01:23:45,500", "100:00:00,000"]
    assert one(spark, timeline.stamp(F.lit(120 * 60000 + 10))) == "[120:00.01]"


def test_conversion_of_odd_texts(spark):
    rows = spark.createDataFrame([(0, None), (1, " \n"), (2, "plain\nlines"), (3, "  [00:01.00]a\nx\n[00:02.50] b \n")], "k int, t string")
    got = [(r.lrc, r.srt, r.vtt, r.txt) for r in timeline.converted(rows, "t").orderBy("k").collect()]
    assert got[0] == got[1] == ("", "", "", "") and got[2] == ("plain\nlines", "", "", "")
    assert got[3][1] == "1\n00:00:01,000 --> 00:00:02,500\na\n\n2\n00:00:02,500 --> 00:00:07,500\nb\n"
    assert got[3][2].startswith("WEBVTT\n\n00:00:01.000 --> ") and got[3][3] == "a\nb"


def test_shift(spark):
    assert one(spark, timeline.shifted(F.lit("[00:59.50]a\nnot timed\n[00:00.00] b"), 65.5)) == "[02:05.00]a\nnot timed\n[01:05.50] b"
    assert one(spark, timeline.shifted(F.lit(" x "), 0)) == " x "


def test_remapped_text(spark):
    seg = spark.createDataFrame([(1, 0, 0, 190), (1, 1, 500, 800)], "file_id int, seg_no int, start int, end int")
    cues = spark.createDataFrame([(1, 0, 100, "Speaker A: a"), (1, 1, 190, "b"), (1, 2, 450, "c"), (1, 3, 490, "gone"), (2, 0, 5, "x")], "file_id int, line_no int, start_cs int, text string")
    assert {r.file_id: r.lrc for r in timeline.remapped_text(cues, seg).collect()} == {1: "[00:01.00]a\n[00:05.00]b\n[00:07.60]c", 2: ""}


def test_stats_keep_parts_of_a_cent(spark):
    rows = [("COMPLETED", 1000, 0.001, 60.0, 10.0), ("COMPLETED", 2000, 0.002, 30.0, 20.0), ("PROCESSING", None, None, None, 99.0)]
    r = tasklog.stats(spark.createDataFrame(rows, "status string, tokens long, cost double, duration double, processing double")).first()
    assert (r.total, r.cost, r.tokens, r.duration, r.processing, r.success_rate) == (3, 0.003, 3000, 90.0, 15.0, 66.7)


def test_active_and_filters(spark):
    at = lambda h: datetime(2024, 1, 1, 12 - h)
    rows = [(1, "PROCESSING", at(10), False), (2, "COMPLETED", at(6), False), (3, "FAILED", at(7), False), (4, "RETRIEVED", at(0), False), (5, "PROCESSING", at(0), True), (6, "PROCESSING", at(0), None)]
    log = spark.createDataFrame(rows, "task_id int, status string, requested_at timestamp_ntz, is_batch boolean").withColumn("filename", F.concat(F.lit("A_b%"), "task_id")).withColumn("title", F.lit(r"c:\d"))
    ids = lambda d: sorted(r.task_id for r in d.collect())
    assert ids(tasklog.active(log, "2024-01-01 12:00:00")) == [1, 2]
    assert ids(tasklog.matching(log, is_batch=False)) == [1, 2, 3, 4] and ids(tasklog.matching(log, status="", keyword="")) == [1, 2, 3, 4, 5, 6]
    assert ids(tasklog.matching(log, keyword="A%4")) == [4] and ids(tasklog.matching(log, keyword=r"a\_B\%3")) == [3] and len(ids(tasklog.matching(log, keyword=r":\d"))) == 6


def test_transcripts_are_trimmed(spark):
    jobs = spark.createDataFrame([("b", '{"f1": "u1", "f2": "u2"}', '{"f1": {"transcripts": {"lrc": " x "}}, "f2": {"transcripts": {"lrc": "  "}}}'), ("broken", "{", "[")], "batch_id string, file_log_uuids_json string, results_json string")
    log = spark.createDataFrame([("u1", "b", None), ("u2", "b", None), ("u3", "b", " own "), ("u4", "broken", "")], "task_id string, batch_id string, lrc_content string")
    assert {r.task_id: r.transcript for r in batches.transcripts(log, jobs).collect()} == {"u1": "x", "u2": None, "u3": "own", "u4": None}


def test_prices(spark):
    rows = [("t", 0, "nobody", 1000000, 1000000, "audio"), ("u", 0, "gemini-2.5-flash", 100, 50, "text"), ("u", 1, "gemini-2.5-flash", 200, 80, "text")]
    items = spark.createDataFrame(rows, "task string, place int, model string, input_tokens long, output_tokens long, content_type string")
    got = {r.task: r for r in pricing.totals(pricing.priced(items, pricing.price_table(spark)), "task", "place").collect()}
    assert got["t"].cost == 3.5 and got["u"].tokens == 430 and [b.input_tokens for b in got["u"].breakdown] == [100, 200]


def test_sessions_and_clusters(spark):
    b = spark.createDataFrame([("s", datetime(2024, 1, 1), 0, ["a", "b", "c"])], "session_id string, started_at timestamp_ntz, file_count int, files array<string>")
    assert batches.session_tasks(b, spark.createDataFrame([("s", datetime(2024, 1, 2))], "session_id string, started_at timestamp_ntz")).first().files == 4
    at = lambda m: datetime(2024, 1, 1, 23, m) if m < 60 else datetime(2024, 1, 2, 0, m - 60)
    rows = [(0, at(45), "A"), (1, at(55), "A"), (2, at(60), "B"), (3, at(61), "A"), (4, at(75), "A"), (5, None, "A"), (6, None, "A"), (7, at(80), None)]
    got = {r.k: r.cluster for r in timeline.clusters(spark.createDataFrame(rows, "k int, t timestamp_ntz, m string"), "t", "m", "k").collect()}
    assert got == {5: 1, 6: 2, 0: 3, 1: 3, 2: 4, 3: 5, 4: 6, 7: 7}


def test_folding_and_recovery(spark):
    e = spark.createDataFrame([("a", 1, "PROCESSING", "x"), ("a", 2, "COMPLETED", "done"), ("a", 3, "PROCESSING", "late"), ("b", 1, "PROCESSING", "p"), ("b", 2, "PROCESSING", "q")], "file_uid string, seq int, status string, text string")
    assert {r.file_uid: (r.status, r.text) for r in queue.folded(e).collect()} == {"a": ("COMPLETED", "done"), "b": ("PROCESSING", "q")}
    jobs = spark.createDataFrame([("b1", "RECOVERING", '{"10": {"file_uid": "u", "original_filename": "n"}}'), ("b2", "UPLOADING", "{")], "batch_id string, status string, file_mapping_json string")
    assert {(r.batch_id, r.place, r.status) for r in queue.recovered(jobs).collect()} == {("b1", 10, "POLLING"), ("b2", None, "FAILED")}


def test_small_scalars(spark):
    assert one(spark, scalars.safe_name(F.lit(" a<b>\x01c. "))) == "a_b__c" and one(spark, scalars.safe_name(F.lit(" . "))) == "audio"
    assert one(spark, scalars.folder_name(F.lit("x/y:z.tar.gz"), F.lit("--"))) == "y_z.tar_task"
    assert one(spark, labels.tier(F.lit("FLEX"), F.lit("standard"))) == "flex" and one(spark, scalars.millis(F.lit("?"))) == 0
    assert one(spark, batches.liveness(F.lit("POLLING"), F.lit(None).cast("boolean"), F.lit(300))) is None


def test_failed_parts_stop_a_task(spark):
    p = spark.createDataFrame([("a", 0, 5, True, False), ("a", 1, 6, True, None), ("b", 0, 1, True, True)], "k string, n int, tokens int, flex boolean, bad boolean").withColumn("text", F.col("n").cast("string"))
    assert [(r.k, r.tokens, r.text) for r in segments.joined_results(p, "k", "n", failed="bad").collect()] == [("a", 11, "0\n1")]


def test_writers(spark, tmp_path):
    d = str(tmp_path)
    sinks.append(spark.createDataFrame([(1,)], "a int"), d + "/t")
    sinks.append(spark.createDataFrame([(2, "x")], "a int, b string"), d + "/t")
    assert {(r.a, r.b) for r in sinks.scan(spark, d + "/t").collect()} == {(1, None), (2, "x")}
    sinks.record(spark.createDataFrame([("t", "split", 3.5)], "task_id string, operation string, at double"), d + "/audit")
    assert spark.read.json(d + "/audit").first().details == '{"at":3.5}'
    log = spark.createDataFrame([(1, "a.mp3", "COMPLETED", "[00:01.00]x\n[00:02.00]y"), (2, "b.mp3", "FAILED", "[00:01.00]z"), (3, "c.mp3", "COMPLETED", "plain"), (4, "a.wav", "COMPLETED", "[00:01.00]z")], "task_id int, filename string, status string, transcript string")
    sinks.bundle(log, d + "/out", "TXT")
    assert {f: (tmp_path / "out" / f).read_text() for f in os.listdir(d + "/out")} == {"a.txt": "x\ny", "a(1).txt": "z"}
