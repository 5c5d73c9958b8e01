"""Change log, deep pages, exact rounding, observed counts and replay on small and odd rows."""

import os
import random
import re
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Observation
from pyspark.sql import functions as F

from cuebook.functions import scalars
from cuebook.operators import pages, pricing, queue, tasklog
from cuebook.sources import changelog


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_change_log_against_a_dict(spark, tmp_path):
    rng = random.Random(6)
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), "k", "k long, a string, b int", 4)
    held = {}

    def agrees():
        assert {r.k: (r.a, r.b) for r in log.current().collect()} == held

    for version in range(1, 9):
        keys = rng.sample(range(30), 8)
        kind = ("put", "update", "put", "delete", "update", "put", "delete", "update")[version - 1]
        if kind == "put":
            log.put(spark.createDataFrame([(k, f"p{version}", k) for k in keys] + [(None, "no key", 0)], "k long, a string, b int"), version)
            held |= {k: (f"p{version}", k) for k in keys}
        elif kind == "update":
            log.update(spark.createDataFrame([(k, None) for k in keys], "k long, b int"), version)
            held |= {k: (held[k][0], None) for k in keys if k in held}
        else:
            log.delete(spark.createDataFrame([(k,) for k in keys], "k long"), version)
            held = {k: v for k, v in held.items() if k not in keys}
        agrees()
        if version in (3, 6):
            assert log.compact() and not log.compact()
            agrees()


def test_compaction_leaves_other_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = changelog.ChangeLog(spark, folder, "k", "k long, a string", 8)
    log.put(spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("a")), 1)
    assert len(log.compact()) == 8
    before = files(folder)
    log.update(spark.createDataFrame([(5, "y")], "k long, a string"), 2)
    [bucket] = log.compact()
    after = files(folder)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f for f in before if f"_bucket={bucket}/" not in f} == same and len(same) >= 7
    keys = [r.k for r in log.changes().where((F.col("_bucket") == bucket) & F.col("k").isNotNull()).collect()]
    log.delete(spark.createDataFrame([(k,) for k in keys], "k long"), 3)  # a bucket that loses all its rows
    assert log.compact() == [bucket] and log.current().count() == 100 - len(keys)


def rows_of_log(n=900):
    rng = random.Random(8)
    at = lambda i: None if i % 45 == 0 else datetime(2020, 1, 1) + timedelta(hours=rng.randrange(30) * 700, milliseconds=rng.randrange(4))
    return [(i, at(i), "x") for i in range(n)]


def in_order(rows):
    return [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, -(r[1] - datetime(2000, 1, 1)).total_seconds() if r[1] else 0, -r[0]))]


def test_deep_pages_by_counts(spark):
    rows = rows_of_log()
    df, want = spark.createDataFrame(rows, "task_id long, requested_at timestamp_ntz, part string").repartition(4), in_order(rows)
    for near in (1, 60, 10_000):
        for number, size in ((1, 20), (2, 10), (7, 50), (18, 50), (19, 50), (400, 100)):
            got = [r.task_id for r in tasklog.page(df, number, size, near).collect()]
            assert got == want[(number - 1) * size : number * size], (near, number, size)
    assert tasklog.page(df.where("false"), 900, 100).count() == 0


def test_pages_in_ranges_and_after_a_row(spark, tmp_path):
    rows = rows_of_log()
    df, want = spark.createDataFrame(rows, "task_id long, requested_at timestamp_ntz, own string").repartition(4), in_order(rows)
    held = pages.Pages(spark, str(tmp_path / "p"))
    held.write(df, 100)
    for number, size in ((1, 20), (4, 30), (9, 100), (10, 100)):
        page = held.page(number, size)
        assert [r.task_id for r in page.collect()] == want[(number - 1) * size : number * size]
        assert (number - 1) * size >= len(want) or re.search(r"PartitionFilters: \[[^\]]*part#", page._jdf.queryExecution().executedPlan().toString())  # other ranges aren't read
    seen, last = [], None
    times = {r[0]: r[1] for r in rows}
    while True:
        got = [r.task_id for r in (pages.after(df, times[last], last, 150) if last is not None else tasklog.page(df, 1, 100)).collect()]
        if not got:
            break
        seen, last = seen + got, got[-1]
    assert seen == want
    held.write(df.where("false"))
    assert held.page(1, 10).count() == 0


def test_rounding_equals_pythons(spark):
    rng = random.Random(9)
    values = [2.675, 1.005, 0.125, 0.375, -0.125, 2.5, 3.5, 0.0, -0.0, 1e-12, 1e15 + 0.5, 123456789.125, 0.285, 5.015] + [rng.uniform(-1000, 1000) for _ in range(5000)] + [rng.randrange(-100000, 100000) / 8 for _ in range(2500)] + [rng.randrange(100000) / 1000 + 0.0005 for _ in range(2500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [r.r for r in df.select(scalars.half_even(F.col("v"), digits).alias("r")).collect()]
        bad = [(v, g, round(v, digits)) for v, g in zip(values, got, strict=True) if g != round(v, digits)]
        assert not bad, bad[:5]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double").select(scalars.half_even(F.col("v"), 2).alias("r")).collect()
    assert str(odd[0].r) == "nan" and odd[1].r == float("inf") and odd[2].r is None
    sums = [1.00005, 1.00015, 0.00025, 2.00003125]
    shown = [r.m for r in spark.createDataFrame([(x,) for x in [*sums, None]], "x double").select(scalars.money(F.col("x")).alias("m")).collect()]
    assert shown == [*(f"${Decimal(x).quantize(Decimal('0.0001'), ROUND_HALF_UP)}" for x in sums), "\u2014"]
    whole = spark.createDataFrame([(1234567,), (0,), (None,), (999,)], "n long").select(scalars.thousands(F.col("n")).alias("t")).collect()
    assert [r.t for r in whole] == ["1,234,567", "\u2014", "\u2014", "999"]


def test_observed_changes_take_one_pass(spark):
    log = spark.createDataFrame([(1, "COMPLETED", datetime(2020, 1, 1)), (2, "COMPLETED", datetime(2020, 1, 3)), (2, "FAILED", datetime(2020, 1, 1))], "task_id long, status string, requested_at timestamp_ntz")
    seen, one = Observation("a"), Observation("b")
    df = tasklog.archived(log, "2020-01-03 00:00:00", seen=seen)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.status for r in df.collect()] == ["RETRIEVED", "COMPLETED", "FAILED"] and seen.get["n"] == 1
    tasklog.with_status(log, "task_id", 7, "X", one).collect()
    assert one.get["n"] == 0


def test_replay_of_stored_jobs(spark):
    mapping = '{"10": {"file_uid": "c", "original_filename": "c.mp3"}, "9": {"file_uid": "b", "original_filename": "b.mp3", "vad_segments": [{"start": 1.5, "end": 2}]}, "0": {"file_uid": "a", "original_filename": "a.mp3"}}'
    rows = [("j", "POLLING", mapping, '{"a": 4.5}', '{"b": "id-b"}', '{"model": "m", "prompt": "p"}'), ("broken", "POLLING", "{", None, None, None), ("odd", "UPLOADING", mapping, "no json", None, None), ("none", "RETRIEVED", None, "", " ", None)]
    jobs = spark.createDataFrame(rows, "batch_id string, status string, file_mapping_json string, file_durations_json string, file_log_uuids_json string, task_params_json string")
    files = queue.recovered(jobs)
    got = {(r.batch_id, r.place): r for r in files.collect()}
    assert {k: r.status for k, r in got.items()} == {("j", 0): "POLLING", ("j", 9): "POLLING", ("j", 10): "POLLING", ("broken", None): "FAILED", ("odd", None): "FAILED", ("none", None): "RETRIEVED"}
    b = got[("j", 9)]
    assert (b.duration, b.task_id, b.model, b.provider, b.target_lang, b.prompt, b.segments[0].start) == (0.0, "id-b", "m", "google", None, "p", 1.5) and got[("j", 0)].duration == 4.5
    answers = spark.createDataFrame([("j", 0, "first"), ("j", 1, None)], "batch_id string, place int, text string")
    ended = lambda s: {r.file_uid: (r.status, r.text) for r in queue.replayed(files, answers, spark.createDataFrame([("j", s)], "batch_id string, state string")).collect()}
    assert ended("JOB_STATE_SUCCEEDED") == {"a": ("COMPLETED", "first"), "b": ("FAILED", None), "c": ("RECOVERING", None)}
    assert {s for s, _ in ended("JOB_STATE_RUNNING").values()} == {"POLLING"} and {s for s, _ in ended("JOB_STATE_FAILED").values()} == {"FAILED"}


def test_prices_with_two_default_rows(spark):
    prices = spark.createDataFrame([("default", 1.0, 1.0, 1.0), ("default", 2.0, 2.0, 2.0), ("m", 3.0, 3.0, 3.0)], "model string, text double, audio double, output double")
    items = spark.createDataFrame([("m", 1, 1000000, None, "text"), (None, 2, 1000000, 0, "audio"), ("new", 3, 0, 1000000, "x")], "model string, n int, input_tokens long, output_tokens long, content_type string")
    p = pricing.priced(items, prices)
    assert sorted((r.n, r.cost) for r in p.collect()) == [(1, 3.0), (2, 2.0), (3, 2.0)]
    t = pricing.totals(p.withColumn("k", F.lit(1)).withColumn("flex", F.when(F.col("n") == 2, True)), "k", "n", "flex").first()
    assert t.cost == 3.5 and sum(b.cost for b in t.breakdown) == 7.0
