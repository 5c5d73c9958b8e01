"""Findings of round 3 on the core queries."""

import re

from cuebook.operators import pages, pricing, queue
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_are_not_dealt_by_model(spark, tmp_path):
    spark.range(100).select(F.lit("m").alias("model"), F.col("id").alias("input_tokens"), F.col("id").alias("output_tokens"), F.lit("text").alias("content_type")).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    p = pricing.priced(items, pricing.price_table(spark))
    assert "SortMergeJoin" not in plan(p) and "BroadcastHashJoin" in plan(p)
    assert p.count() == 100 and p.where("cost is null").count() == 0


def test_breakdown_deals_items_by_task_alone(spark, tmp_path):
    spark.range(100).select((F.col("id") % 9).alias("k"), F.col("id").alias("n"), F.lit("m").alias("model"), F.col("id").alias("input_tokens"), F.col("id").alias("output_tokens"), F.lit("text").alias("content_type")).write.parquet(str(tmp_path / "items"))
    t = pricing.totals(pricing.priced(spark.read.parquet(str(tmp_path / "items")), pricing.price_table(spark)), "k", "n")
    assert "hashpartitioning(k#" in plan(t) and not re.search(r"hashpartitioning\(model#\d+, \d+\)[^\n]*\n[^\n]*Scan parquet", plan(t)) and "SortMergeJoin" not in plan(t)
    assert {(r.k, len(r.breakdown)) for r in t.collect()} == {(k, 12 if k == 0 else 11) for k in range(9)}


def test_tasks_of_breakdown_grow_with_items(spark, tmp_path, monkeypatch):
    spark.range(1000).select((F.col("id") % 90).alias("k"), F.col("id").alias("n"), (F.col("id") % 7 == 0).alias("flex"), F.lit("m").alias("model"), F.col("id").alias("input_tokens"), F.col("id").alias("output_tokens"), F.lit("text").alias("content_type")).write.parquet(str(tmp_path / "items"))
    items = pricing.priced(spark.read.parquet(str(tmp_path / "items")), pricing.price_table(spark))
    want = {r.k: r for r in pricing.totals(items, "k", "n", "flex").collect()}
    monkeypatch.setattr(pricing, "TASK_ROWS", 40, raising=False)
    t = pricing.totals(items, "k", "n", "flex")
    assert re.search(r"hashpartitioning\(k#\d+L?, 25\)", plan(t)) and plan(t).count("hashpartitioning(k#") == 1
    got = {r.k: r for r in t.collect()}
    assert got.keys() == want.keys() and all(g.breakdown == want[k].breakdown and g.tokens == want[k].tokens and abs(g.cost - want[k].cost) < 1e-9 for k, g in got.items())


def test_small_ranges_make_few_files(spark, tmp_path, monkeypatch):
    log = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.timestamp_seconds(F.col("id") % 700)).alias("requested_at"), F.col("id").alias("task_id"))
    want = [r.task_id for r in log.orderBy(*pages.newest_first()).collect()]
    for rows, files in ((250_000, 1), (900, 4)):
        monkeypatch.setattr(pages, "FILE_ROWS", rows, raising=False)
        held = pages.Pages(spark, str(tmp_path / str(rows)))
        held.write(log, 10)
        assert len(list((tmp_path / str(rows) / "rows").glob("part=*"))) == files
        for number, size in ((1, 40), (7, 130), (3, 1000), (2, 2900), (31, 100)):
            got = held.page(number, size)
            assert got.columns == log.columns and [r.task_id for r in got.collect()] == want[(number - 1) * size : number * size]


def test_replay_orders_files_without_a_window(spark):
    mapping = '{"10": {"file_uid": "c"}, "2": {"file_uid": "b"}, "x": {"file_uid": "a"}, "1": {"original_filename": "no id"}}'
    files = queue.recovered(spark.createDataFrame([("j", "POLLING", mapping)], "batch_id string, status string, file_mapping_json string"))
    assert {(r.file_uid, r.nth) for r in files.collect()} == {("a", 0), ("b", 1), ("c", 2), (None, None)}
    answers = spark.createDataFrame([("j", k, f"said {k}") for k in range(3)], "batch_id string, place int, text string")
    got = queue.replayed(files, answers, spark.createDataFrame([("j", "JOB_STATE_SUCCEEDED")], "batch_id string, state string"))
    assert "Window" not in plan(got) and {(r.file_uid, r.text) for r in got.collect()} == {("a", "said 0"), ("b", "said 1"), ("c", "said 2")}
