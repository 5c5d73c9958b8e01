"""Streams over files: state by file, expiry, routing and sinks."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cuebook.operators import queue
from cuebook.sources import sinks
from cuebook.streaming import status

SCHEMA = "file_uid string, status string, text string, seq int, ts timestamp, client_id string, event_type string"
T0 = datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame([(f, s, t, i, T0 + timedelta(hours=h), "c" + f, s) for f, s, t, i, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_state_by_file_holds_and_expires(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))

    def step(rows):
        put(spark, src, rows)
        status.upserted_states(status.file_states(status.status_events(spark, src, SCHEMA)), out, ckpt).awaitTermination()
        return {r.file_uid: (r.status, r.text) for r in status.current(spark, out).collect()}

    assert step([("a", "PROCESSING", "x", 1, 0), ("a", "COMPLETED", "done", 2, 0), ("b", "PROCESSING", "p", 1, 0)]) == {"a": ("COMPLETED", "done"), "b": ("PROCESSING", "p")}
    assert step([("a", "PROCESSING", "late", 3, 1), ("b", "PROCESSING", "q", 2, 1)]) == {"a": ("COMPLETED", "done"), "b": ("PROCESSING", "q")}
    step([("z", "PROCESSING", "", 1, 48)])
    assert step([("z", "PROCESSING", "", 2, 49)])["a"] == ("RETRIEVED", "done")


def test_counts_routing_and_sink(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [("a", "PROCESSING", "x", 1, 0), ("b", "FAILED", "y", 2, 1), ("c", "FAILED", "z", 3, 1)])
    events = status.status_events(spark, src, SCHEMA)
    live = spark.createDataFrame([("ca", "old", 1), ("ca", "new", 2), ("cb", "only", 1)], "client_id string, connection string, seq int")
    sinks.publish(queue.routed(events, live).select("file_uid", "connection"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    got = {(r.f, r.c) for r in spark.read.text(str(tmp_path / "out")).select(F.get_json_object("value", "$.file_uid").alias("f"), F.get_json_object("value", "$.connection").alias("c")).collect()}
    assert got == {("a", "new"), ("b", "only")}
    batch = spark.read.schema(SCHEMA).parquet(src).withColumn("at", F.col("ts"))
    assert {(r.event_type, r.n) for r in status.counts_by_hour(batch).collect()} == {("PROCESSING", 1), ("FAILED", 2)}
