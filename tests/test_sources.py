"""Files a document, channels with offsets, live connections and states kept in RocksDB."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cuebook.sources import files, sinks
from cuebook.streaming import status

T0 = datetime(2024, 1, 1)


def found(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names}


def test_documents_are_files_of_their_own(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [("srt/a.srt", "1\nline\n"), ("é x.txt", "two\n\nlines"), ("none.txt", None)]
    files.write_documents(spark.createDataFrame(rows, "name string, text string").repartition(3), folder)
    want = {n: t or "" for n, t in rows}
    assert found(folder) == want
    files.write_documents(spark.createDataFrame([("b.txt", "x" * 100_000)], "name string, text string"), folder)
    assert found(folder) == want | {"b.txt": "x" * 100_000}
    files.write_documents(spark.createDataFrame([("c.txt", "c")], "name string, text string"), folder, mode="overwrite")
    assert found(folder) == {"c.txt": "c"}
    files.write_documents(spark.createDataFrame([], "name string, text string"), folder)
    assert found(folder) == {"c.txt": "c"}


@pytest.mark.parametrize("rows", [[("a.txt", "1"), ("a.txt", "2")], [("../up.txt", "x")], [(None, "x")], [("/root.txt", "x")]])
def test_a_write_that_fails_leaves_nothing(spark, tmp_path, rows):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception):  # noqa: B017
        files.write_documents(spark.createDataFrame([("ok.txt", "ok"), *rows], "name string, text string").coalesce(1), folder)
    assert found(folder) == {}


def test_an_attempt_that_is_lost_leaves_no_half_file(tmp_path):
    from pyspark.sql import Row

    folder = str(tmp_path)
    writer = files.DocumentWriter(folder, False)
    writer.attempt = lambda: f"{writer.run}/first"

    def broken():
        yield Row(name="a.txt", text="half")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.attempt = lambda: f"{writer.run}/second"
    writer.commit([writer.write(iter([Row(name="a.txt", text="whole")]))])
    assert found(folder) == {"a.txt": "whole"}


def test_channel_resumes_without_loss_or_repeats(spark, tmp_path):
    channel, out, ckpt, src = (str(tmp_path / x) for x in ("channel", "out", "ckpt", "src"))
    os.makedirs(channel)
    schema = "client_id string, text string, n int"

    def round_(rows):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(src)
        sinks.publish_to(spark.readStream.schema(schema).parquet(src), channel, str(tmp_path / "pub")).awaitTermination()

    def take():
        files.subscribed(spark, channel).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        return sorted(json.loads(r.message)["n"] for r in spark.read.parquet(out).collect())

    round_([("a", "x\ny", 1), ("b", None, 2)])
    assert take() == [1, 2]
    round_([("a", "é", 3)])
    round_([("a", "", 4), ("a", "", 5)])
    assert take() == [1, 2, 3, 4, 5] and take() == [1, 2, 3, 4, 5]
    spark.dataSource.register(files.Channel)
    assert spark.read.format("cuebook_channel").option("path", channel).load().select("segment").distinct().count() == 3
    again = files.ChannelWriter(channel)  # a batch done again takes its segment's place
    again.commit([], 2)
    assert len([f for f in os.listdir(channel) if f.endswith(".jsonl")]) == 3


def test_reconnecting_waits_longer_each_time(monkeypatch, tmp_path):
    slept, tries = [], []
    monkeypatch.setattr(files.time, "sleep", slept.append)
    real = files.located

    def failing(path):
        tries.append(path)
        if len(tries) < 8:
            raise OSError("no broker")
        return real(path)

    monkeypatch.setattr(files, "located", failing)
    assert files.ChannelReader({"path": str(tmp_path)}).latestOffset() == {"next": 0}
    assert slept == [1, 2, 4, 8, 16, 30, 30]
    tries.clear()
    with pytest.raises(OSError):
        files.ChannelReader({"path": str(tmp_path), "tries": "3"}).latestOffset()


def test_a_replaced_connection_gets_nothing_more(spark, tmp_path):
    ev, co, out, ckpt = (str(tmp_path / x) for x in ("ev", "co", "out", "ckpt"))
    es, cs = "client_id string, seq long, payload string", "client_id string, kind string, connection string, seq long"

    def step(connections, events):
        spark.createDataFrame(connections, cs).coalesce(1).write.mode("append").parquet(co)
        spark.createDataFrame(events, es).coalesce(1).write.mode("append").parquet(ev)
        routed = status.routed_live(spark.readStream.schema(es).parquet(ev), spark.readStream.schema(cs).parquet(co))
        with status.rocksdb(spark):
            q = routed.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r.payload, r.connection) for r in spark.read.schema(status.ROUTED).parquet(out).collect()}

    first = step([("c", "connect", "old", 1), ("d", "connect", "only", 1)], [("c", 2, "one"), ("d", 2, "two"), ("nobody", 2, "lost"), (None, 2, "lost"), ("c", 0, "too early")])
    assert first == {("one", "old"), ("two", "only")}
    second = step([("c", "connect", "new", 3), ("c", "disconnect", "old", 5), ("d", "disconnect", "only", 4)], [("c", 4, "three"), ("c", 6, "four"), ("d", 5, "gone")])
    assert second - first == {("three", "new"), ("four", "new")}
    third = step([("c", "connect", "stale", 2)], [("c", 7, "five"), ("d", 9, "gone")])
    assert third - second == {("five", "new")}


def test_states_survive_a_restart_and_can_be_read(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = "file_uid string, status string, text string, seq int, ts timestamp"

    def step(rows):
        spark.createDataFrame([(f, s, t, i, T0 + timedelta(hours=h)) for f, s, t, i, h in rows], schema).coalesce(1).write.mode("append").parquet(src)
        events = status.status_events(spark, src, schema)
        status.upserted_states(status.file_states(events), out, ckpt).awaitTermination()
        return {r.file_uid: (r.status, r.text) for r in status.stored_states(spark, ckpt).collect()}

    assert step([("a", "PROCESSING", "x", 2, 0), ("a", "PROCESSING", "older", 1, 0), ("b", "FAILED", "second", 5, 0), ("b", "FAILED", "first", 3, 0), (None, "FAILED", "", 1, 0)]) == {"a": ("PROCESSING", "x"), "b": ("FAILED", "first")}
    assert step([("a", "PROCESSING", "late", 1, 1), ("b", "COMPLETED", "no more", 9, 1)]) == {"a": ("PROCESSING", "x"), "b": ("FAILED", "first")}
    assert step([("a", "COMPLETED", "done", 3, 1)]) == {"a": ("COMPLETED", "done"), "b": ("FAILED", "first")}
    step([("z", "PROCESSING", "", 1, 60)])
    assert set(step([("z", "PROCESSING", "", 2, 61)])) == {"z"}
    assert {r.file_uid: r.status for r in status.current(spark, out).collect()} == {"a": "RETRIEVED", "b": "FAILED", "z": "PROCESSING"}


def test_audit_records_by_task(spark, tmp_path):
    folder = str(tmp_path / "audit")
    for i, task in enumerate(("t-1", "t-2", "t-1")):
        sinks.record(spark.createDataFrame([(task, "split", float(i))], "task_id string, operation string, at double"), folder)
    got = sinks.manifest(spark, folder, "t-1")
    assert [json.loads(r.details)["at"] for r in got.collect()] == [0.0, 2.0] and "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString()
    assert sinks.manifest(spark, folder, "other").count() == 0
