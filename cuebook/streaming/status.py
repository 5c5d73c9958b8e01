"""Structured Streaming twins of the event operators: counts, state by file, live connections, routing and expiry."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE = "file_uid string, status string, text string, at timestamp"
ENDS = ("COMPLETED", "FAILED")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started within keep their state in RocksDB, off the heap and with changelogs, which the processors here ask for."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def status_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream of the event files of a folder, with an event time that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def counts_by_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per hour and type; state of an hour goes once the watermark has passed it. Also runs on a batch frame."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


class FileStates(StatefulProcessor):
    """A file's state in one value, and one timer for its expiry. A batch's rows are folded as they come: of ends the first by seq counts, else the newest row."""

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("file", "status string, text string, at long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get() if self.state.exists() else None
        if before is not None and before[0] in ENDS:
            for _ in rows:
                pass
            return
        end, last = None, before
        for r in rows:
            now = (r.status, r.text, int(r.at.replace(tzinfo=r.at.tzinfo or timezone.utc).timestamp() * 1000), r.seq)
            if now[0] in ENDS:
                end = now if end is None or now[3] < end[3] else end
            elif last is None or now[3] >= last[3]:
                last = now
        after = end or last
        if after is None or (before is not None and tuple(before) == after):
            return
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.state.update(after)
        self.handle.registerTimer(max(after[2] + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(file_uid=key[0], status=after[0], text=after[1], at=_time(after[2]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row = self.state.get() if self.state.exists() else None
        self.state.clear()
        if row is not None and row[0] == "COMPLETED":
            yield Row(file_uid=key[0], status="RETRIEVED", text=row[1], at=_time(row[2] + self.wait))

    def close(self) -> None:
        pass


def _time(ms: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)


def file_states(events: DataFrame, late: str = "1 hour", expire_after: str = "24 hours") -> DataFrame:
    """Stream of each file's state as its events (file_uid, status, text, at, seq) change it; start it within rocksdb().

    COMPLETED and FAILED hold: what comes later for the file changes nothing. An event with a smaller seq than the state's changes nothing, unless it ends the file. A completed
    file is given out once more as RETRIEVED when the watermark is expire_after past its end, and its state goes; so a file that comes back later starts anew. Null files go."""
    wait = int(pd.Timedelta(expire_after).total_seconds() * 1000)
    timed = events.where("file_uid is not null").select("file_uid", "status", "text", "at", F.col("seq").cast("long").alias("seq")).withWatermark("at", late)
    return timed.groupBy("file_uid").transformWithState(FileStates(wait), STATE, "Update", "EventTime")


def stored_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(file_uid, status, text, at, seq): the states that a query over file_states() holds in its checkpoint, read from the state store."""
    kept = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "file").load()
    return kept.select("key.file_uid", "value.status", "value.text", F.timestamp_millis("value.at").alias("at"), "value.seq")


ROUTED = "client_id string, connection string, seq long, payload string"


class Connections(StatefulProcessor):
    """A client's live connection in one value. Rows of a batch are taken in order of seq; a client's rows in one trigger are held at once."""

    def init(self, handle) -> None:
        self.live = handle.getValueState("live", "connection string, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        live = self.live.get() if self.live.exists() else None
        live = tuple(live) if live is not None else None
        held = live
        for r in sorted(rows, key=lambda r: (r.seq, r.kind != "connect")):
            if r.kind == "connect":
                live = (r.connection, r.seq) if live is None or r.seq >= live[1] else live
            elif r.kind == "disconnect":
                live = None if live is not None and live[0] == r.connection else live
            elif live is not None:
                yield Row(client_id=key[0], connection=live[0], seq=r.seq, payload=r.payload)
        if live is None and held is not None:
            self.live.clear()
        elif live is not None and live != held:
            self.live.update(live)

    def close(self) -> None:
        pass


def routed_live(events: DataFrame, connections: DataFrame) -> DataFrame:
    """Stream of events (client_id, seq, payload) with the connection that is live for their client then; start it within rocksdb().

    connections (client_id, kind, connection, seq) is a stream of its own: `connect` puts a connection in place of the one before, `disconnect` ends the one it names and
    no other. seq orders both streams. An event of a client without a live connection is dropped, and so is one without a client."""
    wide = "client_id", "kind", "connection", F.col("seq").cast("long").alias("seq"), "payload"
    both = events.withColumns({"kind": F.lit("event"), "connection": F.lit(None).cast("string")}).select(*wide)
    both = both.unionByName(connections.withColumn("payload", F.lit(None).cast("string")).select(*wide)).where("client_id is not null")
    return both.groupBy("client_id").transformWithState(Connections(), ROUTED, "Append", "None")


def upserted_states(states: DataFrame, folder: str, checkpoint: str):
    """Query, started, that appends each change of file_states() under folder with the number of its trigger; current() reads the newest change of each file."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/trigger={number:012d}.d")

    with rocksdb(states.sparkSession):
        return states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest state of each file that upserted_states() has written."""
    rows = spark.read.option("recursiveFileLookup", "true").schema(f"{STATE}, trigger int").parquet(folder)
    return rows.groupBy("file_uid").agg(F.max_by(F.struct("status", "text", "at"), "trigger").alias("r")).select("file_uid", "r.*")
