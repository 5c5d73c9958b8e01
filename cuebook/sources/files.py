"""Data sources of our own: documents as one file each, and a channel of messages with offsets."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a local path or a uri that Arrow knows."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n: int


class _Staging:
    """Files that tasks write aside, each attempt in a folder of its own, until the driver takes those of the attempts that count."""

    def __init__(self, path: str):
        self.path, self.run = path, f"_staging-{uuid.uuid4().hex}"

    def attempt(self) -> str:
        context = TaskContext.get()
        return f"{self.run}/{context.partitionId()}-{context.taskAttemptId()}" if context else f"{self.run}/0"

    def clear(self) -> None:
        system, top = located(self.path)
        if system.get_file_info(f"{top}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{top}/{self.run}")


class DocumentWriter(_Staging, DataSourceWriter):
    """Writes each document's text as a file of its name. Names must differ, and lie under the folder; nothing shows up there before all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        super().__init__(path)
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Staged:
        system, top = located(self.path)
        own, names = self.attempt(), []
        system.create_dir(f"{top}/{own}", recursive=True)
        for row in iterator:
            if row.name is None or row.name.startswith(("/", "_")) or ".." in row.name.split("/"):
                raise ValueError(f"a document can't be named {row.name!r}")
            with system.open_output_stream(f"{top}/{own}/{len(names)}") as out:
                out.write((row.text or "").encode())
            names.append(row.name)
        with system.open_output_stream(f"{top}/{own}/names") as out:
            out.write("\n".join(map(json.dumps, names)).encode())
        return Staged(own, len(names))

    def commit(self, messages: list) -> None:
        system, top = located(self.path)
        moves: dict[str, str] = {}
        for m in messages:
            with system.open_input_stream(f"{top}/{m.folder}/names") as found:
                for i, line in enumerate(found.read().decode().split("\n") if m.n else []):
                    name = json.loads(line)
                    if name in moves:
                        self.clear()
                        raise ValueError(f"two documents are named {name!r}")
                    moves[name] = f"{m.folder}/{i}"
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if not old.base_name.startswith("_"):
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for folder in {n.rpartition("/")[0] for n in moves}:
            system.create_dir(f"{top}/{folder}" if folder else top, recursive=True)
        for name, at in moves.items():
            system.move(f"{top}/{at}", f"{top}/{name}")
        self.clear()

    def abort(self, messages: list) -> None:
        self.clear()


class Documents(DataSource):
    """Sink of (name, text): option path, mode append or overwrite."""

    @classmethod
    def name(cls) -> str:
        return "cuebook_documents"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], overwrite)


def write_documents(rows: DataFrame, folder: str, name: str = "name", text: str = "text", mode: str = "append") -> None:
    """Each row's text as a file of its name under folder."""
    spark = rows.sparkSession
    spark.dataSource.register(Documents)
    rows.selectExpr(f"`{name}` as name", f"`{text}` as text").write.format("cuebook_documents").option("path", folder).mode(mode).save()


@dataclass
class Segment(InputPartition):
    number: int


class ChannelReader(DataSourceStreamReader):
    """Messages of a channel, segments in order of their numbers. While the channel can't be reached, listing is tried again after 1, 2, 4 and so on, at most 30 seconds."""

    FIRST, MOST = 1.0, 30.0

    def __init__(self, options: dict):
        self.path, self.tries = options["path"], int(options.get("tries", "8"))
        self.waits: list[float] = []

    def _numbers(self) -> list[int]:
        wait = self.FIRST
        for left in range(self.tries, 0, -1):
            try:
                system, top = located(self.path)
                return sorted(int(f.base_name.partition(".")[0]) for f in system.get_file_info(fs.FileSelector(top)) if re.fullmatch(r"\d{20}\.jsonl", f.base_name))
            except OSError:
                if left == 1:
                    raise
                self.waits.append(wait)
                time.sleep(wait)
                wait = min(2 * wait, self.MOST)
        return []

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(self._numbers(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return [Segment(n) for n in self._numbers() if start["next"] <= n < end["next"]]

    def read(self, partition: Segment) -> Iterator[tuple]:
        system, top = located(self.path)
        with system.open_input_stream(f"{top}/{partition.number:020d}.jsonl") as found:
            for line in found.read().decode().splitlines():
                yield (partition.number, line)


class ChannelTable(DataSourceReader):
    """All messages that a channel holds now."""

    def __init__(self, options: dict):
        self.held = ChannelReader(options)

    def partitions(self) -> list[Segment]:
        return self.held.partitions(self.held.initialOffset(), self.held.latestOffset())

    def read(self, partition: Segment) -> Iterator[tuple]:
        return self.held.read(partition)


class ChannelWriter(_Staging, DataSourceStreamWriter):
    """Messages of a batch as the segment of the batch's number: a batch that is done again replaces its segment, so that each message is there once."""

    def write(self, iterator: Iterator) -> Staged:
        system, top = located(self.path)
        own, n = self.attempt(), 0
        system.create_dir(f"{top}/{own}", recursive=True)
        with system.open_output_stream(f"{top}/{own}/lines") as out:
            for row in iterator:
                out.write((json.dumps(json.loads(row.message)) + "\n").encode())
                n += 1
        return Staged(own, n)

    def commit(self, messages: list, batchId: int) -> None:
        system, top = located(self.path)
        whole = f"{top}/{self.run}/segment"
        system.create_dir(f"{top}/{self.run}", recursive=True)
        with system.open_output_stream(whole) as out:
            for m in messages:
                if m is not None and m.n:
                    with system.open_input_stream(f"{top}/{m.folder}/lines") as part:
                        while block := part.read(1 << 20):
                            out.write(block)
        system.move(whole, f"{top}/{batchId:020d}.jsonl")
        self.clear()

    def abort(self, messages: list, batchId: int) -> None:
        self.clear()


class Channel(DataSource):
    """A folder of numbered segments of JSON lines in the role of a broker's channel: source of (segment, message), sink of message. Options path and, to read, tries."""

    @classmethod
    def name(cls) -> str:
        return "cuebook_channel"

    def schema(self) -> str:
        return "segment long, message string"

    def reader(self, schema) -> ChannelTable:
        return ChannelTable(self.options)

    def streamReader(self, schema) -> ChannelReader:
        return ChannelReader(self.options)

    def streamWriter(self, schema, overwrite: bool) -> ChannelWriter:
        return ChannelWriter(self.options["path"])


def subscribed(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (segment, message) of a channel."""
    spark.dataSource.register(Channel)
    return spark.readStream.format("cuebook_channel").option("path", folder).load()
