"""A stream sink of events as JSON lines or server-sent event frames, exactly once.

Each task writes a file of its own; only what a trigger's commit lists in the log belongs to the output. A trigger that runs
again after a restart finds its commit in the log and leaves it as it is, so its files replace none and add none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "event_lines"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def frame(row: dict, kind: str, retry: int) -> str:
    """A row as a line of JSON, or as a frame whose event and id are columns of those names and whose data are the others."""
    plain = json.dumps(row if kind == "ndjson" else {k: v for k, v in row.items() if k not in ("event", "id")}, ensure_ascii=False, default=str)
    if kind == "ndjson":
        return plain + "\n"
    head = "".join(f"{k}: {row[k]}\n" for k in ("event", "id") if row.get(k) is not None)
    return f"{head}retry: {retry}\ndata: {plain}\n\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class EventWriter(DataSourceStreamWriter):
    """``path`` is a folder that driver and executors share: files go to data, one commit for each trigger to log."""

    def __init__(self, path: str, kind: str, retry: int):
        if kind not in ("ndjson", "sse"):
            raise ValueError(f"unknown kind of events {kind}")
        self.path, self.kind, self.retry = path.rstrip("/"), kind, retry

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = filesystem(self.path)
        name = f"{uuid.uuid4().hex}.{self.kind}"
        rows = 0
        out = None
        for row in iterator:
            if out is None:
                fs.create_dir(f"{root}/data", recursive=True)
                out = fs.open_output_stream(f"{root}/data/{name}")
            out.write(frame(row.asDict(recursive=True), self.kind, self.retry).encode())
            rows += 1
        if out is not None:
            out.close()
        return Written(name if rows else "", rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, root = filesystem(self.path)
        new = [m for m in messages if m is not None and m.file]
        entry = f"{root}/log/{batchId:012d}.json"
        if fs.get_file_info(entry).type != pafs.FileType.NotFound:
            self._delete(new)
            return
        fs.create_dir(f"{root}/log", recursive=True)
        part = f"{root}/log/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(json.dumps({"files": [m.file for m in new], "rows": sum(m.rows for m in new)}).encode())
        fs.move(part, entry)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._delete([m for m in messages if m is not None and m.file])

    def _delete(self, written: list[Written]) -> None:
        fs, root = filesystem(self.path)
        for m in written:
            fs.delete_file(f"{root}/data/{m.file}")


class EventLines(DataSource):
    """``df.writeStream.format("event_lines").option("kind", "ndjson" or "sse")``; register it by ``register``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EventWriter(self.options["path"], self.options.get("kind", "ndjson"), int(self.options.get("retry", "1000")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLines)


def committed_files(path: str) -> list[str]:
    """Files of all commits, in the order of the triggers."""
    fs, root = filesystem(path.rstrip("/"))
    log = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/log", allow_not_found=True)) if f.path.endswith(".json"))
    return [f"{path.rstrip('/')}/data/{name}" for entry in log for name in json.loads(fs.open_input_stream(entry).read())["files"]]


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What the commits of a ``ndjson`` sink hold; files without a commit do not count."""
    files = committed_files(path)
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
