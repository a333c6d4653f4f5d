"""Text logs that producers still append to, as a source for streams (and for batches).

    spark.dataSource.register(GrowingLogs)
    spark.readStream.format("growing_logs").load("/logs")    # path, run_id, line_no, value

Each ``<run_id>.log`` in the folder is a log. A line's number is the byte at which it starts, so numbers ascend and stay
the same however the log is cut into batches. Offsets are the sizes of the logs. A line belongs to the range of bytes in
which its line feed lies: a half line at the end of a range waits for the range that ends it, and ranges of one log can
be read by different tasks. A task reads the ranges of many short logs, so the driver keeps no task for each log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from capsieve.sources.files import open_store

SUFFIX = ".log"
CHUNK, RANGE_BYTES, RANGES = 1 << 20, 32 << 20, 256
SCHEMA = "path STRING, run_id STRING, line_no BIGINT, value STRING"


@dataclass
class LogRange:
    path: str
    start: int
    end: int


@dataclass
class LogRanges(InputPartition):
    """What one task reads: (name, start, end) of some logs of the folder."""

    folder: str
    parts: list[tuple[str, int, int]]


def sizes(folder: str) -> dict[str, int]:
    """Bytes of each log of a folder now, by name."""
    store, inner = open_store(folder)
    found = store.get_file_info(FileSelector(inner, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.type == FileType.File and f.base_name.endswith(SUFFIX)}


def ranges(folder: str, start: dict[str, int], end: dict[str, int], size: int = RANGE_BYTES) -> list[LogRange]:
    """Bytes from one state of the logs to another, at most ``size`` in one range."""
    out = []
    for name, stop in sorted(end.items()):
        at = start.get(name, 0)
        if stop < at:
            raise ValueError(f"{name} has been cut from {at} to {stop} bytes; a log only grows")
        out += [LogRange(f"{folder.rstrip('/')}/{name}", a, min(a + size, stop)) for a in range(at, stop, size)]
    return out


def packed(folder: str, parts: list[LogRange], size: int = RANGE_BYTES, count: int = RANGES) -> list[LogRanges]:
    """The ranges dealt to tasks, at most ``count`` and, unless one alone is longer, ``size`` bytes for each."""
    out, room = [], 0
    for part in parts:
        length = part.end - part.start
        if not out or length > room or len(out[-1].parts) >= count:
            out.append(LogRanges(folder.rstrip("/"), []))
            room = size
        out[-1].parts.append((part.path.rsplit("/", 1)[-1], part.start, part.end))
        room -= length
    return out


def lines(part: LogRange, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(start, content) of the lines whose line feed is in the range."""
    store, inner = open_store(part.path)
    with store.open_input_file(inner) as file:
        begin = part.start
        while begin > 0:
            before = max(0, begin - chunk)
            cut = file.read_at(begin - before, before).rfind(b"\n")
            if cut >= 0:
                begin = before + cut + 1
                break
            begin = before
        held, at = b"", begin
        while at < part.end:
            data = file.read_at(min(chunk, part.end - at), at)
            if not data:
                return
            at += len(data)
            *whole, rest = data.split(b"\n")
            for line in whole:
                line = held + line
                yield begin, line
                begin += len(line) + 1
                held = b""
            held += rest


def batches(task: LogRanges, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    names = ["path", "run_id", "line_no", "value"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
    columns: list[list] = [[], [], [], []]
    for name, begin, end in task.parts:
        part = LogRange(f"{task.folder}/{name}", begin, end)
        for start, line in lines(part):
            row = (part.path, name.removesuffix(SUFFIX), start, line.removesuffix(b"\r").decode(errors="replace"))
            for column, value in zip(columns, row):
                column.append(value)
            if len(columns[0]) >= rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
                columns = [[], [], [], []]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.folder)

    def partitions(self, start: dict, end: dict) -> list[LogRanges]:
        return packed(self.folder, ranges(self.folder, start, end))

    def read(self, partition: LogRanges) -> Iterator[pa.RecordBatch]:
        return batches(partition)

    def commit(self, end: dict) -> None:
        """Logs are the producers'; nothing is removed."""


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[LogRanges]:
        return packed(self.folder, ranges(self.folder, {}, sizes(self.folder))) or [LogRanges(self.folder, [])]

    def read(self, partition: LogRanges) -> Iterator[pa.RecordBatch]:
        return batches(partition)


class GrowingLogs(DataSource):
    """Options: ``path``, the folder."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def read_logs(spark: SparkSession, folder: str, stream: bool = True):
    """The logs of a folder as a stream, or what is in them now."""
    spark.dataSource.register(GrowingLogs)
    return (spark.readStream if stream else spark.read).format("growing_logs").load(folder)
