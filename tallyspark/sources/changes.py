"""Changed logs as a stream: the offsets are what is known of each file.

An offset maps every file below the home to its size and time, from a listing alone. Files that differ from the
offset before are read, in ranges, so that one huge file is many tasks; where nothing changed, the offsets are equal and
no file is opened. A file that changes between two looks is busy: it stays out of the offset and is read by a later batch, once it
stands still. A range gives the lines that start in it; a line without its line feed at the size of the offset waits.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .rollouts import FOLDERS

RANGE_BYTES = 128 << 20
ROWS = 10_000
LINES = "file string, source_id string, priority int, size long, modified_ns long, range_start long, at long, line string"


class Range(InputPartition):
    def __init__(self, uri: str, priority: int, size: int, modified_ns: int, start: int, end: int):
        self.uri, self.priority, self.size, self.modified_ns, self.start, self.end = uri, priority, size, modified_ns, start, end


def look(home: str) -> dict[str, list[int]]:
    """file -> [size, time in nanoseconds, priority] of all logs below home; an active file before an archived one."""
    store, root = fs.FileSystem.from_uri(home)
    found: dict[str, list[int]] = {}
    for priority, folder in enumerate(FOLDERS):
        for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}", allow_not_found=True, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(".jsonl"):
                found.setdefault(info.path, [info.size, info.mtime_ns, priority])
    return found


def steady(home: str, settle: float) -> tuple[dict[str, list[int]], set[str]]:
    """(files that are the same in two looks, busy ones)."""
    first = look(home)
    time.sleep(settle)
    second = look(home)
    return {f: v for f, v in second.items() if first.get(f) == v}, {f for f in first.keys() | second.keys() if first.get(f) != second.get(f)}


def lines_of(source, start: int, end: int, size: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Whole lines of source that start in [start, end), of a file taken as size bytes long."""
    at, rest = start, b""
    if start:
        source.seek(start - 1)
        at -= 1
    skip = start > 0  # the line that the range before has begun; the byte before the range may end it
    line_at = start
    while at < size:
        data = source.read(min(block, size - at))
        if not data:
            return  # cut since: a later offset has the new size
        at += len(data)
        rest += data
        if skip:
            feed = rest.find(b"\n")
            if feed < 0:
                rest = b""
                continue
            line_at, rest, skip = at - len(rest) + feed + 1, rest[feed + 1 :], False
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if line_at >= end:
                return
            yield line
            line_at += len(line) + 1
        if line_at >= end:
            return


class ChangedLogsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.home = options["path"].rstrip("/")
        self.settle = float(options.get("settle", "0.2"))
        self.range_bytes = int(options.get("rangebytes", str(RANGE_BYTES)))
        self.scheme = self.home.partition("://")[0] if "://" in self.home else "file"

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": dict(sorted(steady(self.home, self.settle)[0].items()))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, out = start["files"], []
        for path, (size, modified, priority) in end["files"].items():
            if before.get(path) != [size, modified, priority]:
                out += [Range(path, priority, size, modified, at, min(at + self.range_bytes, size)) for at in range(0, max(size, 1), self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, _ = fs.FileSystem.from_uri(self.home)
        uri = f"{self.scheme}://{partition.uri}"
        named = [uri, hashlib.sha256(uri.encode()).hexdigest(), partition.priority, partition.size, partition.modified_ns, partition.start]
        rows: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([v] * len(rows), k) for v, k in zip(named, kinds, strict=True)]
            at, text = zip(*rows, strict=True)
            names = [part.split()[0] for part in LINES.split(", ")]
            return pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int64()), pa.array(text, pa.string())], names)

        with store.open_input_file(partition.uri) as source:
            for at, line in enumerate(lines_of(source, partition.start, partition.end, partition.size)):
                rows.append((at, line.decode("utf-8", errors="replace")))
                if len(rows) == ROWS:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class ChangedLogs(DataSource):
    """spark.readStream.format("changed_logs").load(home). Options: settle (seconds between looks), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "changed_logs"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> ChangedLogsReader:
        return ChangedLogsReader(self.options)


def changed_logs(spark: SparkSession, home: str, *, settle: float = 0.2, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lines of logs that are new, appended to or replaced, from their first line on; see LINES."""
    spark.dataSource.register(ChangedLogs)
    return spark.readStream.format("changed_logs").option("settle", str(settle)).option("rangeBytes", str(range_bytes)).load(home)


def numbered(batch: DataFrame) -> DataFrame:
    """A batch of changed_logs (saved, as it is read twice) with record_index: the lines of the ranges before, then the place in the own one."""
    ranges = batch.groupBy("file", "range_start").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("file", "range_start", F.coalesce(before, F.lit(0)).alias("before"))
    return batch.join(starts, ["file", "range_start"]).select("file", "source_id", "priority", "size", "modified_ns", (F.col("before") + F.col("at") + 1).alias("record_index"), "line")
