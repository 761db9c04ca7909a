"""Thread inventory in SQLite files, as a Python data source: `spark.read.format("thread_inventory")`.

Options: path, table (threads or edges). Columns that a file lacks are null. One file is one partition; the file
must be readable where tasks run.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = {
    "threads": ("threads", {"id": "thread_id", "rollout_path": "rollout_path", "source": "source", "cwd": "cwd", "tokens_used": "tokens_used", "git_origin_url": "git_origin_url", "git_branch": "git_branch", "git_sha": "git_sha", "cli_version": "cli_version", "model": "model", "reasoning_effort": "reasoning_effort", "agent_path": "agent_path"}),
    "edges": ("thread_spawn_edges", {"parent_thread_id": "parent", "child_thread_id": "child", "status": "status"}),
}


class InventoryError(ValueError):
    pass


def open_readonly(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def catalog(path: str) -> dict[str, set[str]]:
    """Tables and their columns."""
    with open_readonly(path) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
        return {n: {r[1] for r in db.execute(f'PRAGMA table_info("{n}")')} for n in names}


class InventoryReader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import sqlite3 as sql

        name, columns = TABLES[self.table]
        db = sql.connect(f"file:{partition.value.removeprefix('file://')}?mode=ro", uri=True)
        try:
            known = {r[1] for r in db.execute(f'PRAGMA table_info("{name}")')}
            if not known:
                return
            wanted = ", ".join(f'"{c}"' if c in known else "NULL" for c in columns)
            for row in db.execute(f'SELECT {wanted} FROM "{name}"'):
                yield tuple((int(v) if isinstance(v, int) and v >= 0 else None) if c == "tokens_used" else (v if isinstance(v, str) and v else None) for c, v in zip(columns, row, strict=True))
        finally:
            db.close()


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "thread_inventory"

    def schema(self) -> str:
        return ", ".join(f"{n} {'bigint' if n == 'tokens_used' else 'string'}" for n in TABLES[self.options.get("table", "threads")][1].values())

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options["path"], self.options.get("table", "threads"))


def read_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(threads, edges, issues). A file without threads, or with ids that repeat or are empty, is an error."""
    spark.dataSource.register(InventorySource)
    tables, issues = catalog(path), []
    if "id" not in tables.get("threads", ()):
        raise InventoryError("no table threads with a column id")
    if "thread_spawn_edges" not in tables:
        issues.append("spawn_edge_table_missing")
    elif not {"parent_thread_id", "child_thread_id"} <= tables["thread_spawn_edges"]:
        issues.append("spawn_edge_columns_missing")
    threads = spark.read.format("thread_inventory").option("path", path).load()
    edges = spark.read.format("thread_inventory").option("path", path).option("table", "edges").load()
    if issues:
        edges = edges.where("false")
    if not threads.groupBy("thread_id").count().where("thread_id is null or count > 1").isEmpty():
        raise InventoryError("thread ids repeat or are empty")
    return threads, edges, issues


def pick_state_file(files: list[tuple[str, float]]) -> str | None:
    """Of (path, modified) the state_N.sqlite of largest (N, modified)."""
    numbered = [(int(m[1]), t, p) for p, t in files if (m := re.search(r"(?:^|/)state_(\d+)\.sqlite$", p))]
    return max(numbered)[2] if numbered else None
