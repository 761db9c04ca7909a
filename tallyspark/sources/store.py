"""The tables of a device (cursors, outbox, parser issues, runs) as generations that become valid at once.

A generation is a manifest: for each table the folder that holds it, and the last batch that is in them. Tables are written
first; the manifest is created last and only if no other writer has created that generation, so a reader sees all tables
of a commit or none. A run that stops on its way leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
TABLES = {
    "cursors": "source_id string, size long, modified timestamp, last_record long",
    "outbox": "event_id string, payload_json string, sequence long, flushed_at timestamp",
    "issues": "source_id string, record_index long, code string",
    "runs": "run_id long, kind string, status string, detail string, started_at timestamp, finished_at timestamp",
}


class StoreError(ValueError):
    pass


class LocalState:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        self.fs = self.folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, generation: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, f"{generation:012d}.json")

    def _generations(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(s.getPath().getName().partition(".")[0]) for s in self.fs.listStatus(self.folder) if s.getPath().getName().endswith(".json"))

    def _load(self, generation: int) -> dict | None:
        """A manifest, or None for one that its writer did not complete."""
        stream = self.fs.open(self._path(generation))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        if found["version"] > VERSION:
            raise StoreError("the state was written by a newer version")
        return found

    def manifest(self) -> dict:
        for generation in reversed(self._generations()):
            if found := self._load(generation):
                return found
        return {"version": VERSION, "generation": 0, "batch": None, "tables": {}}

    def read(self, table: str) -> DataFrame:
        path = self.manifest()["tables"].get(table)
        if path is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{path}")

    def commit(self, *, batch: int | None = None, **tables: DataFrame) -> dict:
        """Publish new contents of some tables; the others stay. A batch number never falls."""
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch < before["batch"]:
            raise StoreError("a later batch is in the state already")
        paths = dict(before["tables"])
        for name, rows in tables.items():
            paths[name] = f"tables/{name}-{uuid.uuid4().hex}"
            rows.select(*[part.split()[0] for part in TABLES[name].split(", ")]).write.parquet(f"{self.root}/{paths[name]}")
        generation = max([before["generation"], *self._generations()]) + 1
        new = {"version": VERSION, "generation": generation, "batch": before["batch"] if batch is None else batch, "tables": paths}
        try:
            stream = self.fs.create(self._path(generation), False)
        except Exception as error:
            raise StoreError("another writer published this generation") from error
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        return new

    def tidy(self, keep: int = 2) -> int:
        """Delete tables that none of the last manifests names, and older manifests; gives the number of tables that went."""
        generations = self._generations()
        named = {p for g in generations[-keep:] if (m := self._load(g)) for p in m["tables"].values()}
        for g in generations[:-keep]:
            self.fs.delete(self._path(g), False)
        folder, gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tables"), 0
        for status in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
            if f"tables/{status.getPath().getName()}" not in named:
                self.fs.delete(status.getPath(), True)
                gone += 1
        return gone
