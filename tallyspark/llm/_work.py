"""Helpers shared by the operators: input tables, durable intermediate tables, literal tables."""

from __future__ import annotations

import contextlib
import gc
import json
import tempfile
import uuid
from collections.abc import Iterator
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of `[^\x20\x09-\x0D]+` words.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is set (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_tallyspark_root", None) or "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark._tallyspark_root = root
    return root.rstrip("/")


class Workspace:
    """Parquet tables in the shared folder that cut lineage and survive lost executors."""

    opened: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/work-{uuid.uuid4().hex}"
        self.opened.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, uri: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished queries go when the driver collects its garbage; this asks for it between rounds."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables of the workspaces that were opened inside: for results that are written by then."""
    before = len(Workspace.opened)
    try:
        yield
    finally:
        for work in Workspace.opened[before:]:
            work._delete(work.root)
        del Workspace.opened[before:]


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small DataFrame from driver values, as a folded literal (no RDD). Callers bound len(rows)."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


#: What a broadcast side may take in memory: measured before every broadcast, whatever the input.
BROADCAST_BYTES = 32_000_000


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes in memory) of a written table: 24 bytes and 8 for each column, and what strings and arrays hold."""
    inner = F.lit(0)
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            inner = inner + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind.startswith("array"):
            inner = inner + 8 * F.coalesce(F.size(f"`{f.name}`"), F.lit(0)) * (kind.count(",") + 1)
        elif kind.startswith("struct"):
            inner = inner + 8 * (kind.count(",") + 2)
    rows, held = df.agg(F.count("*"), F.coalesce(F.sum(inner.cast("long")), F.lit(0))).first()
    return rows, held + rows * (24 + 8 * len(df.columns))


def small(df: DataFrame, of: DataFrame | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast df if its measured bytes are within the limit; else leave the join to shuffle. `of` is a written
    table of which df has a part, to be measured in its place."""
    return F.broadcast(df) if measured(df if of is None else of)[1] <= limit else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them as far as columns has such names already (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. The JVM's lower() is the same for pure ASCII and much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def count_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
