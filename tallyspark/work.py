"""Durable intermediate tables: they cut the lineage of iterative queries and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_tallyspark_root", None) or "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark._tallyspark_root = root
    return root.rstrip("/")


class Scratch:
    """Parquet tables of one query in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/scratch-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")


#: Rows of a task at most, for work that is long for each row.
TASK_ROWS = 50_000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """For work that is long for each row: the rows are dealt out evenly, to so many tasks that none has more than `rows`,
    and to all cores. What the splits of files hold says nothing of that: a small file of many rows is a few row groups,
    and most of its splits are empty. The rows are counted for it, which reads the footers only of a plain Parquet scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))
