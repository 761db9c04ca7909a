"""The read model: Parquet tables of a generation, published by a row in the table of states.

A rebuild writes generation n + 1 beside the old one and appends its state last, so a failure leaves readers on
the old generation.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json
from ..operators.replay import Replay, require_empty
from ..operators.report import daily_usage_utc
from ..schemas import COUNTERS, EVENT_FIELDS

SCHEMA_VERSION = 2
STATE = "schema_version int, generation long, rebuilt_at string, key_id string, input_event_count long, effective_usage_count long"
REQUIRED = ("event_id", "source_event_id", "device_id", "key_id", "thread_key", "project_resolution", "operation", "source_kind", "occurred_at", "payload_json")
TABLES = ("usage_events", "mapping_events", "project_aliases", "quota_snapshots")


class ReadModelError(ValueError):
    pass


def flatten_usage(usage: DataFrame) -> DataFrame:
    """Nested usage events as flat columns; counters become delta_<name>, flags JSON, the payload canonical JSON."""
    flat = [c for c in EVENT_FIELDS["usage_checkpoint"] if c not in ("cumulative", "delta", "reported_last", "flags", "project_id")]
    return usage.select(
        *flat,
        F.col("project_id").alias("original_project_id"),
        "project_id",
        "effective_project_id",
        F.col("occurred_ts").cast("timestamp_ntz").alias("occurred_ts"),  # the session runs in UTC
        *[F.col(f"delta.{c}").alias(f"delta_{c}") for c in COUNTERS],
        F.to_json("flags").alias("flags"),
        canonical_json(*EVENT_FIELDS["usage_checkpoint"]).alias("payload_json"),
    )


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def state(spark: SparkSession, root: str) -> dict | None:
    """The state of the newest complete generation: the states are a table of one row for each of them."""
    path, fs = _folder(spark, f"{root.rstrip('/')}/states")
    if not fs.exists(path):
        return None
    newest = spark.read.schema(STATE).parquet(f"{root.rstrip('/')}/states").orderBy(F.col("generation").desc()).first()
    if newest is None:
        return None
    found = newest.asDict()
    if found["schema_version"] > SCHEMA_VERSION:
        raise ReadModelError("the read model was written by a newer version")
    if found["schema_version"] < SCHEMA_VERSION:
        raise ReadModelError("the read model was written by an older version; rebuild it")
    return found


def typing_violations(usage: DataFrame) -> DataFrame:
    """(event_id, field) of flat usage that the read model may not hold: required fields that are null or empty,
    and token counts below 0."""
    required = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in REQUIRED]
    tokens = [F.when(F.col(f"delta_{c}") < 0, F.lit(f"delta_{c}")) for c in COUNTERS]
    return usage.select("event_id", F.explode(F.array_compact(F.array(*required, *tokens))).alias("field"))


def rebuild(spark: SparkSession, root: str, replay: Replay, *, key_id: str) -> dict:
    """Write the next generation and publish it; gives the new state."""
    path, fs = _folder(spark, f"{root.rstrip('/')}/states")
    written = spark.read.schema(STATE).parquet(f"{root.rstrip('/')}/states").agg(F.max("generation"), F.max("schema_version")).first() if fs.exists(path) else (None, None)
    if (written[1] or 0) > SCHEMA_VERSION:
        raise ReadModelError("the read model was written by a newer version")
    generation = (written[0] or 0) + 1
    base = f"{root.rstrip('/')}/gen={generation}"
    require_empty(typing_violations(flatten_usage(replay.usage)), "read model fields")
    usage = flatten_usage(replay.usage).withColumn("utc_date", F.substring("occurred_at", 1, 10))
    usage.repartition("utc_date", F.pmod(F.xxhash64("event_id"), F.lit(16))).write.mode("overwrite").partitionBy("utc_date").parquet(f"{base}/usage_events")
    replay.mappings.write.mode("overwrite").parquet(f"{base}/mapping_events")
    edges = replay.mappings.where("kind = 'project_alias' and target_project_id is not null").select(F.col("subject_id").alias("source_project_id"), "event_id")
    aliases = replay.aliases.select(F.col("source").alias("source_project_id"), F.col("target").alias("target_project_id"))
    require_empty(aliases.join(edges, "source_project_id", "left_anti"), "aliases without an event")
    aliases = aliases.join(edges, "source_project_id")
    aliases.write.mode("overwrite").parquet(f"{base}/project_aliases")
    replay.quotas.write.mode("overwrite").parquet(f"{base}/quota_snapshots")
    new = {"schema_version": SCHEMA_VERSION, "generation": generation, "rebuilt_at": dt.datetime.now(dt.UTC).isoformat(timespec="microseconds"), "key_id": key_id, "input_event_count": replay.input_events, "effective_usage_count": spark.read.parquet(f"{base}/usage_events").count()}
    spark.createDataFrame([new], STATE).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/states")
    return new


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    found = state(spark, root)
    if found is None:
        raise ReadModelError("no read model yet")
    if table == "usage_daily_utc":
        return daily_usage_utc(read(spark, root, "usage_events"))
    return spark.read.parquet(f"{root.rstrip('/')}/gen={found['generation']}/{table}")


def counts(spark: SparkSession, root: str) -> dict[str, int]:
    return {t: read(spark, root, t).count() for t in TABLES}
