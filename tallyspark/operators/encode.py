"""Ledger events from attributed checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import derive, key_id, opaque_or_derived
from ..functions.text import canonical_json
from ..schemas import COUNTERS, EVENT_FIELDS


def iso_utc(ts: Column, suffix: str = "Z") -> Column:
    """ISO text of a timestamp in a UTC session; microseconds only where there are some."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit(suffix))


def sorted_counts(c: str) -> Column:
    """A counter struct with its names in order, as canonical JSON wants them; null stays null."""
    return F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{k}").alias(k) for k in sorted(COUNTERS)]))


def fallback_digest() -> Column:
    """SHA-256 over the canonical JSON of what identifies a checkpoint without a turn."""
    value = F.struct(sorted_counts("cumulative").alias("cumulative"), iso_utc(F.col("occurred_ts"), "+00:00").alias("occurred_at"), F.col("operation"), sorted_counts("reported_last").alias("reported_last"))
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def source_ids(events: DataFrame, key: bytes) -> DataFrame:
    """Adds source_event_id: by turn and ordinal, else by thread, record and digest."""
    by_turn = derive(key, "source", F.when(F.col("turn_id").isNotNull(), F.concat_ws(":", "turn_id", F.col("ordinal").cast("string"))))
    by_record = derive(key, "source_fallback", F.when(F.col("turn_id").isNull(), F.concat_ws(":", "thread_id", F.lit("token_count"), F.col("record_index").cast("string"), fallback_digest())))
    return events.withColumns({"__t": by_turn, "__r": by_record}).withColumn("source_event_id", F.coalesce("__t", "__r")).drop("__t", "__r")


def encode_usage(events: DataFrame, *, key: bytes, device_id: str, parser_version: str) -> DataFrame:
    """Columns of the usage event and payload_json.

    events: thread_id, root, parent, forked_from, turn_id, ordinal, record_index, operation, occurred_ts, model,
    reasoning_effort, source_kind, cli_version, cumulative, delta, reported_last, flags, project_identity,
    project_resolution, activity_repository_count, source_event_id.
    """
    thread = lambda c: derive(key, "thread", F.col(c))
    null = F.lit(None).cast("string")
    identity = F.col("project_identity")
    rows = events.withColumns({"thread_key": thread("thread_id"), "root_thread_key": thread("root"), "parent_thread_key": thread("parent"), "forked_from_thread_key": thread("forked_from"), "turn_key": derive(key, "turn", F.col("turn_id")), "__project": derive(key, "project", identity)})
    rows = rows.select(
        F.lit(1).cast("long").alias("schema_version"), F.lit("usage_checkpoint").alias("event_type"), "source_event_id", F.lit(1).cast("long").alias("revision"), null.alias("supersedes"), F.lit(False).alias("voided"), F.lit(parser_version).alias("parser_version"), F.lit(device_id).alias("device_id"), F.lit(key_id(key)).alias("key_id"),
        opaque_or_derived(identity, "project", F.col("__project")).alias("project_id"), "project_resolution", F.col("activity_repository_count").cast("long").alias("activity_repository_count"), "thread_key", "root_thread_key", "parent_thread_key", "forked_from_thread_key", "turn_key",
        F.col("ordinal").cast("long").alias("token_event_ordinal"), "operation", iso_utc(F.col("occurred_ts")).alias("occurred_at"), "model", "reasoning_effort", "source_kind", "cli_version", *[sorted_counts(c).alias(c) for c in ("cumulative", "delta", "reported_last")], "flags",
    )
    body = canonical_json(*[c for c in EVENT_FIELDS["usage_checkpoint"] if c != "event_id"])
    rows = rows.withColumn("event_id", derive(key, "usage_event", F.concat_ws(":", "source_event_id", F.col("revision").cast("string"), body)))
    return rows.withColumn("payload_json", canonical_json(*EVENT_FIELDS["usage_checkpoint"]))


def encode_mapping(rows: DataFrame, *, key: bytes) -> DataFrame:
    """event_id for mapping events that have all other fields."""
    names = [c for c in EVENT_FIELDS["mapping"] if c != "event_id"]
    logical = F.concat_ws(":", "kind", "subject_type", "subject_id")
    return rows.withColumn("event_id", derive(key, "mapping_event", F.concat_ws(":", logical, F.col("revision").cast("string"), canonical_json(*names))))
