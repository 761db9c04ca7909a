"""Deterministic replay of the ledger: exact duplicates, key spaces, revision chains, voids, manual assignments,
aliases. Every rule that fails closed has a DataFrame of its violations beside it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utc_instant
from ..work import Scratch
from .graph import flatten_aliases


class LedgerError(ValueError):
    pass


class Replay(NamedTuple):
    usage: DataFrame
    mappings: DataFrame
    quotas: DataFrame
    aliases: DataFrame
    alias_cycles: DataFrame
    input_events: int


def payload_conflicts(events: DataFrame, payload: str = "payload_json") -> DataFrame:
    """event_ids under which payloads differ: the least and the greatest digest do."""
    digest = F.sha2(F.coalesce(F.col(payload), F.lit("")), 256)
    return events.groupBy("event_id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least <> most").select("event_id")


def event_id_conflicts(events: DataFrame, payload: str = "payload_json") -> DataFrame:
    """event_ids under which payloads differ, and how many there are."""
    return events.join(payload_conflicts(events, payload), "event_id", "left_semi").groupBy("event_id").agg(F.count_distinct(payload).alias("payloads"))


def exact_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["event_id"])


def key_violations(events: DataFrame, expected: str | None = None) -> DataFrame:
    """Key ids that should not be there: any but the expected one, or all where there are several."""
    keys = events.select("key_id").distinct()
    if expected is not None:
        return keys.where(F.col("key_id") != expected)
    return keys.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1)))).where("n > 1").drop("n")  # distinct keys: a handful


def revision_violations(events: DataFrame, key: str) -> DataFrame:
    """(key, revision, code): chains that are not 1..n, or whose supersedes is not the event before."""
    order = Window.partitionBy(key).orderBy("revision", "event_id")
    rows = events.select(key, "revision", "event_id", "supersedes", F.lag("event_id").over(order).alias("before"), F.lag("revision").over(order).alias("was"))
    expected = F.coalesce(F.col("was"), F.lit(0)) + 1
    code = F.when(F.col("revision") == F.col("was"), "revision_conflict").when(F.col("revision") != expected, "revision_gap").when(~F.col("supersedes").eqNullSafe(F.col("before")), "supersedes_mismatch")
    return rows.select(key, "revision", code.alias("code")).where("code is not null")


def latest_revisions(events: DataFrame, key: str) -> DataFrame:
    """The last revision of each key."""
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.col("revision").desc(), F.col("event_id").desc()))
    return events.withColumn("__place", best).where("__place = 1").drop("__place")


def mapping_key() -> Column:
    return F.concat_ws(":", "kind", "subject_type", "subject_id")


def manual_assignments(mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, threads) from latest mappings; a null target clears an assignment."""
    rows = mappings.where("kind = 'manual_assignment' and target_project_id is not null")
    pick = lambda subject, name: rows.where(F.col("subject_type") == subject).select(F.col("subject_id").alias(name), F.col("target_project_id").alias(f"manual_{subject}"))
    return pick("turn", "turn_key"), pick("thread", "thread_key")


def effective_projects(usage: DataFrame, turns: DataFrame, threads: DataFrame, aliases: DataFrame) -> DataFrame:
    """usage with effective_project_id: turn before thread before the event's own, then through the alias."""
    rows = usage.join(turns, "turn_key", "left").join(threads, "thread_key", "left")
    rows = rows.withColumn("__own", F.coalesce("manual_turn", "manual_thread", "project_id"))
    rows = rows.join(aliases.select(F.col("source").alias("__own"), F.col("target").alias("__final")), "__own", "left")
    return rows.withColumn("effective_project_id", F.coalesce("__final", "__own")).select(*usage.columns, "effective_project_id")


def mapping_violations(mappings: DataFrame) -> DataFrame:
    manual = (F.col("kind") == "manual_assignment") & ~F.col("subject_type").isin("turn", "thread")
    alias = (F.col("kind") == "project_alias") & (F.col("subject_type") != "project")
    return mappings.select("event_id", F.when(manual, "manual_subject").when(alias, "alias_subject").alias("code")).where("code is not null")


def normalisation_violations(events: DataFrame) -> DataFrame:
    """Events that cannot be replayed: schema version, type, ids, UTC time, revision."""
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    rules = [
        (~F.col("schema_version").eqNullSafe(1), "schema_version"),
        (~F.coalesce(F.col("event_type").isin("usage_checkpoint", "mapping", "quota_snapshot"), F.lit(False)), "event_type"),
        (empty("event_id"), "event_id"),
        (empty("key_id"), "key_id"),
        (utc_instant(F.col("occurred_at")).isNull(), "occurred_at"),
        ((F.col("event_type") != "quota_snapshot") & ~F.coalesce(F.col("revision") >= 1, F.lit(False)), "revision"),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))
    return events.select("event_id", F.explode(codes).alias("code"))


def require_empty(violations: DataFrame, what: str) -> None:
    found = violations.limit(3).collect()
    if found:
        raise LedgerError(f"{what}: {[r.asDict() for r in found]}")


def time_order(events: DataFrame) -> DataFrame:
    """Replayed events in the order of time, then of ids."""
    return events.orderBy(utc_instant(F.col("occurred_at")), "event_id")


def replay(events: DataFrame, work: Scratch, *, expected_key: str | None = None) -> Replay:
    """events: the columns of schemas.EVENT and payload_json. Raises LedgerError where a rule fails."""
    events = work.save(events, "input")  # read, parsed and checked once
    require_empty(normalisation_violations(events), "events cannot be replayed")
    require_empty(payload_conflicts(events), "one event_id, several payloads")
    rows = work.save(exact_events(events), "events")
    require_empty(key_violations(rows, expected_key), "key ids differ")
    usage, mappings, quotas = (rows.where(F.col("event_type") == t) for t in ("usage_checkpoint", "mapping", "quota_snapshot"))
    mappings = mappings.withColumn("logical_key", mapping_key())
    require_empty(revision_violations(usage, "source_event_id"), "usage revisions")
    require_empty(revision_violations(mappings, "logical_key"), "mapping revisions")
    usage = latest_revisions(usage, "source_event_id").where("not voided")
    mappings = work.save(latest_revisions(mappings, "logical_key"), "mappings")
    require_empty(mapping_violations(mappings), "mapping subjects")
    edges = mappings.where("kind = 'project_alias' and target_project_id is not null").select(F.col("subject_id").alias("src"), F.col("target_project_id").alias("dst"))
    aliases, cycles = flatten_aliases(edges, work)
    usage = effective_projects(usage, *manual_assignments(mappings), aliases)
    return Replay(usage.withColumn("occurred_ts", utc_instant(F.col("occurred_at"))), mappings, quotas, aliases, cycles, rows.count())
