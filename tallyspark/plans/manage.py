"""`link` and `alias`: new mappings, checked against the replay of ledger and outbox, then appended."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import derive, key_id, opaque_or_derived
from ..functions.text import canonical_json
from ..operators.encode import encode_mapping, iso_utc
from ..operators.projects import mapping_refusals, next_revisions
from ..operators.replay import Replay, replay, require_empty
from ..schemas import EVENT_FIELDS
from ..sources.ledger import read_ledger, to_events
from ..sources.state import enqueue
from ..work import Scratch
from .collect import flush


class Written(NamedTuple):
    outbox: DataFrame
    mappings: DataFrame
    appended: int


def replay_without_cycles(events: DataFrame, key: bytes, what: str) -> Replay:
    done = replay(events, Scratch(events.sparkSession), expected_key=key_id(key))
    require_empty(done.alias_cycles, what)
    return done


def known_events(spark: SparkSession, ledger_root: str, outbox: DataFrame) -> DataFrame:
    """Events of the ledger and those that wait in the outbox."""
    events, torn = read_ledger(spark, ledger_root)
    require_empty(torn, "ledger files with a torn last line")
    waiting = to_events(outbox.where("flushed_at is null").select(F.col("payload_json").alias("value")))
    return events.select(waiting.columns).unionByName(waiting)


def write_mappings(spark: SparkSession, ledger_root: str, outbox: DataFrame, wanted: DataFrame, *, key: bytes, device_id: str, local: DataFrame | None = None) -> Written:
    """wanted(kind, subject_type, subject_id, target_project_id), a subject once. Targets are followed through aliases.

    All rows are written or, if a rule refuses one, none (LedgerError); rows that change nothing are left out.
    """
    work = Scratch(spark)
    events = work.save(known_events(spark, ledger_root, outbox), "known")
    now = replay_without_cycles(events, key, "the ledger holds an alias cycle")
    final = now.aliases.select(F.col("source").alias("target_project_id"), F.col("target").alias("final"))
    new = wanted.join(final, "target_project_id", "left").withColumn("target_project_id", F.coalesce("final", "target_project_id")).drop("final")
    new = work.save(new.withColumn("row", F.monotonically_increasing_id()), "wanted")
    refused = work.save(mapping_refusals(new, now.usage, now.mappings, work, local), "refused")
    same = refused.where("code = 'unchanged'").select("row").distinct()
    require_empty(refused.where("code <> 'unchanged'").join(new, "row"), "mappings that may not be written")
    rows = next_revisions(new.join(same, "row", "left_anti").drop("row"), now.mappings)
    rows = rows.withColumns({"schema_version": F.lit(1).cast("long"), "event_type": F.lit("mapping"), "revision": F.col("revision").cast("long"), "device_id": F.lit(device_id), "key_id": F.lit(key_id(key)), "occurred_at": iso_utc(F.current_timestamp()), "display_value": F.lit(None).cast("string")})
    rows = work.save(encode_mapping(rows, key=key).select(*EVENT_FIELDS["mapping"]), "mappings")
    payloads = work.save(rows.select("event_id", canonical_json(*EVENT_FIELDS["mapping"]).alias("payload_json")), "payloads")
    # rows that only together close a cycle, or name a subject twice, show here
    replay_without_cycles(events.unionByName(to_events(payloads.select(F.col("payload_json").alias("value")))), key, "the aliases close a cycle")
    outbox, totals = flush(spark, ledger_root, work.save(enqueue(outbox, payloads), "outbox"), key=key, device_id=device_id, work=work)
    return Written(outbox, rows, totals["appended"])


def link(spark: SparkSession, ledger_root: str, outbox: DataFrame, rows: DataFrame, *, key: bytes, device_id: str, threads: DataFrame | None = None) -> Written:
    """Assign threads or turns to projects: rows(subject_type, subject, target_project_id), subject a raw or an opaque
    id. threads(thread_id): the local inventory, whose threads may be linked before they have usage."""
    opaque = F.when(F.lit(False), F.lit(""))
    for kind in ("thread", "turn"):
        mine = F.when(F.col("subject_type") == kind, F.col("subject"))
        opaque = opaque.when(F.col("subject_type") == kind, opaque_or_derived(mine, kind, derive(key, kind, mine)))
    rows = rows.select(F.lit("manual_assignment").alias("kind"), "subject_type", "subject", opaque.alias("subject_id"), "target_project_id")
    require_empty(rows.where("subject_id is null or target_project_id is null"), "subjects that are no threads or turns, or no target")
    local = None if threads is None else threads.select(F.lit("thread").alias("subject_type"), derive(key, "thread", F.col("thread_id")).alias("subject_id"))
    return write_mappings(spark, ledger_root, outbox, rows.drop("subject"), key=key, device_id=device_id, local=local)


def alias(spark: SparkSession, ledger_root: str, outbox: DataFrame, rows: DataFrame, *, key: bytes, device_id: str) -> Written:
    """Let projects stand for others: rows(source_project_id, target_project_id)."""
    require_empty(rows.where("source_project_id is null or target_project_id is null"), "an alias needs a source and a target")
    wanted = rows.select(F.lit("project_alias").alias("kind"), F.lit("project").alias("subject_type"), F.col("source_project_id").alias("subject_id"), "target_project_id")
    return write_mappings(spark, ledger_root, outbox, wanted, key=key, device_id=device_id)
