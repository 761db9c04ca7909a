"""Operational tables (cursors, outbox, parser issues, runs) as keyed merges over versioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_relative
from ..operators.replay import payload_conflicts, require_empty


def merge_cursors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last cursor of each source_id (source_id, size, modified, last_record). A cursor of an unchanged file must not
    move back."""
    back = old.join(new.select("source_id", "size", "modified", F.col("last_record").alias("to")), ["source_id", "size", "modified"]).where(F.col("to") < F.col("last_record"))
    require_empty(back.select("source_id"), "cursors move back")
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.col("__new").desc()))
    return both.withColumn("__r", best).where("__r = 1").drop("__r", "__new")


def enqueue(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """outbox(event_id, payload_json, sequence, flushed_at) with new events behind; same id and payload is nothing new."""
    require_empty(payload_conflicts(outbox.select("event_id", "payload_json").unionByName(events.select("event_id", "payload_json"))), "outbox")
    new = events.dropDuplicates(["event_id"]).join(outbox, "event_id", "left_anti").select("event_id", "payload_json")
    last = outbox.agg(F.coalesce(F.max("sequence"), F.lit(0))).first()[0]
    numbered = new.withColumn("sequence", F.lit(last) + 1 + F.monotonically_increasing_id()).withColumn("flushed_at", F.lit(None).cast("timestamp"))
    return outbox.unionByName(numbered)


def pending(outbox: DataFrame, limit: int) -> DataFrame:
    return outbox.where("flushed_at is null").orderBy("sequence").limit(limit)


def mark_flushed(outbox: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(event_id, ledger_path): relative paths only."""
    require_empty(paths.where(~safe_relative(F.col("ledger_path"))), "paths")
    done = paths.select("event_id", F.lit(True).alias("__done"))
    return outbox.join(done, "event_id", "left").withColumn("flushed_at", F.coalesce("flushed_at", F.when(F.col("__done"), F.current_timestamp()))).select(*outbox.columns)


def known_source_ids(payloads: DataFrame) -> DataFrame:
    """Distinct source_event_id of usage payloads."""
    get = lambda f: F.get_json_object("payload_json", f"$.{f}")
    return payloads.where(get("event_type") == "usage_checkpoint").select(get("source_event_id").alias("source_event_id")).where("source_event_id is not null").distinct()


def record_issues(issues: DataFrame, new: DataFrame) -> DataFrame:
    return issues.unionByName(new).dropDuplicates(["source_id", "record_index", "code"])


def begin_run(runs: DataFrame, kind: str) -> DataFrame:
    """runs with a running row behind; its id is one more than the last."""
    last = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"))
    new = {"status": F.lit("running"), "kind": F.lit(kind), "detail": F.lit(None), "started_at": F.current_timestamp(), "finished_at": F.lit(None)}
    return runs.unionByName(last.select(*[new.get(f.name, F.col("run_id")).cast(f.dataType).alias(f.name) for f in runs.schema.fields]))


def flush_totals(batches: DataFrame) -> DataFrame:
    """One row of sums over batches(selected, appended, present, flushed); a batch that does not flush all it
    selected is an error, since the next would select the same."""
    require_empty(batches.where("flushed < selected"), "a flush made no full progress")
    return batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("selected", "appended", "present", "flushed")])


def finish_run(runs: DataFrame, run_id: int, status: str, detail: str | None = None) -> DataFrame:
    """runs(run_id, status, detail, started_at, finished_at) with a running row finished."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "running")
    return runs.withColumns({"finished_at": F.when(mine, F.current_timestamp()).otherwise(F.col("finished_at")), "detail": F.when(mine, F.lit(detail)).otherwise(F.col("detail")), "status": F.when(mine, F.lit(status)).otherwise(F.col("status"))})


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(1)
