"""Diagnostics: each check is a small query that ends in (name, status, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = r"^\d+\.\d+\.\d+"


def check(name: str, counts: DataFrame, status: Column, message: Column) -> DataFrame:
    """counts: one row."""
    return counts.select(F.lit(name).alias("name"), status.alias("status"), message.alias("message"))


def warn_if(test: Column) -> Column:
    return F.when(test, "warning").otherwise("ok")


def says(pattern: str, *values) -> Column:
    return F.format_string(pattern, *values)


def rollouts(files: DataFrame, there: bool = True) -> DataFrame:
    """A home that is missing is an error, one without logs a warning."""
    n = files.agg(F.count("*").alias("n"))
    return check("rollouts", n, warn_if(F.col("n") == 0) if there else F.lit("error"), says("%d files", "n") if there else F.lit("the home is missing"))


def lineage(issues: DataFrame) -> DataFrame:
    return check("lineage", issues.agg(F.count("*").alias("n")), warn_if(F.col("n") > 0), says("%d issues", "n"))


def version_inventory(metadata: DataFrame) -> DataFrame:
    """One row: versions (sorted distinct), missing, invalid."""
    v = F.col("cli_version")
    return metadata.agg(F.array_sort(F.collect_set(F.when(v.rlike(VERSION), v))).alias("versions"), F.count_if(v.isNull()).alias("missing"), F.count_if(v.isNotNull() & ~v.rlike(VERSION)).alias("invalid"))


def versions(metadata: DataFrame) -> DataFrame:
    shown = F.array_join(F.slice("versions", 1, 5), ", ")
    more = F.when(F.size("versions") > 5, says(" and %d more", F.size("versions") - 5)).otherwise("")
    bad = (F.size("versions") == 0) | (F.col("missing") > 0) | (F.col("invalid") > 0)
    return check("versions", version_inventory(metadata), warn_if(bad), F.concat(shown, more, says("; %d missing, %d invalid", "missing", "invalid")))


def source_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys on one side only and on both: one row."""
    joined = left.select(key, F.lit(True).alias("l")).distinct().join(right.select(key, F.lit(True).alias("r")).distinct(), key, "full")
    return joined.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def join_check(rollout_threads: DataFrame, inventory: DataFrame) -> DataFrame:
    """Only inventory rows that name a rollout count."""
    counts = source_join(rollout_threads, inventory.where("rollout_path is not null"), "thread_id")
    return check("source-join", counts, warn_if((F.col("left_only") > 0) | (F.col("right_only") > 0)), says("%d in logs only, %d in the inventory only", "left_only", "right_only"))


def state_database(spark: SparkSession, threads: DataFrame | None, edges: DataFrame | None) -> DataFrame:
    """None is a warning: the logs will do."""
    if threads is None:
        return check("state-db", spark.range(1), F.lit("warning"), F.lit("no state database; logs only"))
    n = threads.agg(F.count("*").alias("threads"), F.lit(0).alias("k"))
    m = edges.agg(F.count("*").alias("edges"), F.lit(0).alias("k")) if edges is not None else spark.range(1).select(F.lit(0).alias("edges"), F.lit(0).alias("k"))
    return check("state-db", n.join(m, "k"), F.lit("ok"), says("%d threads, %d edges", "threads", "edges"))


def local_state(spark: SparkSession, there: bool, found: int, version: int) -> DataFrame:
    """None yet is a warning, a newer one an error, an older one a warning."""
    status = "warning" if not there or found < version else "error" if found > version else "ok"
    return check("local-state", spark.range(1), F.lit(status), F.lit(f"version {found}, known {version}" if there else "no state yet"))


def run_history(name: str, runs: DataFrame) -> DataFrame:
    """runs(run_id, status, finished_at); the last run must have succeeded."""
    last = runs.agg(F.max_by("status", "run_id").alias("status"), F.max(F.when(F.col("status") == "succeeded", F.col("finished_at"))).alias("success"))
    return check(name, last, warn_if(~F.coalesce(F.col("status") == "succeeded", F.lit(False))), says("last run %s, last success %s", F.coalesce("status", F.lit("none")), F.coalesce(F.col("success").cast("string"), F.lit("never"))))


def outbox_counts(outbox: DataFrame) -> DataFrame:
    return outbox.agg(F.count_if(F.col("flushed_at").isNull()).alias("pending"), F.count_if(F.col("flushed_at").isNotNull()).alias("flushed"))


def outbox(rows: DataFrame) -> DataFrame:
    return check("outbox", outbox_counts(rows), warn_if(F.col("pending") > 0), says("%d pending", "pending"))


def summary(rows: DataFrame, code: str) -> DataFrame:
    """Number of rows and `code=count` in order of codes: one row."""
    counts = rows.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("c"))
    listed = F.array_sort(F.collect_list(F.struct("code", "c")))
    return counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.array_join(F.transform(listed, lambda x: F.concat(x["code"], F.lit("="), x["c"].cast("string"))), ", ").alias("list"))


def parser_issues(issues: DataFrame) -> DataFrame:
    return check("parser-issues", summary(issues, "code"), warn_if(F.col("n") > 0), says("%d: %s", "n", "list"))


def classification(usage: DataFrame, threads: DataFrame) -> DataFrame:
    """threads: one row with the number of threads that have unresolved events."""
    counts = summary(usage.where("effective_project_id is null"), "project_resolution").withColumn("k", F.lit(0)).join(threads.select("threads", F.lit(0).alias("k")), "k")
    return check("classification", counts, warn_if(F.col("n") > 0), says("%d events of %d threads: %s", "n", "threads", "list"))


def ledger(violations: DataFrame, partial_files: DataFrame) -> DataFrame:
    both = violations.agg(F.count("*").alias("v")).withColumn("k", F.lit(0)).join(partial_files.agg(F.count("*").alias("p")).withColumn("k", F.lit(0)), "k")
    status = F.when(F.col("v") > 0, "error").otherwise(warn_if(F.col("p") > 0))
    return check("ledger", both, status, says("%d violations, %d partial files", "v", "p"))


def read_model(state: DataFrame, key_id: str, input_events: int, usage_events: int) -> DataFrame:
    same = F.col("key_id").eqNullSafe(key_id) & (F.col("input_event_count") == input_events) & (F.col("effective_usage_count") == usage_events)
    one = state.agg(F.max_by(F.struct("key_id", "input_event_count", "effective_usage_count"), "generation").alias("s")).select("s.*")
    return check("read-model", one, warn_if(~F.coalesce(same, F.lit(False))), F.lit("compared with a replay"))


def shared_key(spark: SparkSession, expected: str, found: str) -> DataFrame:
    return spark.range(1).select(F.lit("shared-key").alias("name"), F.lit("ok" if expected == found else "error").alias("status"), F.lit("key id").alias("message"))


def doctor(*checks: DataFrame) -> DataFrame:
    """All checks as one table; the run fails if one has status error."""
    return reduce(DataFrame.unionByName, checks)


def has_errors(report: DataFrame) -> bool:
    return not report.where("status = 'error'").isEmpty()
