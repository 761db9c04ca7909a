"""Project listings, unresolved work, and the rules that guard new mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_uuid
from ..work import Scratch
from .graph import would_close_cycle

# Which subjects a kind of mapping takes.
SUBJECTS = {"manual_assignment": ("thread", "turn"), "project_alias": ("project",), "project_name": ("project",), "device_name": ("device",)}


def project_list(usage: DataFrame) -> DataFrame:
    """Projects by falling total: threads, total, included and excluded events. Unclassified usage is left out."""
    t = F.col("delta_total_tokens")
    rows = usage.where("effective_project_id is not null").groupBy(F.col("effective_project_id").alias("project_id"))
    rows = rows.agg(F.count_distinct("thread_key").alias("threads"), F.coalesce(F.sum(t), F.lit(0)).alias("total_tokens"), F.count(t).alias("included_events"), F.count_if(t.isNull()).alias("excluded_events"))
    return rows.orderBy(F.col("total_tokens").desc(), "project_id")


def unresolved_threads(usage: DataFrame) -> DataFrame:
    t = F.col("delta_total_tokens")
    rows = usage.where("effective_project_id is null").groupBy("thread_key")
    return rows.agg(F.array_sort(F.collect_set("project_resolution")).alias("reasons"), F.sum(t).alias("total_tokens"), F.count(t).alias("included_events"), F.count_if(t.isNull()).alias("excluded_events"))


def unresolved_reasons(usage: DataFrame) -> DataFrame:
    return usage.where("effective_project_id is null").groupBy("project_resolution").agg(F.count("*").alias("events"), F.count_distinct("thread_key").alias("threads"))


def unresolved_thread_count(usage: DataFrame) -> DataFrame:
    """Distinct threads without a project, over all reasons: one row."""
    return usage.where("effective_project_id is null").agg(F.count_distinct("thread_key").alias("threads"))


def with_raw_threads(unresolved: DataFrame, threads: DataFrame) -> DataFrame:
    """Adds the local raw id of a thread key, where one is known: threads(thread_key, thread_id)."""
    return unresolved.join(threads, "thread_key", "left")


def known_projects(usage: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct project ids of events, of effective usage, and of mappings on either side."""
    pick = lambda df, c: df.select(F.col(c).alias("project_id"))
    rows = pick(usage, "project_id").union(pick(usage, "effective_project_id")).union(pick(mappings, "target_project_id")).union(pick(mappings.where("subject_type = 'project'"), "subject_id"))
    return rows.where("project_id is not null").distinct()


def known_subjects(usage: DataFrame, mappings: DataFrame) -> DataFrame:
    """(subject_type, subject_id) that usage or mappings name."""
    of = lambda t, c: usage.select(F.lit(t).alias("subject_type"), F.col(c).alias("subject_id"))
    rows = of("thread", "thread_key").union(of("turn", "turn_key")).union(known_projects(usage, mappings).select(F.lit("project"), "project_id")).union(of("device", "device_id")).union(mappings.select("subject_type", "subject_id"))
    return rows.where("subject_id is not null").distinct()


def mapping_refusals(new: DataFrame, usage: DataFrame, mappings: DataFrame, work: Scratch, local: DataFrame | None = None) -> DataFrame:
    """(row, code) for each row of new(row, kind, subject_type, subject_id, target_project_id) that may not be
    written: subject_type, target_id, unknown_target, unknown_subject, device_id, alias_cycle, unchanged.
    local(subject_type, subject_id): subjects known here beside those that usage and mappings name."""
    allowed = F.lit(False)
    for kind, subjects in SUBJECTS.items():
        allowed = allowed | ((F.col("kind") == kind) & F.col("subject_type").isin(*subjects))
    targets = known_projects(usage, mappings).withColumn("known_target", F.lit(True)).withColumnRenamed("project_id", "target_project_id")
    subjects = known_subjects(usage, mappings)
    if local is not None:
        subjects = subjects.unionByName(local.select("subject_type", "subject_id")).distinct()
    subjects = subjects.withColumn("known_subject", F.lit(True))
    now = mappings.select("kind", "subject_type", "subject_id", F.col("target_project_id").alias("now"))
    rows = new.join(targets, "target_project_id", "left").join(subjects, ["subject_type", "subject_id"], "left").join(now, ["kind", "subject_type", "subject_id"], "left")
    target = F.col("target_project_id")
    codes = [
        F.when(~allowed, F.lit("subject_type")),
        F.when(target.isNotNull() & ~target.rlike("^prj_"), F.lit("target_id")),
        F.when(target.isNotNull() & F.col("known_target").isNull(), F.lit("unknown_target")),
        F.when(F.col("known_subject").isNull(), F.lit("unknown_subject")),
        F.when((F.col("subject_type") == "device") & ~is_uuid(F.col("subject_id")), F.lit("device_id")),
        F.when(target.isNotNull() & (F.col("now") == target), F.lit("unchanged")),
    ]
    refused = rows.select("row", F.explode(F.array_compact(F.array(*codes))).alias("code"))
    edges = mappings.where("kind = 'project_alias' and target_project_id is not null").select(F.col("subject_id").alias("src"), F.col("target_project_id").alias("dst"))
    aliases = new.where("kind = 'project_alias' and target_project_id is not null").select(F.col("subject_id").alias("src"), F.col("target_project_id").alias("dst"), "row")
    return refused.unionByName(would_close_cycle(work.save(edges, "alias-edges"), aliases, work).select("row", F.lit("alias_cycle").alias("code")))


def next_revisions(new: DataFrame, mappings: DataFrame) -> DataFrame:
    """new with the revision and supersedes that continue the chains of mappings (latest revisions)."""
    key = ["kind", "subject_type", "subject_id"]
    now = mappings.select(*key, F.col("revision").alias("__r"), F.col("event_id").alias("supersedes"))
    return new.join(now, key, "left").withColumn("revision", F.coalesce("__r", F.lit(0)) + 1).drop("__r")
