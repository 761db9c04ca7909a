"""The whole diagnosis: all checks over the logs, the inventory, a device's tables, the ledger and the read model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import key_id
from ..operators import doctor
from ..operators.graph import build_lineage
from ..operators.projects import unresolved_thread_count
from ..operators.replay import replay
from ..sources import readmodel
from ..sources.ledger import line_violations, read_lines, stored_files, to_events
from ..sources.rollouts import discover, early_metadata, folders, text_at
from ..sources.rollouts import read_lines as read_log_lines
from ..sources.store import VERSION, LocalState, StoreError
from ..work import Scratch


def first_metadata(spark: SparkSession, home: str, work: Scratch) -> DataFrame:
    """(file, thread_id, parent, forked_from, cli_version) of logs whose first lines hold their metadata."""
    lines = read_log_lines(spark, *[path for _, path in folders(spark, home)], work=work)
    doc = F.try_parse_json("line")
    named = {"thread_id": "$.payload.id", "forked_from": "$.payload.forked_from_id", "cli_version": "$.payload.cli_version", "parent": "$.payload.source.subagent.thread_spawn.parent_thread_id"}
    return early_metadata(lines).select("file", *[text_at(doc, path).alias(name) for name, path in named.items()])


def diagnose(spark: SparkSession, home: str, state_root: str, ledger_root: str, model_root: str, *, key: bytes, expected_key_id: str, inventory: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(name, status, message) of thirteen checks; has_errors tells whether the whole fails.

    inventory(thread_id, rollout_path) and edges(child, parent) are those of the newest state database; None where there
    is none, which is a warning, as logs alone will do. Without a home, a readable state or a valid ledger the checks
    that need it are left out.
    """
    work, checks = Scratch(spark), [doctor.shared_key(spark, expected_key_id, key_id(key))]
    there = bool(folders(spark, home))
    files = work.save(discover(spark, home), "files")
    checks.append(doctor.rollouts(files, there))
    checks.append(doctor.state_database(spark, inventory, edges))
    metadata = work.save(first_metadata(spark, home, work), "metadata") if there else None
    if metadata is not None:
        all_files = files.select("file").join(metadata, "file", "left")
        checks.append(doctor.versions(all_files))
        if inventory is not None:
            checks.append(doctor.join_check(metadata.select("thread_id"), inventory))
        candidates = [metadata.where("parent is not null").select(F.col("thread_id").alias("child"), "parent", F.lit("session_source").alias("source")), metadata.where("forked_from is not null").select(F.col("thread_id").alias("child"), F.col("forked_from").alias("parent"), F.lit("fork").alias("source"))]
        if edges is not None:
            candidates.append(edges.select("child", "parent", F.lit("sqlite_spawn").alias("source")))
        rows = candidates[0]
        for more in candidates[1:]:
            rows = rows.unionByName(more)
        checks.append(doctor.lineage(build_lineage(rows, work)[1]))

    state = LocalState(spark, state_root)
    try:
        found = state.manifest()
        checks.append(doctor.local_state(spark, found["generation"] > 0, found["version"], VERSION))
    except StoreError:
        checks.append(doctor.local_state(spark, True, VERSION + 1, VERSION))
        found = {"generation": 0}
    if found["generation"]:
        runs = state.read("runs")
        for kind in ("collect", "sync"):
            checks.append(doctor.run_history(f"{kind}-history", runs.where(F.col("kind") == kind)))
        checks += [doctor.outbox(state.read("outbox")), doctor.parser_issues(state.read("issues"))]

    lines, torn = read_lines(stored_files(spark, ledger_root))
    bad = work.save(line_violations(lines), "violations")
    checks.append(doctor.ledger(bad, torn))
    if bad.isEmpty():
        done = replay(to_events(lines), work, expected_key=key_id(key))
        checks.append(doctor.classification(done.usage, unresolved_thread_count(done.usage)))
        model = readmodel.state(spark, model_root)
        written = spark.createDataFrame([] if model is None else [model], readmodel.STATE)
        checks.append(doctor.read_model(written, key_id(key), done.input_events, done.usage.count()))
    return doctor.doctor(*checks)
