"""From session logs to ledger events: parse, deltas, fork dedup, lineage, attribution, encoding.

All logs are recomputed, so what a fork copied is credited alike whatever was collected first; events that the
ledger knows are left out at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.identity import key_id
from ..functions.remote import is_local, normalize_remote
from ..operators.attribution import attribute
from ..operators.encode import encode_usage, source_ids
from ..operators.graph import build_lineage, roots
from ..operators.lifecycle import calculate_deltas, deduplicate_events, fork_conflicts, fork_depths
from ..operators.replay import require_empty
from ..operators.scan import SPLIT_ROWS
from ..sources.changes import changed_logs
from ..sources.ledger import append_events, read_ledger, relative_path, to_events
from ..sources.rollouts import Parsed, changed, discover, folders, parse_rollouts, read_lines
from ..sources.state import begin_run, enqueue, finish_run, flush_totals, known_source_ids, latest_run, mark_flushed, merge_cursors, record_issues
from ..sources.store import LocalState
from ..work import Scratch

STRINGS = "array<string>"


def parent_candidates(metadata: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(child, parent, source) from session sources, forks and spawn edges."""
    rows = metadata.where("source_parent_thread_id is not null").select(F.col("thread_id").alias("child"), F.col("source_parent_thread_id").alias("parent"), F.lit("session_source").alias("source"))
    rows = rows.unionByName(metadata.where("forked_from is not null").select(F.col("thread_id").alias("child"), F.col("forked_from").alias("parent"), F.lit("fork").alias("source")))
    if edges is not None:
        rows = rows.unionByName(edges.where("child is not null and parent is not null").select("child", "parent", F.lit("sqlite_spawn").alias("source")))
    return rows


def probed_remotes(evidence: DataFrame) -> DataFrame:
    """(workdir, repository, kind, canonical) of each repository among evidence(workdir, status, repository_root,
    remotes): origin, one unique remote, several (ambiguous), only local ones, none. Hosts of any script."""
    rows = evidence.where("status = 'repository'").select("workdir", F.col("repository_root").alias("repository"), F.explode_outer("remotes").alias("remote"))
    url = F.col("remote.url")
    rows = rows.select("workdir", "repository", F.col("remote.name").alias("name"), normalize_remote(url, exotic=True).alias("canonical"), is_local(url).alias("local"))
    rows = rows.groupBy("workdir", "repository").agg(
        F.max(F.when(F.col("name") == "origin", F.col("canonical"))).alias("own"),
        F.array_sort(F.collect_set("canonical")).alias("names"),
        F.coalesce(F.bool_or("local"), F.lit(False)).alias("local"),
    )
    n = F.size("names")
    kind = F.when(F.col("own").isNotNull(), "self_origin").when(n == 1, "unique_remote").when(n > 1, "ambiguous_remote").when(F.col("local"), "local_only").otherwise("unclassified")
    return rows.select("workdir", "repository", kind.alias("kind"), F.coalesce("own", F.when(n == 1, F.get("names", F.lit(0)))).alias("canonical"))


def repository_activity(checkpoints: DataFrame, probed: DataFrame, local: DataFrame | None) -> DataFrame:
    """Rows for activity_evidence from working directories: probed (see probed_remotes), local(repository_root,
    project)."""
    dirs = checkpoints.select("checkpoint", F.explode("activity_workdirs").alias("workdir"))
    rows = dirs.join(probed, "workdir").select("checkpoint", "repository", "canonical", (F.col("kind") == "ambiguous_remote").alias("ambiguous"))
    if local is None:
        return rows.withColumn("mapped", F.array().cast(STRINGS))
    mapped = local.groupBy(F.col("repository_root").alias("repository")).agg(F.collect_set("project").alias("mapped"))
    return rows.join(mapped, "repository", "left")


def thread_places(metadata: DataFrame, inventory: DataFrame | None) -> DataFrame:
    """(thread_id, url, stored, workdir) of all threads of the logs and of the inventory: the session's URL, the inventory's,
    and the working directory of the session, else of the inventory."""
    rows = metadata.groupBy("thread_id").agg(F.first("git_repository_url", ignorenulls=True).alias("url"), F.first("cwd", ignorenulls=True).alias("cwd"))
    if inventory is None:
        return rows.select("thread_id", "url", F.lit(None).cast("string").alias("stored"), F.col("cwd").alias("workdir"))
    stored = inventory.where("thread_id is not null").groupBy("thread_id").agg(F.first("git_origin_url", ignorenulls=True).alias("stored"), F.first("cwd", ignorenulls=True).alias("stored_cwd"))
    return rows.join(stored, "thread_id", "full").select("thread_id", "url", "stored", F.coalesce("cwd", "stored_cwd").alias("workdir"))


def self_remotes(places: DataFrame, probed: DataFrame) -> DataFrame:
    """Own remote of each thread (see thread_places): the session's URL, else the inventory's, else that of its working
    directory."""
    found = probed.dropDuplicates(["workdir"]).select("workdir", "kind", "canonical")
    own = F.coalesce(normalize_remote(F.col("url"), exotic=True), normalize_remote(F.col("stored"), exotic=True))
    rows = places.withColumn("own", own).join(found, "workdir", "left")
    return rows.select("thread_id", F.when(F.col("own").isNotNull(), "self_origin").otherwise(F.col("kind")).alias("self_kind"), F.coalesce("own", "canonical").alias("self_canonical"))


def local_threads(places: DataFrame, probed: DataFrame, local: DataFrame) -> DataFrame:
    """(thread_id, local_project) of threads whose working directory lies in a repository that local(repository_root,
    project) maps to one project."""
    mapped = local.groupBy(F.col("repository_root").alias("repository")).agg(F.collect_set("project").alias("projects")).where(F.size("projects") == 1)
    found = probed.dropDuplicates(["workdir"]).select("workdir", "repository").join(mapped, "repository")
    return places.join(found, "workdir").select("thread_id", F.get("projects", F.lit(0)).alias("local_project"))


def collect(spark: SparkSession, lines: DataFrame, evidence: DataFrame, *, key: bytes, device_id: str, parser_version: str = "1", inventory: DataFrame | None = None, edges: DataFrame | None = None, local: DataFrame | None = None, manual: DataFrame | None = None, known: DataFrame | None = None) -> tuple[DataFrame, Parsed]:
    """(new ledger events with payload_json, what the parser found). evidence: repository table; known(source_event_id);
    local(repository_root, project); manual(subject_type `turn` or `thread`, subject, project): raw ids and identities."""
    work = Scratch(spark)
    parsed = parse_rollouts(lines, work)
    metadata = work.save(parsed.metadata, "metadata")
    checkpoints = work.save(parsed.checkpoints, "checkpoints")
    events = work.save(calculate_deltas(checkpoints, split_rows=SPLIT_ROWS), "deltas")
    require_empty(fork_conflicts(events), "copies of one event differ")
    unique = deduplicate_events(events, fork_depths(metadata, work)).withColumn("checkpoint", F.to_json("logical_key"))
    unique = work.save(unique, "unique")
    parents, _ = build_lineage(parent_candidates(metadata, edges), work)
    parents = work.save(parents, "lineage")
    declared = metadata.select("thread_id", F.col("root_session_id").alias("root")).dropDuplicates(["thread_id"])
    root = work.save(roots(metadata.select("thread_id"), parents, declared, work), "roots")
    probed = work.save(probed_remotes(evidence), "probed")
    places = work.save(thread_places(metadata, inventory), "places")
    if manual is None:
        manual = spark.createDataFrame([], "subject_type string, subject string, project string")
    assigned = lambda kind, subject, name: manual.where(F.col("subject_type") == kind).groupBy(F.col("subject").alias(subject)).agg(F.max("project").alias(name))
    nowhere = spark.createDataFrame([], "thread_id string, local_project string")
    done = attribute(
        unique,
        activity=repository_activity(unique, probed, local),
        self_remotes=self_remotes(places, probed),
        parents=parents,
        roots=root,
        manual=assigned("thread", "thread_id", "manual_project"),
        manual_turns=assigned("turn", "turn_id", "manual_turn"),
        local=nowhere if local is None else local_threads(places, probed, local),
        work=work,
    )
    done = done.join(root, "thread_id", "left").join(parents.select(F.col("child").alias("thread_id"), "parent"), "thread_id", "left")
    done = done.join(metadata.select("thread_id", "source_kind", "cli_version").dropDuplicates(["thread_id"]), "thread_id")
    done = source_ids(done, key)
    if known is not None:
        done = done.join(known, "source_event_id", "left_anti")
    return encode_usage(done, key=key, device_id=device_id, parser_version=parser_version), parsed


class Collected(NamedTuple):
    outbox: DataFrame
    cursors: DataFrame
    issues: DataFrame
    fatal: DataFrame
    busy: DataFrame
    appended: int


def flush(spark: SparkSession, ledger_root: str, outbox: DataFrame, *, key: bytes, device_id: str, work: Scratch) -> tuple[DataFrame, Row]:
    """Append what waits in the outbox to the ledger: (outbox with all flushed, totals of events selected, appended, present
    before and flushed). A run that stopped after the append finds its events in the ledger and only marks them."""
    waiting = work.save(to_events(outbox.where("flushed_at is null").select(F.col("payload_json").alias("value"))), "waiting")
    n = append_events(spark, ledger_root, waiting, device_id=device_id, key_id=key_id(key))
    paths = waiting.select("event_id", relative_path(F.col("device_id"), F.col("event_type"), F.col("occurred_at")).alias("ledger_path"))
    flushed = work.save(mark_flushed(outbox, paths), "flushed")
    selected = waiting.count()
    marked = flushed.where("flushed_at is not null").join(waiting.select("event_id"), "event_id", "left_semi").count()
    batch = spark.createDataFrame([(selected, n, selected - n, marked)], "selected long, appended long, present long, flushed long")
    return flushed, flush_totals(batch).first()


def gather(spark: SparkSession, home: str, ledger_root: str, evidence: DataFrame, *, key: bytes, device_id: str, cursors: DataFrame, outbox: DataFrame, work: Scratch, **options) -> Collected:
    """What a run finds, before anything reaches the ledger; see collect_files. A ledger of another key is refused."""
    found = work.save(discover(spark, home), "files")  # sizes and times only
    sources = found.select("file", "source_id", "size", "modified")
    nothing = spark.createDataFrame([], "source_id string, record_index long, code string")
    idle = nothing.select("source_id")
    if changed(sources, cursors).isEmpty():
        return Collected(outbox, cursors, nothing, nothing, idle, 0)
    ledger, torn = read_ledger(spark, ledger_root)
    require_empty(torn, "ledger files with a torn last line")
    require_empty(ledger.where(F.col("key_id") != key_id(key)).select("event_id"), "the ledger has events of another key")
    lines = read_lines(spark, *[path for _, path in folders(spark, home)], work=work)
    # files that are not what they were before they were read wait for the next run
    still = work.save(discover(spark, home).join(sources, ["file", "source_id", "size", "modified"], "left_semi").select(*sources.columns), "still")
    busy = work.save(sources.join(still.select("file"), "file", "left_anti").select("source_id"), "busy")
    lines = work.save(lines.join(still.select("file"), "file", "left_semi"), "numbered")
    known = ledger.where("event_type = 'usage_checkpoint'").select("source_event_id").union(known_source_ids(outbox)).distinct()
    events, parsed = collect(spark, lines, evidence, key=key, device_id=device_id, known=work.save(known, "known"), **options)
    outbox = work.save(enqueue(outbox, work.save(events.select("event_id", "payload_json"), "new")), "outbox")
    named = lambda df: df.join(still.select("file", "source_id"), "file").select("source_id", "record_index", "code")
    fatal = work.save(named(parsed.fatal), "fatal")
    read = lines.groupBy("file").agg(F.max("record_index").cast("long").alias("last_record"))
    new = still.join(read, "file").join(fatal, "source_id", "left_anti").select("source_id", "size", "modified", "last_record")
    return Collected(outbox, work.save(merge_cursors(cursors, new), "cursors"), work.save(named(parsed.issues), "issues"), fatal, busy, 0)


def collect_files(spark: SparkSession, home: str, ledger_root: str, evidence: DataFrame, *, key: bytes, device_id: str, cursors: DataFrame, outbox: DataFrame, **options) -> Collected:
    """From the logs below home to the ledger. cursors(source_id, size, modified, last_record) and
    outbox(event_id, payload_json, sequence, flushed_at) are the state before; the result holds the state after.

    Nothing is read where no log changed since its cursor. Otherwise all logs are, and only events that neither
    ledger nor outbox knows are new. A log that is unusable is named in fatal, one that changed while it was read in
    busy; neither gets a cursor, so both are tried again. options: see collect.
    """
    work = Scratch(spark)
    done = gather(spark, home, ledger_root, evidence, key=key, device_id=device_id, cursors=cursors, outbox=outbox, work=work, **options)
    outbox, totals = flush(spark, ledger_root, done.outbox, key=key, device_id=device_id, work=work)
    return done._replace(outbox=outbox, appended=totals["appended"])


def collect_run(spark: SparkSession, home: str, state: LocalState, ledger_root: str, evidence: DataFrame, *, key: bytes, device_id: str, batch: int | None = None, **options) -> Collected:
    """collect_files over the tables of a device, as one run of its history.

    Cursors, outbox and issues of a run become valid together, before its events go to the ledger; events that a stopped
    run had appended are found there and only marked. So a run that stops between any two steps and is started again ends
    as one that did not stop. A batch that the state has already is not gathered again.
    """
    work = Scratch(spark)
    runs = work.save(begin_run(state.read("runs"), "collect"), "runs")
    run = latest_run(runs).first()["run_id"]
    state.commit(runs=runs)
    try:
        before = state.manifest()["batch"]
        cursors, outbox, issues = (state.read(t) for t in ("cursors", "outbox", "issues"))
        if batch is not None and before is not None and batch <= before:
            nothing = issues.where("false")
            done = Collected(outbox, cursors, nothing, nothing, nothing.select("source_id"), 0)
        else:
            done = gather(spark, home, ledger_root, evidence, key=key, device_id=device_id, cursors=cursors, outbox=outbox, work=work, **options)
            found = done.issues.unionByName(done.fatal.withColumn("code", F.concat(F.lit("fatal:"), "code")))
            # what a file says now takes the place of what it said in an earlier state
            kept = issues.join(done.cursors.join(cursors, cursors.columns, "left_anti").select("source_id"), "source_id", "left_anti")
            state.commit(batch=batch, cursors=done.cursors, outbox=done.outbox, issues=record_issues(kept, found))
        outbox, totals = flush(spark, ledger_root, state.read("outbox"), key=key, device_id=device_id, work=work)
        state.commit(outbox=outbox, runs=finish_run(state.read("runs"), run, "succeeded"))
    except Exception as error:
        state.commit(runs=finish_run(state.read("runs"), run, "failed", type(error).__name__))
        raise
    return done._replace(outbox=state.read("outbox"), appended=totals["appended"])


def collect_stream(spark: SparkSession, home: str, state: LocalState, ledger_root: str, evidence: DataFrame, checkpoint: str, *, settle: float = 0.2, **options) -> StreamingQuery:
    """collect_run for every micro-batch of changed logs that stand still, until there is none; options: see collect_run."""

    def run(changes: DataFrame, batch: int) -> None:
        collect_run(changes.sparkSession, home, state, ledger_root, evidence, batch=batch, **options)

    stream = changed_logs(spark, home, settle=settle)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
