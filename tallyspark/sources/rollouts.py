"""Session logs ("rollouts"): discovery, changed files, and the record parser as window expressions.

A log is JSON lines. What a record means depends on the records before it (current turn, operation, model), so
the parser carries values forward, over splits of a log (see operators/scan), so that a log of any length is many
tasks; there is no per-row Python but for the recursive search of tool inputs for working directories.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import any_instant
from ..operators.scan import SPLIT_ROWS, Running, scan, split_of
from ..schemas import COUNTERS
from ..work import Scratch

# Fixed values of the log format.
FOLDERS = ("sessions", "archived_sessions")
PLAIN_SOURCES = ("cli", "vscode", "exec", "appServer")
SUBAGENTS = {"thread_spawn": "subAgentThreadSpawn", "review": "subAgentReview", "compact": "subAgentCompact", "other": "subAgentOther"}
COMMANDS = ("commandExecution", "command_execution")
JS_WORKDIR = re.compile(r'^[ \t]*(?:workdir|cwd)[ \t]*:[ \t]*("(?:\\.|[^"\\])*")', re.MULTILINE)


class Parsed(NamedTuple):
    metadata: DataFrame
    checkpoints: DataFrame
    issues: DataFrame
    fatal: DataFrame


def folders(spark: SparkSession, home: str) -> list[tuple[int, str]]:
    out = []
    for priority, folder in enumerate(FOLDERS):
        path = f"{home.rstrip('/')}/{folder}"
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        if files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files):
            out.append((priority, path))
    return out


def discover(spark: SparkSession, home: str) -> DataFrame:
    """All logs below home: file, source_id, priority (0 active, 1 archived), size, modified. No text is read: of binary
    files only what the listing knows is asked for."""
    out = spark.createDataFrame([], "file string, priority int, size long, modified timestamp")
    for priority, path in folders(spark, home):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(path)
        out = out.unionByName(rows.select(F.col("_metadata.file_path").alias("file"), F.lit(priority).alias("priority"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    return out.withColumn("source_id", F.sha2("file", 256))


def changed(files: DataFrame, cursors: DataFrame) -> DataFrame:
    """Files whose size or time differs from the cursor: cursors(source_id, size, modified)."""
    return files.join(cursors.select("source_id", "size", "modified"), ["source_id", "size", "modified"], "left_anti")


def read_lines(spark: SparkSession, *paths: str, work: Scratch, pattern: str = "*.jsonl") -> DataFrame:
    """(file, record_index from 1, line) of the files below the paths, up to the last line feed; a torn last line waits for
    the next read.

    A file of any size is read by as many tasks as it has blocks. A task numbers the lines of a block as it reads
    them; the numbers of lines of the blocks before come from one small table. Whether the last line is whole follows
    from the bytes of all lines and the size of the file (a byte-order mark, which the reader drops, has three).
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(list(paths))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    rows = work.save(rows, "lines")
    blocks = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"))
    before = Window.partitionBy("file").orderBy("block")
    whole = Window.partitionBy("file")
    over = F.sum("bytes").over(whole) - F.col("size")
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.sum("n").over(whole) - F.when((over > 0) | (over == -2), 1).otherwise(0)).alias("last"))
    found = rows.join(blocks, ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("record_index"), "line", "last")
    return found.where(F.col("record_index") <= F.col("last")).drop("last")


def text_at(doc: Column, path: str) -> Column:
    """A non-empty JSON string, else null."""
    value = F.variant_get(doc, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(doc, path, "string"), F.lit("")))


def kind_at(doc: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(doc, path, "variant"))


def is_object(doc: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind_at(doc, path), F.lit("OBJECT")), F.lit(False))


def counts_at(doc: Column, path: str) -> Column:
    return F.when(is_object(doc, path), F.struct(*[F.when(kind_at(doc, f"{path}.{c}") == "BIGINT", F.try_variant_get(doc, f"{path}.{c}", "bigint")).alias(c) for c in COUNTERS]))


def bad_counts(doc: Column, path: str) -> Column:
    """A counter that is neither null, absent nor a non-negative integer."""
    wrong = F.lit(False)
    for c in COUNTERS:
        kind = F.coalesce(kind_at(doc, f"{path}.{c}"), F.lit("VOID"))
        wrong = wrong | ~((kind == "VOID") | ((kind == "BIGINT") & (F.try_variant_get(doc, f"{path}.{c}", "bigint") >= 0)))
    return is_object(doc, path) & F.coalesce(wrong, F.lit(True))


def json_workdirs(value) -> Iterator[str]:
    """Strings under the keys workdir and cwd, through objects and lists of objects."""
    todo = [value]
    while todo:
        for key, child in todo.pop().items():
            if key in ("workdir", "cwd") and isinstance(child, str) and child:
                yield child
            elif isinstance(child, dict):
                todo.append(child)
            elif isinstance(child, list):
                todo += [x for x in child if isinstance(x, dict)]


def tool_workdirs(text: str | None) -> list[str]:
    """From a tool input: a JSON object, a JSON string of one, or a script with `workdir: "..."` lines."""
    try:
        value = json.loads(text) if text else None
        if isinstance(value, str):
            text = value
            value = json.loads(value) if value else None
    except ValueError:
        value = None
    if isinstance(value, dict):
        return sorted(set(json_workdirs(value)))
    found = set()
    for literal in JS_WORKDIR.findall(text or ""):
        try:
            found.add(json.loads(literal))
        except ValueError:
            continue
    return sorted(found - {""})


def tool_workdirs_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: tool_workdirs(t) if t is not None else [])


def source_of(doc: Column) -> Column:
    """struct(kind, parent) of a session's source: a plain name, or the first kind of subagent that is there."""
    path = "$.payload.source"
    plain = text_at(doc, path)
    kind, parent = F.lit("subAgent"), F.lit(None).cast("string")
    for raw, name in reversed(SUBAGENTS.items()):
        here = F.coalesce(kind_at(doc, f"{path}.subagent.{raw}"), F.lit("VOID")) != "VOID"
        kind = F.when(here, F.lit(name)).otherwise(kind)
        parent = F.when(here, text_at(doc, f"{path}.subagent.{raw}.parent_thread_id")).otherwise(parent)
    sub = is_object(doc, f"{path}.subagent")
    return F.struct(F.when(plain.isin(*PLAIN_SOURCES), plain).when(sub, kind).otherwise("unknown").alias("kind"), F.when(sub, parent).alias("parent"))


def typed_records(lines: DataFrame, split_rows: int) -> DataFrame:
    """lines(file, record_index, line) as plain columns: all that the parser asks of a record, from one look at its JSON."""
    doc = F.col("doc")
    kind, event = F.col("type"), F.col("event")
    rows = lines.select("file", F.col("record_index").cast("long").alias("record_index"), F.try_parse_json("line").alias("doc"))
    rows = rows.withColumns({"type": text_at(doc, "$.type"), "event": text_at(doc, "$.payload.type")})
    message, item = kind == "event_msg", kind == "response_item"
    effort = F.when(kind_at(doc, "$.payload.effort").isNull(), text_at(doc, "$.payload.reasoning_effort")).otherwise(text_at(doc, "$.payload.effort"))
    info, total, last = "$.payload.info", "$.payload.info.total_token_usage", "$.payload.info.last_token_usage"
    is_count = F.coalesce(message & (event == "token_count"), F.lit(False))
    git = lambda f: text_at(doc, f"$.payload.git.{f}")
    thread = text_at(doc, "$.payload.id")
    fields = {
        "thread_id": thread,
        "root_session_id": F.coalesce(text_at(doc, "$.payload.session_id"), thread),
        "forked_from": text_at(doc, "$.payload.forked_from_id"),
        "source": source_of(doc),
        "cli_version": text_at(doc, "$.payload.cli_version"),
        "cwd": text_at(doc, "$.payload.cwd"),
        "git_repository_url": git("repository_url"),
        "git_branch": git("branch"),
        "git_commit_hash": git("commit_hash"),
    }
    raw = F.when(kind_at(doc, "$.payload.input").isNull(), F.variant_get(doc, "$.payload.arguments", "variant")).otherwise(F.variant_get(doc, "$.payload.input", "variant"))
    ran = message & event.isin("item_started", "item_completed") & text_at(doc, "$.payload.item.type").isin(*COMMANDS)
    no = lambda test: F.coalesce(test, F.lit(False))
    return rows.select(
        "file",
        "record_index",
        split_of(F.col("record_index"), split_rows).alias("split"),
        no(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT"))).alias("is_object"),
        no(kind == "session_meta").alias("is_meta"),
        no(message & (event == "task_started")).alias("started"),
        no(message & (event == "task_complete")).alias("ended"),
        no(kind == "turn_context").alias("is_context"),
        no(kind == "compacted").alias("compacted"),
        F.when(message | (kind == "turn_context"), text_at(doc, "$.payload.turn_id")).alias("own_turn"),
        F.when(kind == "turn_context", F.struct(text_at(doc, "$.payload.model").alias("model"), effort.alias("effort"))).alias("own_context"),
        F.when(kind == "session_meta", F.struct(*[v.alias(k) for k, v in fields.items()])).alias("meta"),
        is_count.alias("is_count"),
        is_object(doc, info).alias("has_info"),
        is_object(doc, total).alias("has_total"),
        F.when(is_count, bad_counts(doc, total) | bad_counts(doc, last)).alias("bad_counts"),
        F.when(is_count, counts_at(doc, total)).alias("cumulative"),
        F.when(is_count, counts_at(doc, last)).alias("reported_last"),
        F.when(is_count, any_instant(text_at(doc, "$.timestamp"))).alias("occurred_ts"),
        F.when(item & event.isin("custom_tool_call", "function_call"), F.to_json(raw)).alias("tool"),
        F.when(item & event.isin(*COMMANDS), text_at(doc, "$.payload.cwd")).when(ran, text_at(doc, "$.payload.item.cwd")).alias("command_dir"),
    )


def with_state(typed: DataFrame, work: Scratch) -> DataFrame:
    """Records with what those before them set: turn_id, segment, context, operation, metas (session_meta records
    before). Two scans, as whether a record starts a segment depends on the turn before it."""
    by = {"key": ["file"], "split": "split", "order": "record_index"}
    none = F.lit(None).cast("string")
    names_turn = F.col("is_context") & F.col("own_turn").isNotNull()
    sets = F.when(F.col("ended"), F.struct(none.alias("id"))).when(F.col("started") | names_turn, F.struct(F.col("own_turn").alias("id")))
    rows = scan(typed, {"was": Running("last", sets, before=True), "now": Running("last", sets)}, **by)
    boundary = F.col("started") | F.col("ended") | (names_turn & ~F.col("own_turn").eqNullSafe(F.col("was.id")))
    rows = work.save(rows.withColumns({"turn_id": F.col("now.id"), "boundary": boundary}).drop("was", "now", "own_turn"), "turns")
    context = F.when(F.col("started") | F.col("ended"), F.struct(none.alias("model"), none.alias("effort"))).otherwise(F.col("own_context"))
    operation = F.when(F.col("boundary") & F.col("ended"), "unknown").when(F.col("boundary"), "turn").when(F.col("compacted"), "compact")
    state = {
        "segment": Running("sum", F.col("boundary").cast("long")),
        "context": Running("last", context),
        "operation": Running("last", operation),
        "metas": Running("sum", F.col("is_meta").cast("long"), before=True),
    }
    rows = scan(rows, state, **by).withColumn("operation", F.coalesce("operation", F.lit("unknown")))
    return work.save(rows.drop("started", "ended", "is_context", "compacted", "own_context", "boundary"), "state")


def parse_rollouts(lines: DataFrame, work: Scratch | None = None, split_rows: int = SPLIT_ROWS) -> Parsed:
    """lines(file, record_index, line) -> metadata, checkpoints, issues, and (file, record_index, code) of what
    makes a whole file unusable; such files give no rows elsewhere. A task reads split_rows records of a log at most."""
    work = work or Scratch(lines.sparkSession)
    rows = with_state(work.save(typed_records(lines, split_rows), "typed"), work)
    is_count, has_meta = F.col("is_count"), F.col("is_meta") | (F.col("metas") > 0)
    emitted = is_count & F.col("has_info") & F.col("has_total")
    fatal = (
        F.when(~F.col("is_object"), "record")
        .when(F.col("is_meta") & (F.col("metas") == 0) & F.col("meta.thread_id").isNull(), "session_meta")
        .when(is_count & ~has_meta, "token_count_before_session_meta")
        .when(emitted & F.col("bad_counts"), "counter")
        .when(emitted & F.col("cumulative.total_tokens").isNull(), "total_missing")
        .when(emitted & F.col("occurred_ts").isNull(), "timestamp")
    )
    issue = F.when(is_count & ~F.col("has_info"), "token_count_without_info").when(is_count & ~F.col("has_total"), "token_count_without_total_usage").when(emitted & F.col("turn_id").isNull(), "token_count_without_turn")
    broken = rows.select("file", "record_index", fatal.alias("code")).where("code is not null")
    bare = rows.groupBy("file").agg(F.max("is_meta").alias("m")).where("not m").select("file", F.lit(1).cast("long").alias("record_index"), F.lit("no_session_meta").alias("code"))
    broken = work.save(broken.unionByName(bare), "broken")
    good = rows.join(broken.select("file").distinct(), "file", "left_anti")

    metadata = good.where("is_meta").groupBy("file").agg(F.min_by("meta", "record_index").alias("m")).select("file", "m.*")
    metadata = metadata.withColumns({"source_kind": F.col("source.kind"), "source_parent_thread_id": F.col("source.parent")}).drop("source")

    # working directories of the whole turn
    told = good.where("turn_id is not null and (tool is not null or command_dir is not null)").select("file", "turn_id", "tool", "command_dir")
    found = told.select("file", "turn_id", F.explode(F.concat(F.pandas_udf(tool_workdirs_of, "array<string>")("tool"), F.array_compact(F.array("command_dir")))).alias("workdir"))
    workdirs = found.groupBy("file", "turn_id").agg(F.array_sort(F.collect_set("workdir")).alias("activity_workdirs"))

    counted = scan(good.where(emitted), {"nth": Running("sum", F.lit(1).cast("long"))}, key=["file", "segment"], split="split", order="record_index")
    ordinal = F.when(F.col("turn_id").isNull(), F.lit(0)).otherwise((F.col("nth") - 1).cast("int"))
    counted = counted.select("file", "record_index", "turn_id", ordinal.alias("ordinal"), "operation", F.col("context.model").alias("model"), F.col("context.effort").alias("reasoning_effort"), "occurred_ts", "cumulative", "reported_last")
    counted = counted.join(metadata.select("file", "thread_id", "forked_from"), "file").join(workdirs, ["file", "turn_id"], "left").withColumn("activity_workdirs", F.coalesce("activity_workdirs", F.array().cast("array<string>")))
    issues = good.select("file", "record_index", issue.alias("code")).where("code is not null")
    return Parsed(metadata, counted, issues, broken)


def early_metadata(lines: DataFrame, most_lines: int = 256, most_chars: int = 1 << 20) -> DataFrame:
    """First session_meta among the first lines, lines of unusual length left out: (file, doc)."""
    rows = lines.where((F.col("record_index") <= most_lines) & (F.length("line") <= most_chars)).withColumn("doc", F.try_parse_json("line"))
    return rows.where(text_at(F.col("doc"), "$.type") == "session_meta").groupBy("file").agg(F.min_by("line", "record_index").alias("line"))
