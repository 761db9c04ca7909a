"""From cumulative counters to deltas, and the removal of history that forks copied.

Checkpoints have: file, record_index, thread_id, turn_id, ordinal, operation, model, reasoning_effort, occurred_at,
cumulative and reported_last (structs of the six counters), and for forks: forked_from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import logical_key
from ..schemas import COUNTERS
from ..work import Scratch
from .graph import cycle_nodes, terminals
from .scan import Running, scan, split_of


def consistent(counts: Column) -> Column:
    """input + output = total; null if one is unknown."""
    return counts["input_tokens"] + counts["output_tokens"] == counts["total_tokens"]


def calculate_deltas(checkpoints: DataFrame, seeds: DataFrame | None = None, split_rows: int | None = None) -> DataFrame:
    """Adds delta (null struct where the total fell) and flags (sorted). Files are read by record_index.

    seeds(file, seed): counters that precede the first record of a file. split_rows: a task holds so many record
    numbers of a file at most, and checkpoints (a saved table) is read twice; without it, a file is one task's.
    """
    if split_rows is None:
        rows = checkpoints.withColumn("previous", F.lag("cumulative").over(Window.partitionBy("file").orderBy("record_index")))
    else:
        numbered = checkpoints.withColumn("split__", split_of(F.col("record_index"), split_rows))
        rows = scan(numbered, {"previous": Running("last", F.col("cumulative"), before=True)}, key=["file"], split="split__", order="record_index").drop("split__")
    if seeds is not None:
        rows = rows.join(seeds.select("file", "seed"), "file", "left").withColumn("previous", F.coalesce("previous", "seed")).drop("seed")
    return deltas_of(rows).drop("previous")


def deltas_of(rows: DataFrame) -> DataFrame:
    """rows with cumulative, reported_last, operation, turn_id and previous (the counters before, null at first): adds delta
    and flags. Streams have it too."""
    c, p = F.col("cumulative"), F.col("previous")
    fell = F.coalesce(c["total_tokens"] < p["total_tokens"], F.lit(False))
    each = {k: F.when(p.isNull(), c[k]).when(c[k] >= p[k], c[k] - p[k]) for k in COUNTERS}
    rows = rows.withColumn("delta", F.when(~fell, F.struct(*[v.alias(k) for k, v in each.items()])))
    d, last = F.col("delta"), F.col("reported_last")
    excluded = (F.col("operation") == "compact") & (d["total_tokens"] == 0) & (last["total_tokens"] > 0)
    mismatch = (F.col("operation") != "compact") & (d["total_tokens"] > 0) & (last["total_tokens"] != d["total_tokens"])
    flags = [
        F.when(F.col("turn_id").isNull(), F.lit("weak_dedupe_key")),
        F.when(~consistent(c), F.lit("token_total_mismatch")),
        F.when(fell, F.lit("counter_regression")),
        *[F.when(~fell & (c[k] < p[k]), F.lit(f"component_regression:{k}")) for k in COUNTERS],
        F.when(~consistent(d), F.lit("delta_total_mismatch")),
        F.when(excluded, F.lit("compact_reported_last_excluded")),
        F.when(mismatch, F.lit("reported_last_mismatch")),
    ]
    return rows.withColumn("flags", F.array_sort(F.array_compact(F.array(*flags))))


def fork_depths(threads: DataFrame, work: Scratch) -> DataFrame:
    """threads(thread_id, forked_from) -> thread_id, fork_depth: forked-from ancestors that occur in the batch."""
    known = threads.select("thread_id", "forked_from").dropDuplicates(["thread_id"])
    edges = known.where("forked_from is not null").join(known.select(F.col("thread_id").alias("forked_from")), "forked_from", "left_semi").select(F.col("thread_id").alias("src"), F.col("forked_from").alias("dst"))
    edges = work.save(edges, "fork-edges")
    if not cycle_nodes(edges, work, "fork-cycles").isEmpty():
        raise ValueError("threads fork from each other in a cycle")
    depth = terminals(edges, work, "fork-depths").select(F.col("node").alias("thread_id"), F.col("depth").alias("fork_depth"))
    return known.select("thread_id").join(depth, "thread_id", "left").select("thread_id", F.coalesce("fork_depth", F.lit(0)).cast("int").alias("fork_depth"))


def keyed(events: DataFrame) -> DataFrame:
    semantic = F.struct("turn_id", "ordinal", "operation", "cumulative", "reported_last", "delta", F.filter("flags", lambda f: ~f.startswith("metadata_conflict:")).alias("flags"))
    return events.withColumn("logical_key", logical_key(F.col("turn_id"), F.col("ordinal"), F.col("thread_id"), F.col("record_index"))).withColumn("semantic", F.to_json(semantic, {"ignoreNullFields": "false"}))


def fork_conflicts(events: DataFrame) -> DataFrame:
    """Logical keys under which events differ in more than metadata."""
    return keyed(events).groupBy("logical_key").agg(F.count_distinct("semantic").alias("versions")).where("versions > 1")


def deduplicate_events(events: DataFrame, depths: DataFrame) -> DataFrame:
    """One event for each logical key: that of least (fork depth, thread id), then of the first file. Model and
    effort are those that all copies agree on (nulls aside), else null with a metadata_conflict flag."""
    rows = keyed(events).join(depths, "thread_id", "left")
    best = F.struct(F.coalesce("fork_depth", F.lit(0)).alias("fork_depth"), "thread_id", "file", "record_index")
    names = [c for c in events.columns if c not in ("model", "reasoning_effort", "flags")]
    merged = rows.groupBy("logical_key").agg(
        F.min_by(F.struct(*names), best).alias("row"),
        *[F.array_sort(F.collect_set(c)).alias(f"all_{c}") for c in ("model", "reasoning_effort")],
        F.array_distinct(F.flatten(F.collect_set("flags"))).alias("all_flags"),
    )
    one = lambda c: F.when(F.size(f"all_{c}") == 1, F.get(f"all_{c}", F.lit(0)))
    seen = lambda c, f: F.exists("all_flags", lambda x: x == f"metadata_conflict:{f}") | (F.size(f"all_{c}") > 1)
    flags = F.array_sort(F.array_distinct(F.concat("all_flags", F.array_compact(F.array(F.when(seen("model", "model"), F.lit("metadata_conflict:model")), F.when(seen("reasoning_effort", "effort"), F.lit("metadata_conflict:effort")))))))
    kept = lambda c, f: F.when(~F.exists("all_flags", lambda x: x == f"metadata_conflict:{f}"), one(c))  # noqa: E731  a conflict stays one
    return merged.select("row.*", kept("model", "model").alias("model"), kept("reasoning_effort", "effort").alias("reasoning_effort"), flags.alias("flags"), "logical_key")


def event_order(events: DataFrame) -> DataFrame:
    """Deduplicated events by time, then logical key and thread."""
    return events.orderBy("occurred_at", "logical_key.kind", "logical_key.id", "logical_key.n", "thread_id")
