"""The daily view kept up by what changed.

A source event adds its counters to one day, project, device and model. Where it changes (a later revision, a void, a
new assignment or alias), it takes back what it added and adds what it is now: signed rows, summed by day, that are
merged into the days that they touch. No other day is read or written, and no event that did not change.

state: one row for each source event that counts now: source_event_id, thread_key, turn_key, own_project_id (before
aliases), the dimensions and the counters. A sum over unknown counters only is null, so the known ones are counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import COUNTERS
from ..work import Scratch

DAY = "utc_date"
DIMENSIONS = (DAY, "effective_project_id", "device_id", "model")
SUMS = tuple(c for c in COUNTERS if c != "cache_write_input_tokens")


class Shape(NamedTuple):
    """What a view groups by (a day first) and adds up."""

    dimensions: tuple[str, ...] = DIMENSIONS
    counters: tuple[str, ...] = SUMS

    @property
    def sums(self) -> list[str]:
        return [*self.counters, *[f"known_{c}" for c in self.counters], "event_count"]


def affected(state: DataFrame, events: DataFrame | None = None, *, turns: DataFrame | None = None, threads: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """(source_event_id) of what may count otherwise: events(source_event_id) that are new in the ledger, and what the state holds under
    turns(turn_key), threads(thread_key) and projects(project_id) whose assignment or alias changed."""
    found = [] if events is None else [events.select("source_event_id")]
    for subjects, column, name in ((turns, "turn_key", "turn_key"), (threads, "thread_key", "thread_key"), (projects, "own_project_id", "project_id")):
        if subjects is not None:
            found.append(state.join(subjects.select(F.col(name).alias(column)).distinct(), column, "left_semi").select("source_event_id"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def changed_aliases(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id) of sources whose target is another one now; both: source, target."""
    old, new = before.select("source", F.col("target").alias("was")), after.select("source", "target")
    return old.join(new, "source", "full").where(~F.col("was").eqNullSafe(F.col("target"))).select(F.col("source").alias("project_id"))


def _signed(rows: DataFrame, sign: int, shape: Shape) -> DataFrame:
    sums = [(F.coalesce(c, F.lit(0)) * sign).cast("long").alias(c) for c in shape.counters]
    known = [(F.col(c).isNotNull().cast("long") * sign).alias(f"known_{c}") for c in shape.counters]
    return rows.select(*shape.dimensions, *sums, *known, F.lit(sign).cast("long").alias("event_count"))


def day_changes(before: DataFrame, after: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008  a constant
    """Signed sums by the dimensions, from state rows before and after; groups that stay as they were are left out."""
    rows = _signed(before, -1, shape).unionByName(_signed(after, 1, shape))
    out = rows.groupBy(*shape.dimensions).agg(*[F.sum(c).alias(c) for c in shape.sums])
    return out.where(" or ".join(f"{c} <> 0" for c in shape.sums))


def next_state(state: DataFrame, keys: DataFrame, after: DataFrame) -> DataFrame:
    return state.join(keys, "source_event_id", "left_anti").unionByName(after.select(*state.columns))


def merged(daily: DataFrame, changes: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    columns = [*shape.dimensions, *shape.sums]
    return daily.select(*columns).unionByName(changes.select(*columns)).groupBy(*shape.dimensions).agg(*[F.sum(c).alias(c) for c in shape.sums])


def shown(daily: DataFrame, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """The view of a reader: groups with events, null for sums of which no part is known."""
    return daily.where("event_count > 0").select(*shape.dimensions, *[F.when(F.col(f"known_{c}") > 0, F.col(c)).alias(c) for c in shape.counters], "event_count")


def rewrite_days(spark: SparkSession, path: str, changes: DataFrame, batch: int, work: Scratch, shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """Merge the changes of a batch into the stored view, a partition for each day; returns (utc_date) of the rewritten days.

    A day keeps the number of the last batch that changed it, so a batch that is run again, after it stopped between two days,
    changes only the days that it had not reached. Groups that are empty now stay, with no events."""
    changes = work.save(changes, f"changes-{batch}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
    days = work.save(changes.select(DAY).distinct(), f"days-{batch}")
    if there:
        stored = spark.read.parquet(path).withColumn(DAY, F.col(DAY).cast(changes.schema[DAY].dataType))
        mine = stored.join(days, DAY, "left_semi")
        days = work.save(days.join(mine.where(F.col("batch") >= batch).select(DAY).distinct(), DAY, "left_anti"), f"open-{batch}")
        changes, mine = changes.join(days, DAY, "left_semi"), mine.join(days, DAY, "left_semi")
        rows = merged(mine, changes, shape)
    else:
        rows = changes.select(*shape.dimensions, *shape.sums)
    rows = work.save(rows.withColumn("batch", F.lit(batch).cast("long")), f"merged-{batch}")
    rows.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    return days
