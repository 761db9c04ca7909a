"""Usage reports: filter, group by any of seven dimensions, exact metrics with partial flags, running totals."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_identifier, single_line, zone_date
from ..schemas import COUNTERS

# Fixed values of the report.
DIMENSIONS = ("project", "date", "thread", "model", "effort", "device", "source")
UNCLASSIFIED, UNKNOWN = "미분류", "알 수 없음"
UNCLASSIFIED_FILTERS = ("unclassified", UNCLASSIFIED)


@dataclass(frozen=True)
class ReportQuery:
    group_by: tuple[str, ...] = ("project", "date")
    from_date: dt.date | None = None
    to_date: dt.date | None = None
    project: str | None = None
    model: str | None = None
    device: str | None = None
    source: str | None = None
    timezone: str = "Asia/Seoul"

    def __post_init__(self) -> None:
        if self.from_date and self.to_date and self.from_date > self.to_date:
            raise ValueError("from_date lies after to_date")
        if not self.group_by or len(set(self.group_by)) < len(self.group_by) or not set(self.group_by) <= set(DIMENSIONS):
            raise ValueError(f"group_by: some of {DIMENSIONS}, each once")
        dt.datetime.now(_zone(self.timezone))


def _zone(name: str):
    from zoneinfo import ZoneInfo

    try:
        return ZoneInfo(name)
    except Exception as error:
        raise ValueError(f"unknown time zone {name!r}") from error


def period(name: str, now: dt.datetime, zone: str) -> tuple[dt.date | None, dt.date | None]:
    """Dates of `all`, `today` and `week` (Monday to today) at the instant now."""
    today = now.astimezone(_zone(zone)).date()
    return {"all": (None, None), "today": (today, today), "week": (today - dt.timedelta(days=today.weekday()), today)}[name]


def latest_names(mappings: DataFrame, aliases: DataFrame) -> DataFrame:
    """(kind, subject, name): for each device and alias-resolved project the last name by text of time, then event."""
    rows = mappings.where("kind in ('project_name', 'device_name') and display_value is not null")
    rows = rows.join(aliases.select(F.col("source").alias("subject_id"), "target"), "subject_id", "left")
    subject = F.when(F.col("kind") == "project_name", F.coalesce("target", "subject_id")).otherwise(F.col("subject_id"))
    return rows.groupBy("kind", subject.alias("subject")).agg(single_line(F.max_by("display_value", F.struct("occurred_at", "event_id"))).alias("name"))


def utc_bounds(q: ReportQuery) -> Column | None:
    """A range of instants that holds all of the local dates, for pruning at the scan; days are cut by date later."""
    tests = []
    if q.from_date:
        tests.append(F.col("occurred_ts") >= F.lit(dt.datetime.combine(q.from_date, dt.time()) - dt.timedelta(days=1)).cast("timestamp_ntz"))
    if q.to_date:
        tests.append(F.col("occurred_ts") < F.lit(dt.datetime.combine(q.to_date, dt.time()) + dt.timedelta(days=2)).cast("timestamp_ntz"))
    return None if not tests else tests[0] if len(tests) == 1 else tests[0] & tests[1]


def records(usage: DataFrame, names: DataFrame | None, q: ReportQuery) -> DataFrame:
    """Filtered usage with the raw value and label of each dimension.

    usage: effective_project_id, device_id, thread_key, model, reasoning_effort, source_kind, occurred_ts (UTC, without
    zone), delta_<counter>. names: see latest_names.
    """
    bounds = utc_bounds(q)
    rows = usage if bounds is None else usage.where(bounds)
    rows = rows.withColumn("date", zone_date(F.col("occurred_ts"), q.timezone))
    project, device = short_identifier(F.col("effective_project_id")), short_identifier(F.col("device_id"))
    if names is not None:
        for kind, column in (("project_name", "effective_project_id"), ("device_name", "device_id")):
            own = names.where(F.col("kind") == kind).select(F.col("subject").alias(column), F.col("name").alias(kind))
            rows = rows.join(own, column, "left")
        project, device = F.coalesce("project_name", project), F.coalesce("device_name", device)
    raw = {"project": F.coalesce("effective_project_id", F.lit("")), "date": F.col("date"), "thread": F.col("thread_key"), "model": F.coalesce("model", F.lit("")), "effort": F.coalesce("reasoning_effort", F.lit("")), "device": F.col("device_id"), "source": F.col("source_kind")}
    labels = {"project": F.coalesce(F.nullif(project, F.lit("")), F.lit(UNCLASSIFIED)), "date": F.col("date"), "thread": short_identifier(F.col("thread_key")), "model": F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(UNKNOWN)), "effort": F.coalesce(F.nullif(F.col("reasoning_effort"), F.lit("")), F.lit(UNKNOWN)), "device": device, "source": F.col("source_kind")}
    rows = rows.select(*[v.alias(f"raw_{k}") for k, v in raw.items()], *[v.alias(f"label_{k}") for k, v in labels.items()], *[F.col(f"delta_{c}").alias(c) for c in COUNTERS])
    if q.from_date:
        rows = rows.where(F.col("raw_date") >= q.from_date.isoformat())
    if q.to_date:
        rows = rows.where(F.col("raw_date") <= q.to_date.isoformat())
    if q.project in UNCLASSIFIED_FILTERS:
        rows = rows.where(F.col("raw_project") == "")
    elif q.project is not None:
        rows = rows.where((F.col("raw_project") == q.project) | (F.col("label_project") == q.project))
    if q.model is not None:
        rows = rows.where(F.col("raw_model") == q.model)
    if q.device is not None:
        rows = rows.where((F.col("raw_device") == q.device) | (F.col("label_device") == q.device))
    if q.source is not None:
        rows = rows.where(F.col("raw_source") == q.source)
    return rows


def metrics() -> list[Column]:
    """Sums over events of known total, whether some of them lack the counter, and the counts of both kinds."""
    known = F.col("total_tokens").isNotNull()
    out = []
    for c in COUNTERS:
        value = F.when(known, F.col(c))
        out += [F.sum(value).alias(c), ((F.count(value) > 0) & (F.count(value) < F.count("total_tokens"))).alias(f"{c}_partial")]
    return [*out, F.count("total_tokens").alias("included_events"), (F.count("*") - F.count("total_tokens")).alias("excluded_events")]


def grand_total(rows: DataFrame) -> DataFrame:
    return rows.agg(*metrics())


def usage_report(rows: DataFrame, q: ReportQuery) -> DataFrame:
    """One row per group: raw and label of each dimension, metrics, cumulative_total_tokens (running over dates
    within the other dimensions)."""
    raw = [f"raw_{d}" for d in q.group_by]
    # labels follow from raw values, but for empty and null ones, which share a group
    groups = rows.groupBy(*raw).agg(*[F.max(f"label_{d}").alias(f"label_{d}") for d in q.group_by], *metrics())
    series = [c for c in raw if c != "raw_date"]
    total = F.coalesce("total_tokens", F.lit(0))
    running = F.sum(total).over(Window.partitionBy(*(series or [F.lit(0)])).orderBy("raw_date").rowsBetween(Window.unboundedPreceding, 0)) if "date" in q.group_by else total
    return groups.withColumn("cumulative_total_tokens", running)


def ordered(report: DataFrame, q: ReportQuery) -> DataFrame:
    keys = [F.col(f"raw_{d}") if d == "date" else F.lower(f"raw_{d}") for d in q.group_by]
    return report.orderBy(*keys, *[f"raw_{d}" for d in q.group_by])


def daily_usage_utc(usage: DataFrame) -> DataFrame:
    """Daily sums by UTC day (the text's first 10 characters), project, device and model; unknown totals left out."""
    rows = usage.where("delta_total_tokens is not null")
    sums = [F.sum(f"delta_{c}").alias(c) for c in COUNTERS if c != "cache_write_input_tokens"]
    return rows.groupBy(F.substring("occurred_at", 1, 10).alias("utc_date"), "effective_project_id", "device_id", "model").agg(*sums, F.count("*").alias("event_count"))


def daily_order(daily: DataFrame) -> DataFrame:
    """The daily view by its keys, nulls first."""
    return daily.orderBy("utc_date", "effective_project_id", "device_id", "model")


@dataclass
class Rendered:
    """A report's rows on the driver, for the renderers; reports are as long as their groups."""

    query: ReportQuery
    rows: list = field(default_factory=list)
    total: object = None

    @classmethod
    def of(cls, rows: DataFrame, q: ReportQuery) -> Rendered:
        return cls(q, ordered(usage_report(rows, q), q).collect(), grand_total(rows).first())
