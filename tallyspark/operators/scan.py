"""Running values over sequences too long for one task.

A sequence (the rows of a key, in an order) is cut into splits: ranges of that order. A running value is a function of
a state that every split turns into another one, and these functions compose: the last value that is there, the
sum, the greatest so far. So each split gives one summary, the summaries of a sequence are scanned in order, and every split
starts from what came before it. A task holds one split at a time; one sequence's summaries are as many as its splits.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a split where rows are numbered.
SPLIT_ROWS = 1 << 16


class Running(NamedTuple):
    """kind: `last` (nulls are passed over), `sum` (0 at first) or `max`. before: without the row itself."""

    kind: str
    value: Column
    before: bool = False


def split_of(record_index: Column, rows: int = SPLIT_ROWS) -> Column:
    return F.floor((record_index - 1) / rows).cast("long")


def _over(kind: str, value: Column, window) -> Column:
    return {"last": lambda: F.last(value, ignorenulls=True), "sum": lambda: F.sum(value), "max": lambda: F.max(value)}[kind]().over(window)


def scan(rows: DataFrame, running: dict[str, Running], *, key: list[str], split: str, order: str) -> DataFrame:
    """rows with the running values added. rows are read twice: a saved table, or little work on one.

    split: ranges of order within a key, ascending with it; (key, split, order) names a row; none of them is null.
    """
    local = Window.partitionBy(*key, split).orderBy(order)
    across = Window.partitionBy(*key).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    whole = []
    for name, r in running.items():
        if r.kind == "last":
            whole.append(F.max_by(r.value, F.when(r.value.isNotNull(), F.col(order))).alias(f"{name}__split"))
        else:
            whole.append((F.sum if r.kind == "sum" else F.max)(r.value).alias(f"{name}__split"))
    summary = rows.groupBy(*key, split).agg(*whole)
    starts = summary.select(*key, split, *[_over(r.kind, F.col(f"{name}__split"), across).alias(f"{name}__start") for name, r in running.items()])
    out = rows.join(starts, [*key, split], "left")
    values = {}
    for name, r in running.items():
        here = _over(r.kind, r.value, local.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0))
        start = F.col(f"{name}__start")
        if r.kind == "last":
            values[name] = F.coalesce(here, start)
        elif r.kind == "sum":
            values[name] = F.coalesce(here, F.lit(0)) + F.coalesce(start, F.lit(0))
        else:
            values[name] = F.greatest(here, start)
    return out.withColumns(values).drop(*[f"{name}__start" for name in running])


def in_order(rows: DataFrame, *order: str, split: str = "split", place: str = "place") -> DataFrame:
    """rows cut into ranges of the order: split (the range) and place (the order within all rows, with gaps). To be saved
    before it is used: both depend on where the ranges were cut. A hot value of the first columns is cut by the others."""
    return rows.orderBy(*order).select("*", F.spark_partition_id().cast("long").alias(split), F.monotonically_increasing_id().alias(place))
