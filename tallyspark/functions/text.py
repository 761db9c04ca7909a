"""Scalar text and time functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x1f\x7f]"
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"


def short_identifier(value: Column) -> Column:
    """`prj_h1_abcdefghij` -> `prj_abcdefgh…`; other values over 12 characters keep 8."""
    marked = F.concat(F.substring_index(value, "_h1_", 1), F.lit("_"), F.substring(F.regexp_extract(value, "^.*?_h1_((?s:.*))$", 1), 1, 8), F.lit("…"))
    return F.when(F.contains(value, F.lit("_h1_")), marked).when(F.length(value) > 12, F.concat(F.substring(value, 1, 8), F.lit("…"))).otherwise(value)


def single_line(value: Column) -> Column:
    return F.regexp_replace(value, CONTROL, " ")


def utc_instant(value: Column) -> Column:
    """Timestamp of an ISO text that ends in Z or +00:00; null for all else (also for times without a zone)."""
    return F.when(value.rlike(ISO + r"(Z|[+]00:00)$"), F.try_to_timestamp(value))


def any_instant(value: Column) -> Column:
    """Timestamp of an ISO text with any offset; null without one."""
    return F.when(value.rlike(ISO + r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(value))


def zone_date(utc: Column, zone: str) -> Column:
    """Local date of a UTC timestamp without zone, as yyyy-MM-dd."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc), "yyyy-MM-dd")


def is_uuid(value: Column) -> Column:
    return value.rlike(UUID)


def safe_relative(path: Column) -> Column:
    """Relative POSIX path without empty, `.` or `..` parts, drive letters or backslashes."""
    return (F.length(path) > 0) & ~path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)(\.{1,2})?(/|$)") & ~path.rlike(CONTROL)


def canonical_json(*names: str, at: str = "") -> Column:
    """JSON with sorted keys, no spaces and explicit nulls. Values must be flat or sorted structs themselves."""
    return F.to_json(F.struct(*[F.col(f"{at}{n}").alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def logical_key(turn: Column, ordinal: Column, thread: Column, record: Column) -> Column:
    """('turn', turn, ordinal), else ('record', thread, record)."""
    return F.when(turn.isNotNull(), F.struct(F.lit("turn").alias("kind"), turn.alias("id"), ordinal.cast("long").alias("n"))).otherwise(F.struct(F.lit("record").alias("kind"), thread.alias("id"), record.cast("long").alias("n")))
