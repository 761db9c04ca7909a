"""The ledger: JSON lines below devices/<uuid>/, read with a closed schema, appended without ever rewriting.

Reading keeps the text of each line, so that schema and privacy rules see what was written. A torn last line is
reported, not read. Appends leave out events that are there and refuse events that are there with other content.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json, is_uuid, utc_instant
from ..operators.replay import payload_conflicts, require_empty
from ..operators.validate import privacy_violations, schema_violations
from ..schemas import EVENT, EVENT_FIELDS
from ..work import Scratch


def relative_path(device: Column, kind: Column, occurred_at: Column) -> Column:
    """devices/<uuid>/usage/2026/08/25.jsonl, .../mappings/2026/08.jsonl, .../quota/2026/08/25.jsonl; null for all else."""
    ts = utc_instant(occurred_at)
    day, month = F.date_format(ts, "yyyy/MM/dd"), F.date_format(ts, "yyyy/MM")
    tail = F.when(kind == "usage_checkpoint", F.concat(F.lit("usage/"), day)).when(kind == "mapping", F.concat(F.lit("mappings/"), month)).when(kind == "quota_snapshot", F.concat(F.lit("quota/"), day))
    return F.when(is_uuid(device), F.concat(F.lit("devices/"), device, F.lit("/"), tail, F.lit(".jsonl")))


def files(spark: SparkSession, root: str) -> DataFrame:
    """(file, place, text) of all ledger files; place is relative to the root. Appends lie in
    folders devices/place=<place>, of which a task writes as many as it has events for."""
    rows = spark.read.text(f"{root.rstrip('/')}/devices", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{jsonl,txt}")
    path = F.col("_metadata.file_path")
    folder = F.regexp_replace(F.regexp_extract(path, r"(devices/[^/]+/.*)$", 1), r"/part-[^/]*$", "")
    # the folder's name is encoded by the partitioned write, and once more in the path
    place = F.when(F.startswith(folder, F.lit("devices/place=")), F.url_decode(F.url_decode(F.substring(folder, 15, 10_000)))).otherwise(folder)
    return rows.select(path.alias("file"), place.alias("place"), F.col("value").alias("text"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """files, or none where nothing was ever appended."""
    try:
        return files(spark, root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, place string, text string")


def read_lines(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete lines: file, place, line_no, value; files with a torn last line)."""
    whole = F.when(F.contains("text", F.lit("\n")), F.regexp_replace("text", r"\n[^\n]*\z", ""))
    lines = found.select("file", "place", F.posexplode(F.split(whole, "\n")).alias("at", "value")).select("file", "place", (F.col("at") + 1).alias("line_no"), "value")
    return lines, found.where((F.col("text") != "") & ~F.endswith("text", F.lit("\n"))).select("file")


def line_violations(lines: DataFrame) -> DataFrame:
    """(file, line_no, codes): schema, privacy and place."""
    rows = privacy_violations(schema_violations(lines))
    doc = F.try_parse_json("value")
    get = lambda f: F.try_variant_get(doc, f"$.{f}", "string")
    misplaced = F.when(~relative_path(get("device_id"), get("event_type"), get("occurred_at")).eqNullSafe(F.col("place")), F.array(F.lit("place"))).otherwise(F.array().cast("array<string>"))
    codes = F.concat("violations", F.when(F.array_contains("violations", "json"), F.array().cast("array<string>")).otherwise(F.concat("privacy", misplaced)))
    return rows.select("file", "line_no", codes.alias("codes")).where(F.size("codes") > 0)


def to_events(lines: DataFrame) -> DataFrame:
    """Typed events with payload_json, the canonical text of the fields of their type."""
    rows = lines.select("*", F.from_json("value", EVENT).alias("e")).select(*[c for c in lines.columns if c != "value"], "e.*")
    payload = F.when(F.lit(False), F.lit(""))
    for kind, names in EVENT_FIELDS.items():
        payload = payload.when(F.col("event_type") == kind, canonical_json(*names))
    return rows.withColumn("payload_json", payload)


def read_ledger(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(events of all devices, files with a torn last line). Any bad complete line is an error."""
    lines, torn = read_lines(stored_files(spark, root))
    require_empty(line_violations(lines), "ledger lines")
    return to_events(lines), torn


def append_events(spark: SparkSession, root: str, events: DataFrame, *, device_id: str, key_id: str) -> int:
    """Append new events (columns of schemas.EVENT) under their paths; gives their number.

    Events of other devices or keys, and ids that are there with other content, are refused before any write.
    """
    require_empty(events.where((F.col("device_id") != device_id) | (F.col("key_id") != key_id)).select("event_id"), "events of another device or key")
    rows = events
    payload = F.when(F.lit(False), F.lit(""))
    for kind, names in EVENT_FIELDS.items():
        payload = payload.when(F.col("event_type") == kind, canonical_json(*names))
    rows = rows.withColumn("payload_json", payload).withColumn("place", relative_path(F.col("device_id"), F.col("event_type"), F.col("occurred_at")))
    require_empty(rows.where("place is null").select("event_id"), "events without a path")
    there = to_events(read_lines(stored_files(spark, root))[0]).select("event_id", "payload_json")
    require_empty(payload_conflicts(there.unionByName(rows.select("event_id", "payload_json"))), "an event_id is there with other content")
    # a written table, since a cached plan that reads the ledger is computed anew once the ledger was written
    new = Scratch(spark).save(rows.dropDuplicates(["event_id"]).join(there.select("event_id"), "event_id", "left_anti").select("place", "payload_json"), "append")
    new.select("place", F.col("payload_json").alias("value")).write.mode("append").partitionBy("place").text(f"{root.rstrip('/')}/devices")
    return new.count()
