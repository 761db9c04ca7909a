"""Rules of the closed ledger schema and of privacy, as arrays of violation codes.

`schema_violations` works on JSON text, since types must be seen before a cast and unknown keys must be found.
`privacy_violations` scans every string leaf and key at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import is_identifier
from ..functions.text import CONTROL, UUID
from ..schemas import COUNTERS, EVENT_FIELDS, MAPPING_KINDS, OPERATIONS, RESOLUTIONS, SOURCE_KINDS, SUBJECT_TYPES
from .jsonschema import compile_schema, violations_of

# Names that no ledger event may hold, at any depth.
FORBIDDEN_KEYS = (
    "prompt", "prompts", "response", "responses", "message", "messages", "conversation", "code", "command", "command_output", "stdout", "stderr",
    "cwd", "workdir", "path", "source_path", "remote", "remote_url", "repository_url", "git_origin_url", "git_branch", "git_sha", "commit_hash",
)
# Patterns of raw locations.
LOCATIONS = {
    "network_location": r"(?iU)\b(?:https?|ssh|git|file)://|(?:^|\s)[^@\s]+@[^:\s]+:[^\s]+",
    "host_path": r"(?iU)\b[a-z0-9.-]+\.[a-z]{2,}(?::\d+)?/[^\s]+",
    "filesystem_path": r"(?iU)(?:^|[\s'\"(=])(?:[a-z]:[\\/]|\\\\|/[^\s]+|~[/\\]|\.\.?[/\\])",
}
PREFIXES = {
    "usage_checkpoint": {"event_id": "evt_h1_", "source_event_id": "src_h1_", "thread_key": "thr_h1_", "supersedes?": "evt_h1_", "project_id?": "prj_h1_", "root_thread_key?": "thr_h1_", "parent_thread_key?": "thr_h1_", "forked_from_thread_key?": "thr_h1_", "turn_key?": "turn_h1_"},
    "mapping": {"event_id": "map_h1_", "supersedes?": "map_h1_", "target_project_id?": "prj_h1_"},
    "quota_snapshot": {"event_id": "quota_h1_", "scope_key?": "account_h1_"},
}
SUBJECT_PREFIXES = {"project": "prj_h1_", "thread": "thr_h1_", "turn": "turn_h1_", "local_repo": "local_h1_"}

# Rules of each field: kind, and what it takes. A question mark allows null.
_ID = ("id", None)
_ID0 = ("id?", None)
RULES = {
    "usage_checkpoint": {
        "schema_version": ("const", 1), "event_id": _ID, "source_event_id": _ID, "revision": ("int", (1, None)), "supersedes": _ID0, "voided": ("bool", None), "parser_version": ("text", (1, None)), "device_id": ("uuid", None), "key_id": _ID, "project_id": _ID0,
        "project_resolution": ("enum", RESOLUTIONS), "activity_repository_count": ("int", (0, None)), "thread_key": _ID, "root_thread_key": _ID0, "parent_thread_key": _ID0, "forked_from_thread_key": _ID0, "turn_key": _ID0, "token_event_ordinal": ("int", (0, None)),
        "operation": ("enum", OPERATIONS), "occurred_at": ("time", None), "model": ("text?", (0, None)), "reasoning_effort": ("text?", (0, None)), "source_kind": ("enum", SOURCE_KINDS), "cli_version": ("text?", (0, None)), "cumulative": ("counts", None), "delta": ("counts?", None), "reported_last": ("counts?", None), "flags": ("strings", None),
    },
    "mapping": {
        "schema_version": ("const", 1), "event_id": _ID, "revision": ("int", (1, None)), "supersedes": _ID0, "device_id": ("uuid", None), "key_id": _ID, "occurred_at": ("time", None), "kind": ("enum", MAPPING_KINDS), "subject_type": ("enum", SUBJECT_TYPES), "subject_id": _ID, "target_project_id": _ID0, "display_value": ("text?", (0, 200)),
    },
    "quota_snapshot": {
        "schema_version": ("const", 1), "event_id": _ID, "device_id": ("uuid", None), "key_id": _ID, "occurred_at": ("time", None), "scope_key": _ID0, "window_minutes": ("int?", (1, None)), "used_percent": ("num?", (0, 100)), "remaining_percent": ("num?", (0, 100)), "reset_at": ("time?", None),
    },
}


def _as(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def ledger_schema() -> dict:
    """The closed schema of ledger events as a JSON Schema document."""
    nullable = lambda schema: {"oneOf": [schema, {"type": "null"}]}
    count = {"type": ["integer", "null"], "minimum": 0}
    definitions = {
        "id": {"type": "string", "minLength": 8, "maxLength": 256},
        "time": {"type": "string", "format": "date-time"},
        "counts": {"type": "object", "additionalProperties": False, "required": list(COUNTERS), "properties": dict.fromkeys(COUNTERS, count)},
    }
    bounds = {"int": ("integer", "minimum", "maximum"), "num": ("number", "minimum", "maximum"), "text": ("string", "minLength", "maxLength")}

    def field(kind: str, arg) -> dict:
        plain = kind.rstrip("?")
        if plain in definitions:
            out = {"$ref": f"#/$defs/{plain}"}
        elif plain in bounds:
            name, low, high = bounds[plain]
            out = {"type": name} | {k: v for k, v in zip((low, high), arg, strict=True) if v is not None}
        else:
            out = {"const": {"const": arg}, "enum": {"enum": list(arg or ()) if plain == "enum" else None}, "bool": {"type": "boolean"}, "uuid": {"type": "string", "format": "uuid"}, "strings": {"type": "array", "items": {"type": "string"}, "uniqueItems": True}}[plain]
        return nullable(out) if kind.endswith("?") else out

    events = []
    for name, fields in RULES.items():
        properties = {"event_type": {"const": name}} | {f: field(*rule) for f, rule in fields.items()}
        events.append({"type": "object", "additionalProperties": False, "required": list(EVENT_FIELDS[name]), "properties": properties})
    return {"oneOf": events, "$defs": definitions}


LEDGER = compile_schema(ledger_schema())


def schema_violations(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with violations of the ledger's schema: see violations_of; `event_type` where there is no such type."""
    return violations_of(lines, LEDGER, column)


def location_codes(value: Column) -> Column:
    """Codes of what a text gives away. The patterns run only over texts that hold a character they need."""
    has = lambda c: F.contains(value, F.lit(c))
    needs = {"network_location": has("://") | has("@"), "host_path": has("/"), "filesystem_path": has("/") | has("\\")}
    tests = {"control_character": value.rlike(CONTROL)} | {k: needs[k] & value.rlike(p) for k, p in LOCATIONS.items()}
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def json_strings(text: Column) -> Column:
    """All string literals of a JSON text, keys and values, unescaped."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda s: F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>")[0])


def json_keys(text: Column) -> Column:
    """All keys of a JSON text at any depth."""
    return F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1))


def privacy_violations(events: DataFrame, column: str = "value") -> DataFrame:
    """events with privacy: sorted codes `forbidden_key`, `control_character`, location codes and `id:<field>`."""
    text, doc = F.col(column), F.try_parse_json(F.col(column))
    kind = _as(doc, "$.event_type", "string")
    forbidden = F.exists(json_keys(text), lambda k: F.lower(k).isin(*FORBIDDEN_KEYS))
    leaks = F.array_distinct(F.flatten(F.transform(json_strings(text), location_codes)))
    ids = [F.when(~F.coalesce(is_identifier(_as(doc, "$.key_id", "string"), "key_h1_"), F.lit(False)), F.lit("id:key_id"))]
    for name, fields in PREFIXES.items():
        for field, prefix in fields.items():
            value = _as(doc, f"$.{field.rstrip('?')}", "string")
            ids.append(F.when((kind == name) & ~F.coalesce(is_identifier(value, prefix), F.lit(field.endswith("?"))), F.lit(f"id:{field.rstrip('?')}")))
    subject, subject_type = _as(doc, "$.subject_id", "string"), _as(doc, "$.subject_type", "string")
    good = F.when(subject_type == "device", subject.rlike(UUID))
    for s, prefix in SUBJECT_PREFIXES.items():
        good = good.when(subject_type == s, is_identifier(subject, prefix))
    ids.append(F.when((kind == "mapping") & ~F.coalesce(good, F.lit(False)), F.lit("id:subject_id")))
    ids.append(F.when(~F.coalesce(kind.isin(*RULES), F.lit(False)), F.lit("event_type")))
    codes = F.concat(leaks, F.array_compact(F.array(F.when(forbidden, F.lit("forbidden_key")), *ids)))
    return events.withColumn("privacy", F.array_sort(codes))
