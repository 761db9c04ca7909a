import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.jsonschema import SchemaError, compile_schema, violations_of
from tallyspark.operators.validate import schema_violations
from tallyspark.schemas import COUNTERS
from tallyspark.work import spread

SCHEMA = {
    "oneOf": [{"$ref": "#/$defs/shop"}, {"$ref": "#/$defs/visit"}],
    "$defs": {
        "name": {"type": "string", "minLength": 2, "maxLength": 5},
        "item": {"type": "object", "additionalProperties": False, "required": ["price"], "properties": {"price": {"type": ["number", "null"], "minimum": 0, "maximum": 9.5}, "tags": {"type": "array", "items": {"$ref": "#/$defs/name"}, "uniqueItems": True, "minItems": 1, "maxItems": 3}}},
        "shop": {"type": "object", "additionalProperties": False, "required": ["kind", "name"], "properties": {"kind": {"const": "shop"}, "name": {"$ref": "#/$defs/name"}, "best": {"oneOf": [{"$ref": "#/$defs/item"}, {"type": "null"}]}, "all": {"type": "array", "items": {"$ref": "#/$defs/item"}}, "open": {"enum": [True, "maybe", 3, None]}}},
        "visit": {"type": "object", "required": ["kind", "at"], "properties": {"kind": {"const": "visit"}, "at": {"type": "string", "format": "date-time"}, "by": {"type": "string", "format": "uuid"}, "code": {"type": "string", "pattern": "^[a-c]+$"}, "n": {"type": "integer"}}},
    },
}
MOMENT = re.compile(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)")


def plain(value, schema, path=""):
    """Codes of a value by recursion over the schema."""
    while "$ref" in schema:
        schema = SCHEMA["$defs"][schema["$ref"].rsplit("/", 1)[1]]
    if "oneOf" in schema:
        return set() if value is None else plain(value, schema["oneOf"][0], path)
    kind = {type(None): "null", bool: "boolean", int: "integer", float: "number", str: "string", list: "array", dict: "object"}[type(value)]
    types = schema.get("type", [kind])
    types = [types] if isinstance(types, str) else types
    same = lambda a, b: type(a) is type(b) and a == b
    bad = kind not in types and not (kind == "integer" and "number" in types)
    bad |= "const" in schema and not same(value, schema["const"])
    bad |= "enum" in schema and not any(same(value, v) for v in schema["enum"])
    out = set()
    if kind in ("integer", "number"):
        bad |= value < schema.get("minimum", value) or value > schema.get("maximum", value)
    elif kind == "string":
        bad |= not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", 10**9)
        bad |= "pattern" in schema and not re.search(schema["pattern"], value)
        bad |= schema.get("format") == "uuid" and not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", value)
        bad |= schema.get("format") == "date-time" and not MOMENT.fullmatch(value)
    elif kind == "array":
        bad |= not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", 10**9)
        bad |= schema.get("uniqueItems", False) and len({json.dumps(v) for v in value}) < len(value)
        for v in value:
            out |= plain(v, schema.get("items", {}), f"{path}[]")
    elif kind == "object":
        at = f"{path}." if path else ""
        known = schema.get("properties", {})
        out |= {f"missing:{at}{k}" for k in schema.get("required", []) if k not in value}
        for k, v in value.items():
            if k in known:
                out |= plain(v, known[k], at + k)
            elif schema.get("additionalProperties") is False:
                out.add(f"unexpected:{at}{k}")
    return out | ({path} if bad else set())


def made(r):
    """A document of one of the kinds with random faults, at any depth."""
    name = lambda: r.choice(["ab", "abcde", "a", "abcdef", 7, None, "é\"\\"])

    def item():
        out = {"price": r.choice([0, 9.5, 3.25, None, -1, 10, "3", True]), "tags": [name() for _ in range(r.randrange(5))], "odd": 1}
        return {k: v for k, v in out.items() if r.random() < {"odd": 0.2}.get(k, 0.85)}

    if r.random() < 0.5:
        out = {"kind": "shop", "name": name(), "best": r.choice([None, item(), [], 4]), "all": r.choice([[item() for _ in range(r.randrange(3))], {}, [1]]), "open": r.choice([True, False, "maybe", 3, 4, None, 3.5]), "more": {"a": 1}}
        keep = {"kind": 1.0, "more": 0.2}
    else:
        out = {"kind": "visit", "at": r.choice(["2026-01-02T03:04:05Z", "2026-01-02T03:04:05.5+09:00", "2026-01-02 03:04:05Z", "yesterday", 5]), "by": r.choice(["11111111-1111-4111-8111-111111111111", "x"]), "code": r.choice(["abc", "xabc", ""]), "n": r.choice([1, -1, 2.5, "1", False]), "free": [[1]]}
        keep = {"kind": 1.0}
    return {k: v for k, v in out.items() if r.random() < keep.get(k, 0.85)}


def codes(spark, texts, how):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    return [r["violations"] for r in how(rows).orderBy("n").collect()]


def test_random_documents_equal_a_recursive_check(spark):
    r, schema = random.Random(3), compile_schema(SCHEMA)
    documents = [made(r) for _ in range(400)]
    got = codes(spark, [json.dumps(d) for d in documents], lambda rows: violations_of(rows, schema))
    want = [sorted(plain(d, SCHEMA["$defs"][d["kind"]])) for d in documents]
    assert got == want
    assert sum(not w for w in want) > 5 and len({c for w in want for c in w}) > 20
    other = codes(spark, ["{", "[1]", "null", '{"kind":"other"}', '{"kind":7}', "{}", ""], lambda rows: violations_of(rows, schema))
    assert other == [["json"], ["json"], ["json"], ["kind"], ["kind"], ["kind"], ["json"]]


@pytest.mark.parametrize(
    ("change", "said"),
    [
        ({"$defs": {"a": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}, "circle"),
        ({"$defs": {"a": {"properties": {"x": {"$ref": "#/$defs/a"}}}}, "$ref": "#/$defs/a"}, "circle"),
        ({"$ref": "#/$defs/none"}, "no such definition"),
        ({"properties": {"x": {"anyOf": []}}}, "not understood at x"),
        ({"properties": {"x": {"oneOf": [{"type": "string"}, {"type": "integer"}]}}}, "not understood at x"),
        ({"properties": {"x": {"format": "email"}}}, "not understood at x"),
        ({"type": "text"}, "no such type"),
        ({"oneOf": [{"type": "object"}, {"type": "array"}, {"type": "string"}]}, "tells the alternatives apart"),
    ],
)
def test_schemas_that_are_not_understood_are_refused(change, said):
    with pytest.raises(SchemaError, match=said):
        compile_schema(change)


def events():
    common = {"schema_version": 1, "device_id": "11111111-1111-4111-8111-111111111111", "key_id": "key_h1_0123456789", "occurred_at": "2026-05-06T07:08:09Z"}
    counts = dict.fromkeys(COUNTERS) | {"total_tokens": 12}
    usage = common | {"event_type": "usage_checkpoint", "event_id": "evt_h1_000000000001", "source_event_id": "src_h1_000000000001", "revision": 1, "supersedes": None, "voided": False, "parser_version": "7", "project_id": None, "project_resolution": "root", "activity_repository_count": 0, "thread_key": "thr_h1_000000000001"}
    usage |= dict.fromkeys(("root_thread_key", "parent_thread_key", "forked_from_thread_key", "turn_key", "model", "reasoning_effort", "cli_version", "delta", "reported_last"))
    usage |= {"token_event_ordinal": 3, "operation": "turn", "source_kind": "cli", "cumulative": counts, "flags": ["a", "b"]}
    mapping = common | {"event_type": "mapping", "event_id": "map_h1_000000000001", "revision": 2, "supersedes": "map_h1_000000000000", "kind": "project_alias", "subject_type": "project", "subject_id": "prj_h1_000000000001", "target_project_id": None, "display_value": None}
    quota = common | {"event_type": "quota_snapshot", "event_id": "quota_h1_00000000001", "scope_key": None, "window_minutes": 5, "used_percent": 99.5, "remaining_percent": 0, "reset_at": None}
    return usage, mapping, quota


def test_ledger_events_and_what_they_may_not_be(spark):
    usage, mapping, quota = events()
    counts = usage["cumulative"]
    cases = [(e, []) for e in (usage, mapping, quota)]
    cases += [
        ({k: v for k, v in usage.items() if k != "voided"}, ["missing:voided"]),
        (usage | {"path": "x"}, ["unexpected:path"]),
        (usage | {"device_id": "none"}, ["device_id"]),
        (usage | {"flags": ["a", "a"]}, ["flags"]),
        (usage | {"flags": ["a", 1]}, ["flags[]"]),
        (usage | {"cumulative": counts | {"output_tokens": -3}}, ["cumulative.output_tokens"]),
        (usage | {"delta": {k: v for k, v in counts.items() if k != "total_tokens"} | {"more": 1}}, ["missing:delta.total_tokens", "unexpected:delta.more"]),
        (usage | {"reported_last": []}, ["reported_last"]),
        (usage | {"schema_version": 2, "operation": "other", "revision": 0}, ["operation", "revision", "schema_version"]),
        (mapping | {"display_value": "x" * 201, "subject_id": "short"}, ["display_value", "subject_id"]),
        (quota | {"used_percent": 100.5, "window_minutes": 0, "reset_at": "soon"}, ["reset_at", "used_percent", "window_minutes"]),
        (quota | {"event_type": "other"}, ["event_type"]),
    ]
    got = codes(spark, [json.dumps(copy.deepcopy(e)) for e, _ in cases], schema_violations)
    assert got == [w for _, w in cases]


def test_rows_are_dealt_out_evenly_whatever_the_splits(spark, tmp_path):
    """A small file of many rows is one row group: its splits are as many as the cores, and all but one are empty."""
    spark.range(0, 3000, 1, 1).write.parquet(f"{tmp_path}/rows")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = spark.read.parquet(f"{tmp_path}/rows")
        assert rows.rdd.getNumPartitions() >= 4
        parts = spread(rows, 500).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(parts) == 6 and max(r["count"] for r in parts) <= 510


def test_keys_with_signs_and_closed_objects_without_properties(spark):
    """A key with a dot is no path; a closed object refuses all keys if it has no property."""
    schema = compile_schema({"type": "object", "properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}}}, "it's \"a\" ?": {"type": "integer"}, "none": {"type": "object", "additionalProperties": False}}})
    texts = [{"a.b": 1}, {"a": {"b": 1}}, {"it's \"a\" ?": "x"}, {"none": {"k": 1}}, {"none": {}, "a": None}]
    got = codes(spark, [json.dumps(t) for t in texts], lambda rows: violations_of(rows, schema))
    assert got == [[], ["a.b"], ["it's \"a\" ?"], ["unexpected:none.k"], ["a"]]


def test_entries_of_a_text_are_not_walked_by_lambdas(spark):
    """Spark interprets lambdas; only unknown keys, items of arrays and a column of a wide projection go through one."""
    plan = schema_violations(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "map_entries" not in plan
