import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.identity import derive_one, key_id
from tallyspark.operators.replay import LedgerError, replay
from tallyspark.schemas import EVENT, EVENT_FIELDS
from tallyspark.sources.ledger import append_events, read_ledger, to_events
from tallyspark.sources.readmodel import counts, read, rebuild, state
from tallyspark.work import Scratch

KEY = b"k" * 32
DEVICE = "11111111-1111-4111-8111-111111111111"


def name(kind, x):
    return derive_one(KEY, kind, x)


def usage(i, *, total=10, revision=1, supersedes=None, voided=False, project=None, thread="t", turn=None, source=None, at="2026-08-26T10:00:00Z", device=DEVICE):
    c = {"cached_input_tokens": 1, "cache_write_input_tokens": None, "input_tokens": total - 2, "output_tokens": 2, "reasoning_output_tokens": 1, "total_tokens": total}
    return {
        "schema_version": 1, "event_type": "usage_checkpoint", "event_id": name("usage_event", f"e{i}"), "source_event_id": name("source", source or f"s{i}"), "revision": revision, "supersedes": supersedes and name("usage_event", supersedes), "voided": voided, "parser_version": "1", "device_id": device, "key_id": key_id(KEY),
        "project_id": project and name("project", project), "project_resolution": "self_origin" if project else "unclassified", "activity_repository_count": 0, "thread_key": name("thread", thread), "root_thread_key": None, "parent_thread_key": None, "forked_from_thread_key": None, "turn_key": turn and name("turn", turn),
        "token_event_ordinal": 0, "operation": "turn", "occurred_at": at, "model": "m", "reasoning_effort": None, "source_kind": "cli", "cli_version": "1.0.0", "cumulative": c, "delta": c, "reported_last": None, "flags": [],
    }


def mapping(i, kind, subject_type, subject, target, *, revision=1, supersedes=None, display=None):
    return {"schema_version": 1, "event_type": "mapping", "event_id": name("mapping_event", f"m{i}"), "revision": revision, "supersedes": supersedes and name("mapping_event", supersedes), "device_id": DEVICE, "key_id": key_id(KEY), "occurred_at": "2026-08-26T11:00:00Z", "kind": kind, "subject_type": subject_type, "subject_id": name(subject_type, subject), "target_project_id": target and name("project", target), "display_value": display}


def events(spark, rows):
    import json

    return to_events(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))


def effective(spark, rows):
    projects = {name("project", p): p for p in "abcdefxyz"}
    done = replay(events(spark, rows), Scratch(spark))
    return {r["event_id"]: projects.get(r["effective_project_id"]) for r in done.usage.collect()}


def test_latest_revision_and_void(spark):
    rows = [usage(1, source="s", project="a"), usage(2, source="s", revision=2, supersedes="e1", project="b"), usage(3), usage(4, source="v"), usage(5, source="v", revision=2, supersedes="e4", voided=True)]
    assert effective(spark, rows) == {name("usage_event", "e2"): "b", name("usage_event", "e3"): None}


def test_turn_beats_thread_and_aliases_chain(spark):
    rows = [usage(1, thread="t", turn="u", project="a"), usage(2, thread="t", turn="v", project="a"), usage(3, thread="o", project="a"), mapping(1, "manual_assignment", "turn", "u", "b"), mapping(2, "manual_assignment", "thread", "t", "c"), mapping(3, "project_alias", "project", "c", "d"), mapping(4, "project_alias", "project", "d", "e")]
    assert effective(spark, rows) == {name("usage_event", "e1"): "b", name("usage_event", "e2"): "e", name("usage_event", "e3"): "a"}


def test_alias_cycle_and_tail(spark):
    rows = [usage(1, project="x"), usage(2, project="a"), mapping(1, "project_alias", "project", "a", "b"), mapping(2, "project_alias", "project", "b", "a"), mapping(3, "project_alias", "project", "x", "b")]
    assert effective(spark, rows) == {name("usage_event", "e1"): "b", name("usage_event", "e2"): "a"}
    assert replay(events(spark, rows), Scratch(spark)).alias_cycles.count() == 2


def test_cleared_assignment(spark):
    rows = [usage(1, thread="t", project="a"), mapping(1, "manual_assignment", "thread", "t", "b"), mapping(2, "manual_assignment", "thread", "t", None, revision=2, supersedes="m1")]
    assert effective(spark, rows) == {name("usage_event", "e1"): "a"}


@pytest.mark.parametrize(
    "rows",
    [
        [usage(1), usage(1, total=11)],
        [usage(1, source="s", revision=2)],
        [usage(1, source="s"), usage(2, source="s", revision=2, supersedes="e9")],
        [usage(1, source="s"), usage(2, source="s")],
        [usage(1, at="2026-08-26T10:00:00+09:00")],
        [usage(1), usage(2) | {"key_id": "key_h1_other"}],
        [usage(1), mapping(1, "project_alias", "thread", "t", "a")],
    ],
)
def test_fails_closed(spark, rows):
    with pytest.raises(LedgerError):
        replay(events(spark, rows), Scratch(spark))


def test_order_and_duplicates_do_not_matter(spark):
    rows = [usage(i, source=f"s{i // 2}", revision=i % 2 + 1, supersedes=f"e{i - 1}" if i % 2 else None, project="abc"[i % 3]) for i in range(12)]
    first = effective(spark, rows)
    mixed = rows + rows[:5]
    random.Random(3).shuffle(mixed)
    assert effective(spark, mixed) == first


def test_ledger_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [usage(1, total=12, project="a"), usage(2, total=18, project="a", at="2026-08-27T10:00:00Z"), mapping(1, "manual_assignment", "thread", "t", "b"), mapping(2, "project_alias", "project", "b", "c")]
    typed = events(spark, rows).select(*[f.split()[0] for f in EVENT_FIELDS["usage_checkpoint"]], *[c for c in EVENT_FIELDS["mapping"] if c not in EVENT_FIELDS["usage_checkpoint"]], "scope_key", "window_minutes", "used_percent", "remaining_percent", "reset_at")
    assert len(typed.columns) == len(spark.createDataFrame([], EVENT).columns)
    put = lambda df: append_events(spark, root, df, device_id=DEVICE, key_id=key_id(KEY))
    assert put(typed.where("event_type = 'mapping'")) == 2
    assert put(typed) == 2  # the rest, counted though the ledger was there
    assert put(typed) == 0
    with pytest.raises(LedgerError):
        put(typed.withColumn("model", F.when(F.col("event_type") == "usage_checkpoint", F.lit("other"))))
    with pytest.raises(LedgerError):
        append_events(spark, root, typed, device_id="22222222-2222-4222-8222-222222222222", key_id=key_id(KEY))
    found, torn = read_ledger(spark, root)
    assert torn.isEmpty()
    model = f"file://{tmp_path}/model"
    for generation in (1, 2, 3):
        assert rebuild(spark, model, replay(found, Scratch(spark)), key_id=key_id(KEY))["generation"] == generation
    assert state(spark, model)["effective_usage_count"] == 2
    assert counts(spark, model) == {"usage_events": 2, "mapping_events": 2, "project_aliases": 1, "quota_snapshots": 0}
    daily = read(spark, model, "usage_daily_utc").orderBy("utc_date").collect()
    assert [(r["utc_date"], r["total_tokens"], r["effective_project_id"] == name("project", "c")) for r in daily] == [("2026-08-26", 12, True), ("2026-08-27", 18, True)]


def test_bad_ledger_line_is_an_error(spark, tmp_path):
    folder = tmp_path / "devices" / DEVICE / "usage" / "2026" / "08"
    folder.mkdir(parents=True)
    (folder / "26.jsonl").write_text('{"event_type": "usage_checkpoint"}\n')
    with pytest.raises(LedgerError):
        read_ledger(spark, f"file://{tmp_path}")
