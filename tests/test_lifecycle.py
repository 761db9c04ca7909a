import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.lifecycle import calculate_deltas, deduplicate_events, fork_conflicts, fork_depths
from tallyspark.schemas import COUNTS
from tallyspark.sources.rollouts import early_metadata, parse_rollouts
from tallyspark.work import Scratch

SCHEMA = f"file string, record_index long, thread_id string, forked_from string, turn_id string, ordinal int, operation string, model string, reasoning_effort string, occurred_ts timestamp, cumulative {COUNTS}, reported_last {COUNTS}"


def counts(i, o, t, cached=None):
    return (i, cached, None, o, None, t)


def frame(spark, rows):
    return spark.createDataFrame([(r["file"], r["at"], r.get("thread", "t"), r.get("fork"), r.get("turn", "turn"), r.get("ordinal", r["at"]), r.get("op", "turn"), r.get("model"), r.get("effort"), None, r["c"], r.get("last")) for r in rows], SCHEMA)


def deltas(spark, rows):
    return [(r["delta"] and r["delta"]["total_tokens"], r["flags"]) for r in calculate_deltas(frame(spark, rows)).orderBy("record_index").collect()]


def test_deltas_add_up_between_regressions(spark):
    """Whatever the totals: a fall gives none, and what was added since the last fall (or the start) is what the total rose."""
    totals = [37, 37, 52, 8, 8, 61, 60, 3, 1000]
    found = deltas(spark, [{"file": "f", "at": i, "c": counts(t - 2, 2, t)} for i, t in enumerate(totals, 1)])
    base, added = 0, 0
    for was, now, (delta, flags) in zip([0, *totals], totals, found, strict=False):
        assert (delta is None) == (now < was) == ("counter_regression" in flags)
        base, added = (now, 0) if delta is None else (base, added + delta)
        assert base + added == now


@pytest.mark.parametrize("fallen", ["input_tokens", "cached_input_tokens", "output_tokens"])
def test_a_component_that_falls_is_null_and_no_other_is(spark, fallen):
    names = ("input_tokens", "cached_input_tokens", "output_tokens")
    first = dict.fromkeys(names, 40)
    then = {n: 40 - 7 if n == fallen else 40 + 11 for n in names}
    rows = [{"file": "f", "at": i, "c": counts(v["input_tokens"], v["output_tokens"], 500 + i, v["cached_input_tokens"])} for i, v in enumerate((first, then), 1)]
    last = calculate_deltas(frame(spark, rows)).where("record_index = 2").first()
    assert {n: last["delta"][n] for n in names} == {n: None if n == fallen else 11 for n in names}
    assert [f for f in last["flags"] if f.startswith("component_regression")] == [f"component_regression:{fallen}"]


def test_flags_of_reported_values(spark):
    rows = [{"file": "f", "at": 1, "turn": None, "c": counts(90, 10, 100), "last": counts(None, None, 90)}, {"file": "f", "at": 2, "op": "compact", "c": counts(90, 10, 100), "last": counts(None, None, 30)}]
    assert deltas(spark, rows) == [(100, ["reported_last_mismatch", "weak_dedupe_key"]), (0, ["compact_reported_last_excluded"])]


def test_seed_precedes_the_first_record(spark):
    rows = frame(spark, [{"file": "f", "at": 1, "c": counts(200, 30, 230)}])
    seeds = spark.createDataFrame([("f", counts(150, 20, 170))], f"file string, seed {COUNTS}")
    assert calculate_deltas(rows, seeds).first()["delta"]["total_tokens"] == 60


def forked(spark, model=None, copy_total=100):
    rows = [{"file": "p", "at": 1, "thread": "parent", "turn": "one", "ordinal": 0, "c": counts(90, 10, 100), "model": "m"}, {"file": "f", "at": 1, "thread": "fork", "fork": "parent", "turn": "one", "ordinal": 0, "c": counts(copy_total - 10, 10, copy_total), "model": model}, {"file": "f", "at": 2, "thread": "fork", "fork": "parent", "turn": "two", "ordinal": 0, "c": counts(180, 10, 190), "model": "m"}]
    return calculate_deltas(frame(spark, rows))


@pytest.mark.parametrize(("model", "merged", "flags"), [(None, "m", []), ("m", "m", []), ("x", None, ["metadata_conflict:model"])])
def test_fork_copies_go(spark, model, merged, flags):
    events = forked(spark, model)
    done = deduplicate_events(events, fork_depths(events.select("thread_id", "forked_from"), Scratch(spark)))
    found = {r["turn_id"]: r for r in done.collect()}
    assert (found["one"]["thread_id"], found["one"]["model"], found["one"]["flags"]) == ("parent", merged, flags)
    assert found["two"]["delta"]["total_tokens"] == 90
    again = deduplicate_events(done.select(*events.columns), fork_depths(events.select("thread_id", "forked_from"), Scratch(spark)))
    assert {(r["turn_id"], r["model"], tuple(r["flags"])) for r in again.collect()} == {(r["turn_id"], r["model"], tuple(r["flags"])) for r in found.values()}


def test_copies_that_differ_are_conflicts(spark):
    assert fork_conflicts(forked(spark)).isEmpty()
    assert not fork_conflicts(forked(spark, copy_total=110)).isEmpty()


def test_fork_cycle_is_an_error(spark):
    threads = spark.createDataFrame([("a", "b"), ("b", "a")], "thread_id string, forked_from string")
    with pytest.raises(ValueError, match="cycle"):
        fork_depths(threads, Scratch(spark))


def lines(spark, records, file="f"):
    return spark.createDataFrame([(file, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records, 1)], "file string, record_index int, line string")


def meta(**more):
    return {"type": "session_meta", "payload": {"id": "thread", "source": "cli"} | more}


def event(kind, **more):
    return {"timestamp": "2026-08-25T15:30:00+09:00", "type": "event_msg", "payload": {"type": kind} | more}


def count(total, **more):
    return event("token_count", info={"total_token_usage": {"input_tokens": total - 1, "output_tokens": 1, "total_tokens": total}} | more)


def test_parser_carries_state(spark):
    records = [
        meta(source={"subagent": {"thread_spawn": {"parent_thread_id": "up"}}}),
        event("task_started", turn_id="one"),
        {"type": "turn_context", "payload": {"turn_id": "one", "model": "m", "effort": None, "reasoning_effort": "high"}},
        count(10),
        {"type": "response_item", "payload": {"type": "function_call", "arguments": json.dumps({"a": [{"workdir": "/w"}], "cwd": "/c"})}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "input": 'run({\n  workdir: "/js",\n})'}},
        {"type": "compacted", "payload": {}},
        count(20),
        event("task_complete", turn_id="one"),
        count(30),
        {"type": "turn_context", "payload": {"turn_id": "two", "reasoning_effort": "low"}},
        count(40),
        event("token_count", info=None),
        "",
    ]
    parsed = parse_rollouts(lines(spark, records[:-1]))
    got = [(r["turn_id"], r["ordinal"], r["operation"], r["model"], r["reasoning_effort"], r["activity_workdirs"]) for r in parsed.checkpoints.orderBy("record_index").collect()]
    dirs = ["/c", "/js", "/w"]
    assert got == [("one", 0, "turn", "m", None, dirs), ("one", 1, "compact", "m", None, dirs), (None, 0, "unknown", None, None, []), ("two", 0, "turn", None, "low", [])]
    m = parsed.metadata.first()
    assert (m["thread_id"], m["root_session_id"], m["source_kind"], m["source_parent_thread_id"]) == ("thread", "thread", "subAgentThreadSpawn", "up")
    assert {(r["record_index"], r["code"]) for r in parsed.issues.collect()} == {(10, "token_count_without_turn"), (13, "token_count_without_info")}
    assert parsed.fatal.isEmpty()


@pytest.mark.parametrize(
    ("records", "code"),
    [
        ([meta(), "{"], "record"),
        ([meta(), "[1]"], "record"),
        ([count(1), meta()], "token_count_before_session_meta"),
        ([meta(), event("token_count", info={"total_token_usage": {"total_tokens": True}})], "counter"),
        ([meta(), event("token_count", info={"total_token_usage": {"total_tokens": -1}})], "counter"),
        ([meta(), event("token_count", info={"total_token_usage": {"input_tokens": 1}})], "total_missing"),
        ([meta(), count(1) | {"timestamp": "2026-08-25T15:30:00"}], "timestamp"),
        ([event("task_started", turn_id="x")], "no_session_meta"),
    ],
)
def test_unusable_files_give_nothing_else(spark, records, code):
    parsed = parse_rollouts(lines(spark, records).unionByName(lines(spark, [meta(), count(5)], "good")))
    assert {(r["file"], r["code"]) for r in parsed.fatal.collect()} == {("f", code)}
    assert {r["file"] for r in parsed.checkpoints.collect()} == {"good"}


def test_early_metadata(spark):
    rows = lines(spark, [event("x"), meta(), meta(id="later")])
    assert json.loads(early_metadata(rows).first()["line"])["payload"]["id"] == "thread"
    assert early_metadata(rows.withColumn("record_index", F.col("record_index") + 256)).isEmpty()
