import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.identity import IdentifierError, derive, derive_one, key_id, new_key
from tallyspark.functions.remote import normalize_remote, remote_error, resolve_remote
from tallyspark.functions.text import safe_relative, short_identifier, utc_instant
from tallyspark.operators.graph import ancestors, build_lineage, flatten_aliases
from tallyspark.operators.render import render_markdown, render_terminal, write_whole
from tallyspark.operators.report import Rendered, ReportQuery, period, records
from tallyspark.operators.validate import privacy_violations
from tallyspark.schemas import COUNTERS
from tallyspark.sources.state import enqueue, known_source_ids, mark_flushed, merge_cursors, pending
from tallyspark.sources.threads import InventoryError, pick_state_file, read_inventory
from tallyspark.work import Scratch

SAME = "github.com/owner/repository"


@pytest.mark.parametrize(
    ("remote", "name", "error"),
    [
        ("https://user:token@GitHub.com/Owner/Repository.git", SAME, False),
        ("ssh://git@github.com:22/owner/repository.git", SAME, False),
        ("git@github.com:Owner/Repository.git", SAME, False),
        ("git://github.com:9418/owner//repository/?q=1#x", SAME, False),
        ("https://Git.Example.com/Team/Repo", "git.example.com/Team/Repo", False),
        ("ssh://git@example.com:2222/a/b", "example.com:2222/a/b", False),
        ("https://[2001:DB8::1]/a/b.git", "[2001:db8::1]/a/b", False),
        ("https://bücher.example/a", "xn--bcher-kva.example/a", False),
        ("file:///srv/x", None, False),
        ("C:\\work\\x", None, False),
        ("/srv/x", None, False),
        ("../x", None, False),
        ("x", None, False),
        ("\\\\server\\share", None, False),
        ("  ", None, True),
        ("ftp://example.com/a", None, True),
        ("https://example.com/a/../b", None, True),
        ("https://example.com/.git", None, True),
    ],
)
def test_remotes(spark, remote, name, error):
    row = spark.createDataFrame([(remote,)], "r string").select(normalize_remote(F.col("r"), exotic=True).alias("n"), remote_error(F.col("r"), exotic=True).alias("e")).first()
    assert (row["n"], row["e"]) == (name, error)


@pytest.mark.parametrize(
    ("origin", "remotes", "expected"),
    [
        ("https://a.example/x", ["https://b.example/y"], ("self_origin", "a.example/x", ["a.example/x"])),
        (None, ["https://a.example/x", "git@a.example:x"], ("unique_remote", "a.example/x", ["a.example/x"])),
        (None, ["https://b.example/y", "https://a.example/x"], ("ambiguous_remote", None, ["a.example/x", "b.example/y"])),
        ("/srv/x", ["https://a.example/x"], ("unique_remote", "a.example/x", ["a.example/x"])),
        (None, ["/srv/x"], ("local_only", None, [])),
        (None, [], ("unclassified", None, [])),
    ],
)
def test_resolution(spark, origin, remotes, expected):
    row = spark.createDataFrame([(origin, remotes)], "o string, r array<string>").select(resolve_remote(F.col("o"), F.col("r")).alias("x")).first()["x"]
    assert tuple(row) == expected


def test_identifiers(spark):
    key = new_key()
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "v string").select(derive(key, "thread", F.col("v")).alias("x"))
    assert [r["x"] for r in df.collect()] == [derive_one(key, "thread", "a"), None, derive_one(key, "thread", "a"), derive_one(key, "thread", "b")]
    assert derive_one(key, "thread", "a") != derive_one(key, "turn", "a").replace("turn", "thr")
    assert len(key_id(key)) == len("key_h1_") + 22
    for bad in ("", " a"):
        with pytest.raises(IdentifierError):
            derive_one(key, "thread", bad)
    with pytest.raises(IdentifierError):
        derive_one(b"short", "thread", "a")


def test_text_functions(spark):
    df = spark.createDataFrame([("prj_h1_abcdefghijkl", "a/b.jsonl", "2026-08-25T15:30:00Z"), ("short", "../x", "2026-08-25T15:30:00"), ("thirteen chars", "/x", "2026-08-25T15:30:00.5+00:00")], "i string, p string, t string")
    got = df.select(short_identifier(F.col("i")), safe_relative(F.col("p")), utc_instant(F.col("t")).isNotNull()).collect()
    assert [tuple(r) for r in got] == [("prj_abcdefgh…", True, True), ("short", False, False), ("thirteen…", False, True)]


@pytest.mark.parametrize(("value", "codes"), [('{"a":{"Cwd":1}}', {"forbidden_key"}), ('{"a":"see https://x.org"}', {"network_location"}), ('{"a":["C:\\\\x"]}', {"filesystem_path"}), ('{"a":"git@h:p"}', {"network_location"}), ('{"a":"x.org/y"}', {"host_path"}), ('{"a":"b\\u0007"}', {"control_character"}), ('{"a":"fine"}', set())])
def test_privacy(spark, value, codes):
    found = privacy_violations(spark.createDataFrame([(value,)], "value string")).first()["privacy"]
    assert {c for c in found if not c.startswith("id:") and c != "event_type"} == codes


def test_lineage(spark):
    rows = spark.createDataFrame([("c", "p", "fork"), ("c", "q", "sqlite_spawn"), ("q", "r", "session_source"), ("s", "s", "fork"), ("x", "y", "fork"), ("y", "x", "fork"), ("k", "a", "fork"), ("k", "b", "fork")], "child string, parent string, source string")
    parents, issues = build_lineage(rows, Scratch(spark))
    assert sorted(map(tuple, parents.collect())) == [("c", "q"), ("q", "r")]
    assert sorted((r["child"], r["code"]) for r in issues.collect()) == [("c", "lower_priority_parent_ignored"), ("k", "conflicting_parent_ignored"), ("k", "conflicting_parent_ignored"), ("s", "self_parent_ignored"), ("x", "lineage_cycle_ignored"), ("y", "lineage_cycle_ignored")]
    up = ancestors(parents.selectExpr("child src", "parent dst"), Scratch(spark), "u")
    assert sorted(map(tuple, up.collect())) == [("c", "q", 1), ("c", "r", 2), ("q", "r", 1)]


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    flat, cycles = flatten_aliases(edges, Scratch(spark))
    assert cycles.isEmpty() and flat.where("source = 0").first()["target"] == 300
    assert flat.agg(F.max("depth")).first()[0] == 300


def test_report_and_renderers(spark, tmp_path):
    rows = [("2026-08-25 15:30:00", "prj_h1_alphaalpha", "d1", 10, 5), ("2026-08-26 14:59:00", "prj_h1_alphaalpha", "d1", 20, None), ("2026-08-26 15:01:00", "prj_h1_alphaalpha", "d1", 30, None), ("2026-08-26 10:00:00", "prj_h1_betabeta", "d2", 40, None), ("2026-08-26 16:00:00", "prj_h1_alphaalpha", "d1", None, None)]
    usage = spark.createDataFrame(rows, "t string, effective_project_id string, device_id string, delta_total_tokens long, delta_cache_write_input_tokens long")
    extra = {f"delta_{c}": F.lit(None).cast("long") for c in COUNTERS if c not in ("total_tokens", "cache_write_input_tokens")}
    usage = usage.withColumns(extra | {"occurred_ts": F.to_timestamp_ntz("t"), "thread_key": F.lit("t"), "model": F.lit("m"), "reasoning_effort": F.lit(None).cast("string"), "source_kind": F.lit("cli")})
    names = spark.createDataFrame([("project_name", "prj_h1_alphaalpha", "알파|프로젝트"), ("device_name", "d1", "집 PC")], "kind string, subject string, name string")
    report = Rendered.of(records(usage, names, ReportQuery()), ReportQuery())
    assert (report.total["total_tokens"], report.total["included_events"], report.total["excluded_events"]) == (100, 4, 1)
    alpha = [(r["raw_date"], r["total_tokens"], r["cumulative_total_tokens"], r["cache_write_input_tokens_partial"], r["excluded_events"]) for r in report.rows if r["label_project"] == "알파|프로젝트"]
    assert alpha == [("2026-08-26", 30, 30, True, 0), ("2026-08-27", 30, 60, False, 1)]
    q = ReportQuery(from_date=dt.date(2026, 8, 26), to_date=dt.date(2026, 8, 26))
    assert Rendered.of(records(usage, names, q), q).total["total_tokens"] == 70
    q = ReportQuery(project="알파|프로젝트", device="집 PC")
    assert Rendered.of(records(usage, names, q), q).total["total_tokens"] == 60
    text = render_markdown(report, "Usage")
    assert "알파\\|프로젝트" in text and "5*" in text
    assert "총 토큰: 100" in render_terminal(report)
    write_whole(str(tmp_path / "r.md"), text)
    assert (tmp_path / "r.md").read_text() == text
    for bad in ({"group_by": ()}, {"group_by": ("date", "date")}, {"group_by": ("x",)}, {"timezone": "No/Where"}, {"from_date": dt.date(2026, 1, 2), "to_date": dt.date(2026, 1, 1)}):
        with pytest.raises(ValueError):
            ReportQuery(**bad)
    assert period("week", dt.datetime(2026, 8, 27, 20, tzinfo=dt.UTC), "Asia/Seoul") == (dt.date(2026, 8, 24), dt.date(2026, 8, 28))


def test_inventory(spark, tmp_path):
    path = str(tmp_path / "state_5.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE threads (id TEXT, tokens_used INT, model TEXT)")
        db.executemany("INSERT INTO threads VALUES (?, ?, ?)", [("parent", 100, "a"), ("child", 40, "")])
        db.execute("CREATE TABLE thread_spawn_edges (parent_thread_id TEXT, child_thread_id TEXT)")
        db.execute("INSERT INTO thread_spawn_edges VALUES ('parent', 'child')")
    threads, edges, issues = read_inventory(spark, path)
    assert sorted((r["thread_id"], r["tokens_used"], r["model"], r["cwd"]) for r in threads.collect()) == [("child", 40, None, None), ("parent", 100, "a", None)]
    assert [(r["parent"], r["child"], r["status"]) for r in edges.collect()] == [("parent", "child", None)] and issues == []
    with sqlite3.connect(path) as db:
        db.execute("DROP TABLE thread_spawn_edges")
        db.execute("INSERT INTO threads VALUES ('parent', 1, 'x')")
    with pytest.raises(InventoryError):
        read_inventory(spark, path)
    assert pick_state_file([("/x/state_5.sqlite", 1.0), ("/x/state_12.sqlite", 0.5), ("/x/other", 9.0)]) == "/x/state_12.sqlite"


def test_state_tables(spark):
    outbox = spark.createDataFrame([], "event_id string, payload_json string, sequence long, flushed_at timestamp")
    new = spark.createDataFrame([("e1", '{"event_type":"usage_checkpoint","source_event_id":"s1"}'), ("e2", '{"event_type":"mapping"}')], "event_id string, payload_json string")
    box = enqueue(enqueue(outbox, new), new)
    assert box.count() == 2 and pending(box, 1).count() == 1
    assert [r[0] for r in known_source_ids(box).collect()] == ["s1"]
    paths = spark.createDataFrame([("e1", "devices/a/usage.jsonl")], "event_id string, ledger_path string")
    assert pending(mark_flushed(box, paths), 9).count() == 1
    with pytest.raises(ValueError):
        mark_flushed(box, paths.withColumn("ledger_path", F.lit("../x")))
    old = spark.createDataFrame([("a", 1, 5, 10)], "source_id string, size int, modified int, last_record int")
    assert merge_cursors(old, spark.createDataFrame([("a", 2, 6, 12)], old.schema)).first()["last_record"] == 12
    with pytest.raises(ValueError):
        merge_cursors(old, spark.createDataFrame([("a", 1, 5, 9)], old.schema))
