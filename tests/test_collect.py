import json

import pytest

from tallyspark.functions.identity import derive_one, key_id
from tallyspark.operators.replay import LedgerError, replay
from tallyspark.plans.collect import collect_files
from tallyspark.plans.manage import alias, link
from tallyspark.sources.ledger import read_ledger
from tallyspark.work import Scratch

KEY = b"q" * 32
DEVICE = "33333333-3333-4333-8333-333333333333"
CURSORS = "source_id string, size long, modified timestamp, last_record long"
OUTBOX = "event_id string, payload_json string, sequence long, flushed_at timestamp"
EVIDENCE = "workdir string, status string, repository_root string, remotes array<struct<name:string,url:string>>"
INVENTORY = "thread_id string, cwd string, git_origin_url string"


def session(thread, counts, **meta):
    yield {"type": "session_meta", "payload": {"id": thread, "source": "cli", "cli_version": "7"} | meta}
    for turn, total in counts:
        yield {"type": "event_msg", "payload": {"type": "task_started", "turn_id": turn}}
        usage = {"input_tokens": total - 3, "output_tokens": 3, "total_tokens": total}
        yield {"timestamp": "2026-03-04T05:06:07Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage}}}


def write(folder, name, records):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))


def project(name):
    return derive_one(KEY, "project", name)


class Home:
    """A home with logs, its ledger, and the state between runs."""

    def __init__(self, spark, root):
        self.spark, self.logs, self.ledger = spark, root / "home" / "sessions" / "2026", f"file://{root}/ledger"
        self.home = f"file://{root}/home"
        self.cursors, self.outbox = spark.createDataFrame([], CURSORS), spark.createDataFrame([], OUTBOX)
        self.evidence = spark.createDataFrame([("/w", "repository", "/w", [("origin", "https://bücher.example/Team/Repo.git")])], EVIDENCE)
        self.inventory = spark.createDataFrame([("bare", "/w", None)], INVENTORY)

    def collect(self):
        done = collect_files(self.spark, self.home, self.ledger, self.evidence, key=KEY, device_id=DEVICE, cursors=self.cursors, outbox=self.outbox, inventory=self.inventory)
        self.cursors, self.outbox = done.cursors, done.outbox
        return done

    def change(self, how, rows, schema, **more):
        done = how(self.spark, self.ledger, self.outbox, self.spark.createDataFrame(rows, schema), key=KEY, device_id=DEVICE, **more)
        self.outbox = done.outbox
        return done

    def usage(self):
        done = replay(read_ledger(self.spark, self.ledger)[0], Scratch(self.spark), expected_key=key_id(KEY))
        return {(r["turn_key"], r["delta"]["total_tokens"]): r["effective_project_id"] for r in done.usage.collect()}


def turn(name):
    return derive_one(KEY, "turn", name)


def test_files_to_ledger_and_mappings(spark, tmp_path):
    home = Home(spark, tmp_path)
    write(home.logs, "a", session("own", [("a1", 17), ("a2", 40)], git={"repository_url": "git@git.example:x/y.git"}))
    write(home.logs, "b", session("bare", [("b1", 29)]))
    write(home.logs, "c", [{"type": "session_meta", "payload": {}}])
    first = home.collect()
    assert (first.appended, home.cursors.count(), {r["code"] for r in first.fatal.collect()}) == (3, 2, {"session_meta"})
    ours, books = project("git.example/x/y"), project("xn--bcher-kva.example/Team/Repo")
    assert home.usage() == {(turn("a1"), 17): ours, (turn("a2"), 23): ours, (turn("b1"), 29): books}

    write(home.logs, "c", session("fork", [("a1", 17), ("c1", 50)], forked_from_id="own", git={"repository_url": "ssh://git.example/x/y"}))
    assert home.collect().appended == 1  # file c is read again; what the fork copied is known
    assert home.cursors.count() == 3
    assert (home.collect().appended, home.outbox.where("flushed_at is null").count()) == (0, 0)

    # a turn to the other project, then that project to be the first one
    schema, pair = "subject_type string, subject string, target_project_id string", "source_project_id string, target_project_id string"
    assert home.change(link, [("turn", "a2", books)], schema).appended == 1
    assert home.usage()[(turn("a2"), 23)] == books
    assert home.change(alias, [(books, ours)], pair).appended == 1
    assert set(home.usage().values()) == {ours}

    # targets go through their alias; a thread may be known to the inventory alone
    idle = spark.createDataFrame([("idle",)], "thread_id string")
    written = home.change(link, [("thread", "idle", books), ("turn", turn("a2"), ours)], schema, threads=idle).mappings
    found = {r["subject_id"]: (r["target_project_id"], r["revision"]) for r in written.collect()}
    assert found == {derive_one(KEY, "thread", "idle"): (ours, 1), turn("a2"): (ours, 2)}

    before = home.outbox.count()
    for row in [("project", "a1", ours), ("thread", "thr_h1_short", ours), ("turn", "a1", project("nowhere"))]:
        with pytest.raises(LedgerError):
            home.change(link, [row], schema)
    with pytest.raises(LedgerError):
        home.change(alias, [(ours, books)], pair)
    assert home.outbox.count() == before
