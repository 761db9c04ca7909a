import pytest
from pyspark.sql import functions as F

from tallyspark.functions.identity import derive_one
from tallyspark.operators.replay import LedgerError
from tallyspark.plans import collect as plan
from tallyspark.plans.collect import collect_run, collect_stream
from tallyspark.sources.ledger import read_ledger
from tallyspark.sources.store import LocalState

from .test_collect import DEVICE, EVIDENCE, INVENTORY, KEY, session, write


class Site:
    def __init__(self, spark, root):
        self.spark, self.logs, self.root = spark, root / "home" / "sessions", f"file://{root}"
        self.state = LocalState(spark, f"{self.root}/state")
        self.options = {"key": KEY, "device_id": DEVICE, "inventory": spark.createDataFrame([("kid", "/w", None), ("up", None, "git@git.example:a/up.git")], INVENTORY)}
        self.evidence = spark.createDataFrame([("/w", "repository", "/w", [])], EVIDENCE)

    def run(self, **more):
        return collect_run(self.spark, f"{self.root}/home", self.state, f"{self.root}/ledger", self.evidence, **self.options | more)

    def events(self):
        rows = read_ledger(self.spark, f"{self.root}/ledger")[0]
        return sorted((r["turn_key"], r["project_id"], r["project_resolution"]) for r in rows.collect())

    def tables(self):
        out = {t: self.state.read(t) for t in ("cursors", "outbox", "issues")}
        out["outbox"] = out["outbox"].withColumn("flushed_at", F.col("flushed_at").isNotNull()).drop("sequence")
        return {t: sorted(map(str, rows.collect())) for t, rows in out.items()}


def name(kind, value):
    return derive_one(KEY, kind, value)


def test_local_and_manual_projects_and_inventory_parents(spark, tmp_path):
    """A manual turn goes before its thread's remote; a thread's own directory maps to a local project; a parent that only the
    inventory knows hints at its child."""
    site = Site(spark, tmp_path)
    write(site.logs, "a", session("own", [("a1", 10), ("a2", 20)], git={"repository_url": "git@git.example:x/y.git"}))
    write(site.logs, "k", session("kid", [("k1", 10)]))
    write(site.logs, "u", session("low", [("u1", 10)], source={"subagent": {"thread_spawn": {"parent_thread_id": "up"}}}))
    manual = spark.createDataFrame([("turn", "a2", "by-hand")], "subject_type string, subject string, project string")
    local = spark.createDataFrame([("/w", "mapped")], "repository_root string, project string")
    done = site.run(manual=manual, local=local)
    p = lambda identity: name("project", identity)
    want = [(name("turn", "a1"), p("git.example/x/y"), "self_origin"), (name("turn", "a2"), p("by-hand"), "manual"), (name("turn", "k1"), p("mapped"), "local_mapping"), (name("turn", "u1"), p("git.example/a/up"), "ancestor")]
    assert (done.appended, site.events()) == (4, sorted(want))
    runs = site.state.read("runs").collect()
    assert [(r["run_id"], r["kind"], r["status"]) for r in runs] == [(1, "collect", "succeeded")]

    # a ledger of another key is refused before anything is gathered
    write(site.logs, "b", session("more", [("b1", 5)]))
    with pytest.raises(LedgerError, match="another key"):
        site.run(key=b"z" * 32)
    assert [(r["status"], r["detail"]) for r in site.state.read("runs").orderBy("run_id").collect()] == [("succeeded", None), ("failed", "LedgerError")]
    assert site.state.read("cursors").count() == 3


def test_a_run_that_stops_anywhere_ends_alike(spark, tmp_path, monkeypatch):
    sites = []
    for where in ("nowhere", "before the state", "after the append"):
        root = tmp_path / where.replace(" ", "-")
        site = Site(spark, root)
        write(site.logs, "a", session("own", [("a1", 10), ("a2", 20)]))
        write(site.logs, "bad", [{"type": "session_meta", "payload": {}}])
        if where == "before the state":
            with monkeypatch.context() as m:
                m.setattr(plan, "record_issues", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    site.run(batch=0)
            assert site.events() == [] and site.state.manifest()["batch"] is None
        if where == "after the append":
            with monkeypatch.context() as m:
                m.setattr(plan, "mark_flushed", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    site.run(batch=0)
            assert len(site.events()) == 2 and site.state.manifest()["batch"] == 0
            monkeypatch.setattr(plan, "gather", None)  # the batch is in the state; it is not gathered again
        site.run(batch=0)
        monkeypatch.undo()
        sites.append(site)
    plain, *stopped = sites
    strip = lambda tables, root: {t: [x.split("source_id=")[0] if t != "outbox" else x for x in rows] for t, rows in tables.items()}
    for site in stopped:
        assert site.events() == plain.events() and len(site.events()) == 2
        assert {t: len(r) for t, r in site.tables().items()} == {t: len(r) for t, r in plain.tables().items()}
        assert strip(site.tables(), site.root)["outbox"] and all("flushed_at=True" in x for x in site.tables()["outbox"])
        assert [r["code"] for r in site.state.read("issues").collect()] == ["fatal:session_meta"]
    assert plain.state.read("runs").where("status = 'succeeded'").count() == 1


def test_stream_of_runs(spark, tmp_path):
    site = Site(spark, tmp_path)
    write(site.logs, "a", session("own", [("a1", 10)]))

    def run():
        query = collect_stream(spark, f"{site.root}/home", site.state, f"{site.root}/ledger", site.evidence, f"{site.root}/offsets", settle=0.05, **site.options)
        assert query.awaitTermination(300) and query.exception() is None

    run()
    assert len(site.events()) == 1
    run()  # nothing changed: no batch, no run
    assert site.state.read("runs").count() == 1
    write(site.logs, "a", session("own", [("a1", 10), ("a2", 30)]))
    run()
    assert (len(site.events()), site.state.read("runs").count(), site.state.manifest()["batch"]) == (2, 2, 1)
