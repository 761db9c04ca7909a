from tallyspark.functions.identity import key_id
from tallyspark.operators.doctor import has_errors
from tallyspark.operators.replay import replay
from tallyspark.plans.diagnose import diagnose
from tallyspark.sources import readmodel
from tallyspark.sources.ledger import read_ledger
from tallyspark.work import Scratch

from .test_collect import KEY, session, write
from .test_collect_runs import Site


def report(site, expected=None, **more):
    rows = diagnose(site.spark, f"{site.root}/home", f"{site.root}/state", f"{site.root}/ledger", f"{site.root}/model", key=KEY, expected_key_id=expected or key_id(KEY), **more)
    return {r["name"]: (r["status"], r["message"]) for r in rows.collect()}, has_errors(rows)


def test_nothing_is_there(spark, tmp_path):
    found, failed = report(Site(spark, tmp_path), expected="key_h1_other")
    status = {name: v[0] for name, v in found.items()}
    assert status == {"shared-key": "error", "rollouts": "error", "state-db": "warning", "local-state": "warning", "ledger": "ok", "classification": "ok", "read-model": "warning"}
    assert failed


def test_after_a_run(spark, tmp_path):
    site = Site(spark, tmp_path)
    write(site.logs, "a", session("own", [("a1", 10), ("a2", 20)], cli_version="1.2.3"))
    write(site.logs, "b", session("kin", [("b1", 10)], cli_version="0.9.0", forked_from_id="own", git={"repository_url": "git@git.example:x/y.git"}))
    write(site.logs, "c", session("lone", [("c1", 10), ("c2", 20)], cli_version="1.2.3"))
    site.run()
    readmodel.rebuild(spark, f"{site.root}/model", replay(read_ledger(spark, f"{site.root}/ledger")[0], Scratch(spark), expected_key=key_id(KEY)), key_id=key_id(KEY))
    inventory = spark.createDataFrame([("own", "a.jsonl"), ("gone", "x.jsonl"), ("never", None)], "thread_id string, rollout_path string")
    edges = spark.createDataFrame([("own", "own")], "child string, parent string")
    found, failed = report(site, inventory=inventory, edges=edges)
    assert found["versions"] == ("ok", "0.9.0, 1.2.3; 0 missing, 0 invalid")
    assert found["source-join"] == ("warning", "2 in logs only, 1 in the inventory only")
    assert found["state-db"] == ("ok", "3 threads, 1 edges")
    assert found["lineage"] == ("warning", "1 issues")  # a thread that is its own parent
    assert found["classification"] == ("warning", "2 events of 1 threads: unclassified=2")
    ok = {"shared-key", "rollouts", "local-state", "collect-history", "outbox", "parser-issues", "ledger", "read-model"}
    assert {name for name, v in found.items() if v[0] == "ok"} == ok | {"versions", "state-db"}
    assert found["sync-history"][0] == "warning" and len(found) == 14 and not failed
