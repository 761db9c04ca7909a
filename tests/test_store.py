import json

import pytest

from tallyspark.sources import store
from tallyspark.sources.store import LocalState, StoreError

ISSUES = store.TABLES["issues"]


def issues(spark, *codes):
    return spark.createDataFrame([("s", k, c) for k, c in enumerate(codes)], ISSUES)


def codes(state):
    return [r["code"] for r in state.read("issues").orderBy("record_index").collect()]


def test_commits_are_whole_and_kept(spark, tmp_path):
    state = LocalState(spark, f"file://{tmp_path}")
    assert codes(state) == [] and state.manifest()["batch"] is None
    state.commit(batch=0, issues=issues(spark, "a"))
    state.commit(cursors=spark.createDataFrame([], store.TABLES["cursors"]))
    again = LocalState(spark, f"file://{tmp_path}")
    assert (codes(again), again.manifest()["batch"], again.manifest()["generation"]) == (["a"], 0, 2)
    old = state.read("issues")
    state.commit(batch=1, issues=issues(spark, "b", "c"))
    assert [r["code"] for r in old.collect()] == ["a"]  # a reader keeps the generation it began with
    assert codes(again) == ["b", "c"]
    with pytest.raises(StoreError, match="later batch"):
        state.commit(batch=0, issues=issues(spark, "x"))
    assert state.tidy(keep=1) == 1 and codes(state) == ["b", "c"]


def test_a_stopped_writer_changes_nothing(spark, tmp_path, monkeypatch):
    state = LocalState(spark, f"file://{tmp_path}")
    state.commit(issues=issues(spark, "a"))
    (tmp_path / "manifests/000000000002.json").write_text('{"version": 1, "gen')  # stopped in the middle of a manifest
    assert codes(state) == ["a"]
    state.commit(issues=issues(spark, "b"))
    assert (codes(state), state.manifest()["generation"]) == (["b"], 3)

    # another writer is faster: its generation stands
    before = LocalState.manifest
    monkeypatch.setattr(LocalState, "_generations", lambda self: [2])
    monkeypatch.setattr(LocalState, "manifest", lambda self: {"version": 1, "generation": 2, "batch": None, "tables": {}})
    with pytest.raises(StoreError, match="another writer"):
        state.commit(issues=issues(spark, "lost"))
    monkeypatch.undo()
    assert LocalState.manifest is before and codes(state) == ["b"]


def test_newer_state_is_refused(spark, tmp_path):
    state = LocalState(spark, f"file://{tmp_path}")
    found = state.commit(issues=issues(spark, "a"))
    (tmp_path / "manifests/000000000002.json").write_text(json.dumps(found | {"version": store.VERSION + 1}))
    with pytest.raises(StoreError, match="newer"):
        state.read("issues")
