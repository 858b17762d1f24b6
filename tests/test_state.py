"""Status, lock, triggers, settings, versions."""

import json
import os

import pytest

from siftlode import state
from siftlode.sources.versions import Versions


@pytest.fixture
def files(spark, tmp_path):
    return state.Files(spark, f"file://{tmp_path}/home")


def test_status_machine(files):
    s = state.StatusStore(files)
    assert s.status("a") == "not_found"
    options = {"request_splitter": "definitions", "request_custom_extensions": [".x"], "request_ignore_patterns": ["*.y"]}
    s.indexing("a", "/a", 0, options)
    s.indexing("a", "/a", 42)
    assert [s.progress("a", k, 3) for k in (0, 1, 3)] == [10, 40, 100] and s.get("a")["indexing_percentage"] == 100
    assert s.indexed("a", "/a", 3, 5) and s.get("a")["request_custom_extensions"] == [".x"]
    s.failed("a", "/a", "broken", 55)
    assert s.status("a") == "indexfailed" and s.get("a")["request_splitter"] == "definitions" and s.get("a")["last_attempted_percentage"] == 55
    s.indexing("a", "/a", 0, {})
    assert not any(k in s.get("a") for k in state.OPTIONS)
    assert not s.indexed("b", "/b", 0, 0) and s.status("b") == "not_found"
    assert s.indexed("b", "/b", 0, 0, "limit_reached")


def test_interrupted_runs_and_merging(files):
    s = state.StatusStore(files)
    s.indexing("a", "/a", 25, {"request_splitter": "window"})
    s.indexed("b", "/b", 1, 1)
    again = state.StatusStore(files)
    assert again.status("a") == "indexfailed" and again.get("a")["last_attempted_percentage"] == 25 and again.get("a")["request_splitter"] == "window"
    s.indexed("c", "/c", 1, 1)  # by the first process, after the second one read the file
    again.indexing("b", "/b", 10)
    assert set(json.loads(files.read("status.json"))) == {"a", "b", "c"}
    assert again.listed("indexed") == ["c"] and again.listed("indexing") == ["b"]
    again.remove("c")
    assert again.listed("indexed") == [] and set(json.loads(files.read("status.json"))) == {"a", "b"}


def test_lock(files):
    a, b = state.Lock(files), state.Lock(files)
    assert a.acquire() and not b.acquire()
    assert not b.release() and files.read("sync.lock")  # not the owner
    assert a.release() and b.acquire()
    late = state.Lock(files)
    assert not late.acquire() and late.acquire(now=files.changed_at("sync.lock") + 601)
    assert not b.release() and late.release() and files.read("sync.lock") is None
    with state.Lock(files), pytest.raises(RuntimeError), state.Lock(files):
        pass


def test_triggers_throttles_and_polls(files):
    t = state.TriggerFile(files)
    assert not t.fired()
    files.write("trigger", "x")
    at = files.changed_at("trigger")
    assert not t.fired(at + 1) and t.fired(at + 3) and not t.fired(at + 9)
    th = state.Throttle(60)
    assert th.ready(0) and not th.ready(59) and th.ready(60)
    runs = []
    p = state.Poller(lambda: runs.append(1), every=0, first=5)
    begin = p.due - 5
    assert not p.tick(begin + 4) and p.tick(begin + 5) and not p.tick(begin + 5.5) and p.tick(begin + 6)
    p.busy = True
    assert not p.tick(begin + 100) and len(runs) == 2


def test_abort(spark):
    a = state.Abort(spark)
    a.check()
    a.ask()
    with pytest.raises(state.Aborted):
        a.check()


def test_settings_and_paths(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nONE=1\nTWO='two words'\n")
    monkeypatch.setenv("ONE", "process")
    assert state.setting("ONE", env_file=str(env)) == "process"
    assert state.setting("TWO", env_file=str(env)) == "two words" and state.setting("THREE", "d", str(env)) == "d"
    deep = tmp_path / "repo/a/b"
    deep.mkdir(parents=True)
    assert state.resolve_path("x", str(tmp_path)) == f"{tmp_path}/x" and state.resolve_path(" /abs ") == "/abs"
    assert state.resolve_path("~") == os.path.expanduser("~") == state.resolve_path("home") and state.resolve_path("~/x").endswith("/x")
    (tmp_path / "repo/package.json").write_text("{}")
    assert state.resolve_path("workspace", str(deep)) == f"{tmp_path}/repo"
    (tmp_path / "repo/a/.git").mkdir()
    assert state.resolve_path(".", str(deep)) == f"{tmp_path}/repo/a"


def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    assert v.read("a int").count() == 0
    v.write(spark.createDataFrame([(1,)], "a int"))
    v.write(v.read("a int").unionByName(spark.createDataFrame([(2,)], "a int")))  # reads the version before
    (tmp_path / "v/v3").mkdir()  # a write that died
    assert sorted(r.a for r in v.read("a int").collect()) == [1, 2] and not (tmp_path / "v/v1").exists()
    v.write(spark.createDataFrame([(3,)], "a int"))
    assert [r.a for r in v.read("a int").collect()] == [3] and sorted(os.listdir(tmp_path / "v")) == ["v4"]
    v.clear()
    assert v.read("a int").count() == 0
