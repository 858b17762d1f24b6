"""The engine end to end on a small folder, the catalog, and streams against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F

from siftlode.api import Engine
from siftlode.sources.collection import CollectionCatalog
from siftlode.streaming import jobs

FILES = {
    "src/auth.ts": "export function validateUser(name: string) {\n    return hashPassword(name);\n}\n\nexport function hashPassword(p: string) {\n    return p.length;\n}\n",
    "src/handler.py": "from auth import validate\n\ndef handle_login(name):\n    return validate(name)\n",
    "Library/generated.md": "# generated\n",
    ".hidden.md": "hidden",
    "notes.md": "# Notes on login and passwords\n\nSome words about sessions.\n",
}


def test_engine(spark, tmp_path):
    root = tmp_path / "repo"
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / ".contextignore").write_text("# comment\n/Library/\n")
    engine = Engine(spark, f"file://{tmp_path}/home")
    done = engine.index(str(root), "demo")
    assert done["indexed_files"] == 3 and done["status"] == "completed" and done["total_chunks"] >= 3
    hits = engine.search("demo", "validateUser hashPassword", 5).collect()
    assert hits[0]["relative_path"] == "src/auth.ts" and [h["rank"] for h in hits] == sorted(h["rank"] for h in hits)
    assert {h["relative_path"] for h in engine.search("demo", "login", 5, extensions=[".md"]).collect()} == {"notes.md"}
    assert {r.name for r in engine.graph.find("demo", name="password").collect()} == {"hashPassword"}
    assert engine.graph.trace("demo", "validateUser", direction="outbound").count() == 1
    (root / "src/handler.py").write_text("def handle_logout(name):\n    return name\n")
    os.remove(root / "notes.md")
    assert engine.sync(str(root), "demo") == {"added": 0, "removed": 1, "modified": 1}
    paths = {r.relative_path for r in engine.catalog.read(engine._name("demo")).collect()}
    assert paths == {"src/auth.ts", "src/handler.py"}
    assert {r.name for r in engine.graph.find("demo", name="handle").collect()} == {"handle_logout"}
    assert engine.sync(str(root), "demo") == {"added": 0, "removed": 0, "modified": 0}
    assert engine.status("demo")["status"] == "indexed" and engine.clear("demo") and engine.status("demo")["status"] == "not_found"


def _folder(tmp_path, files):
    root = tmp_path / "repo"
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return root


def test_a_run_at_its_limit_goes_on_later(spark, tmp_path):
    root = _folder(tmp_path, {f"f{k}.py": f"def f{k}():\n    return {k}\n" for k in range(6)})
    engine = Engine(spark, f"file://{tmp_path}/home")
    assert engine.index(str(root), "p", most=3) == {"project": "p", "status": "limit_reached", "indexed_files": 3, "total_chunks": 3}
    assert engine.status("p")["index_status"] == "limit_reached"
    assert engine.sync(str(root), "p", most=2) == {"added": 3, "removed": 0, "modified": 0}
    assert engine.status("p")["total_chunks"] == 5
    engine.sync(str(root), "p")
    assert engine.status("p")["index_status"] == "completed" and engine.status("p")["chunks"] == 6
    assert engine.sync(str(root), "p") == {"added": 0, "removed": 0, "modified": 0}


def test_failures_and_recovery(spark, tmp_path):
    from siftlode.operators.embedding import HashingEmbedder

    class Flaky(HashingEmbedder):
        broken = True

        def embed_batch(self, texts):
            if self.broken:
                raise ValueError("no service")
            return super().embed_batch(texts)

    root = _folder(tmp_path, {"a.py": "def a():\n    return 1\n", "b.py": "def b():\n    return a()\n"})
    engine = Engine(spark, f"file://{tmp_path}/home", Flaky())
    with pytest.raises(Exception, match="no service"):
        engine.index(str(root), "p")
    assert engine.status("p")["status"] == "indexfailed"
    engine.embedder = HashingEmbedder()
    engine.sync(str(root), "p")
    assert engine.status("p")["status"] == "indexed" and engine.status("p")["chunks"] == 2
    engine.statuses.failed("p", str(root), "died half-way")
    engine.sync(str(root), "p")  # all files are read anew, none twice
    assert engine.status("p")["chunks"] == 2 and engine.projects() == ["p"]
    from siftlode.state import Abort, Aborted

    stop = Abort(spark)
    stop.ask()
    with pytest.raises(Aborted):
        engine.index(str(root), "p", abort=stop)


def test_graph_follows_the_files(spark, tmp_path):
    root = _folder(tmp_path, {"a.py": "from b import g\n\ndef f():\n    return g()\n", "b.py": "def g():\n    return 1\n", "Dockerfile": "FROM x:1\nCMD run\n"})
    engine = Engine(spark, f"file://{tmp_path}/home")
    engine.index(str(root), "p")
    names = lambda label: {r.name for r in engine.graph.nodes("p").where(f"label = '{label}'").collect()}
    assert names("Function") == {"f", "g"} and names("Module") == {"b"}
    engine.graph.add_adr("p", "Use a queue", "because", "proposed")
    engine.graph.update_adr("p", "Use a queue", '{"status":"accepted"}')
    (root / "b.py").write_text("def g():\n    return 2\n\ndef h():\n    return g()\n")
    engine.sync(str(root), "p")
    by_id = {r.id: r.name for r in engine.graph.nodes("p").collect()}
    calls = {(by_id[r.source_id], by_id[r.target_id]) for r in engine.graph.edges("p").where("type = 'CALLS'").collect()}
    assert calls == {("f", "g"), ("h", "g")}  # a.py was not read again
    assert [(r.title, r.status, r.content) for r in engine.graph.adrs("p").collect()] == [("Use a queue", "accepted", "because")]
    assert {r.name for r in engine.graph.find_text("p", "g").collect()} == {"g"}
    page, total, more = engine.graph.page("p", limit=1, label="Function")
    assert page.count() == 1 and total == 3 and more
    hits = engine.search("p", "return g", 3)
    layers = engine.context("p", hits)
    assert {r.name for r in layers["relations"].collect()} >= {"g"} and layers["chain"].count() >= 1
    engine.graph.delete_label("p", "ADR")
    engine.graph.delete_file("p", "b.py")
    assert names("Function") == {"f"} and names("ADR") == set()
    (root / "a.py").write_text("# nothing\n")
    os.remove(root / "b.py")
    engine.sync(str(root), "p")
    assert engine.graph.stats("p") == {"nodes": 0, "edges": 0}


def test_search_falls_back_to_names_and_cells(spark, tmp_path):
    root = _folder(tmp_path, {f"m{k}.py": f"def task_{k}():\n    return 'value {k}'\n" for k in range(30)})
    engine = Engine(spark, f"file://{tmp_path}/home", cells=4, probes=2)
    engine.index(str(root), "p")
    assert engine.search("p", "task 7 value", 3).first()["relative_path"] == "m7.py"
    got = engine.search("p", "task_7", 3, hybrid=False, threshold=2.0).collect()  # no vector is that near
    assert got[0]["relative_path"] == "m7.py" and got[0]["content"] == "p.m7.task_7"
    assert engine.commands()["searchCode"]("p", "value 3", 1).count() == 1


def test_sync_of_all_projects(spark, tmp_path):
    from siftlode.state import Lock

    roots = {p: _folder(tmp_path / p, {"a.py": f"def {p}():\n    return 1\n"}) for p in ("one", "two")}
    engine = Engine(spark, f"file://{tmp_path}/home")
    for p, root in roots.items():
        engine.index(str(root), p)
    (roots["two"] / "a.py").write_text("def changed():\n    return 1\n")
    with Lock(engine.files):
        assert engine.sync_all() == []
    got = engine.sync_all({p: str(r) for p, r in roots.items()} | {"gone": f"{tmp_path}/none"})
    assert [(r["project"], r["error"], r.get("modified")) for r in got] == [("gone", "the folder is gone", None), ("one", None, 0), ("two", None, 1)]
    assert [r["project"] for r in engine.sync_all()] == ["one", "two"]


def test_sources(spark, tmp_path):
    import subprocess

    from siftlode.sources import files

    root = _folder(tmp_path, {"a.py": "a", "node_modules/b.js": "b", "k8s/c.yaml": "kind: A", "d.yaml": "x: 1", "deep dir/e.ts": "e", "Dockerfile": "FROM a", "skip.md": "s", "note.txt": "n"})
    assert {r.path for r in files.scan(spark, f"file://{root}", None, ["skip.md"]).collect()} == {"a.py", "node_modules/b.js", "deep dir/e.ts"}
    assert {r.path for r in files.graph_files(spark, str(root)).collect()} == {"a.py", "k8s/c.yaml", "deep dir/e.ts", "Dockerfile"}
    assert files.git_files(str(root)) is None
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@x", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / ".gitignore").write_text("# c\nnode_modules/\n")
    run("add", "a.py", "skip.md")
    run("commit", "-qm", "x")
    assert files.git_files(str(root), [".py", ".js", ".md"]) == ["a.py", "skip.md"]
    os.remove(root / "skip.md")
    assert files.git_files(str(root), [".md"]) == []
    (root / "a.py").write_text("changed")
    assert files.changed_by_extension(str(root), [".py"]) == ["a.py"] and files.changed_by_extension(str(root), [".md"]) == []
    assert {r.path for r in files.code_files(spark, str(root), [".py", ".ts"]).collect()} == {"a.py", "deep dir/e.ts"}
    home = tmp_path / "all.ignore"
    home.write_text("*.log\n\n")
    assert files.ignore_patterns(f"file://{root}", str(home)) == ["node_modules/", "*.log"]


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime, timedelta

    schema, t0 = "event_id long, ts timestamp, user_id long, event_type string, value double", datetime(2026, 1, 1)
    batches = [[(1, t0, 1, "a", 1.0), (2, t0 + timedelta(hours=5), 1, "a", 1.0)], [(3, t0 + timedelta(hours=6), 1, "a", 1.0)], [(4, t0 + timedelta(minutes=5), 1, "a", 1.0), (5, t0 + timedelta(hours=9), 1, "a", 1.0)], [(6, t0 + timedelta(hours=12), 1, "a", 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {(r.window_start, r.n) for r in jobs.run_available(jobs.tumbling(stream, late="1 hour"), "late").collect()}
    assert got == {(t0, 1), (t0 + timedelta(hours=5), 1), (t0 + timedelta(hours=6), 1), (t0 + timedelta(hours=9), 1)}  # event 4 came too late


def test_catalog(spark, tmp_path):
    cat = CollectionCatalog(spark, f"file://{tmp_path}/c")
    assert cat.list() == [] and cat.count("x") == -1
    cat.create("x")
    rows = spark.createDataFrame([("a", [1.0, 2.0], "t", "f", 1, 2, ".ts", "{}", "p"), ("b", [1.0, 2.0], "t", "f", 1, 2, ".py", "{}", "q/r")], "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string, project string")
    cat.insert("x", rows, 2)
    assert cat.count("x") == 2 and [r.id for r in cat.query("x", "file_extension = '.py'", ["id"], 5).collect()] == ["b"]
    with pytest.raises(Exception, match="length 3"):
        cat.insert("x", rows, 3)
    cat.delete("x", rows.where("id = 'b'").select("project", "id"))
    assert [r.id for r in cat.read("x").collect()] == ["a"]
    assert cat.describe("x")["rows"] == 1 and cat.kind("x") == "dense"
    cat.create("y", hybrid=True)
    assert cat.kind("y") == "hybrid" and cat.list() == ["x", "y"]
    assert cat.list("x") == ["x"] and cat.drop("x") and not cat.has("x")


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    rows = [(k, f"2026-01-01 0{k % 5}:{k % 60:02d}:00", k % 3, "ab"[k % 2], float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    df.unionByName(df.limit(10)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    live = jobs.run_available(jobs.tumbling(jobs.distinct_events(stream, "1 day"), late=None), "t", "append")
    assert live.count() <= jobs.tumbling(df).count()
    full = jobs.run_available(jobs.tumbling(stream, late="1 day"), "c", "complete")
    batch = jobs.tumbling(df.unionByName(df.limit(10)))
    assert {tuple(r) for r in full.collect()} == {tuple(r) for r in batch.collect()}
    got = []
    q = jobs.maintain(spark, f"{tmp_path}/in", df.schema, lambda b, n: got.append(b.count()), f"{tmp_path}/cp")
    q.awaitTermination()
    assert sum(got) == 110
