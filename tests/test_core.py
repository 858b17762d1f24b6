"""Core operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from siftlode.functions import paths, text
from siftlode.operators import chunking, retrieval
from siftlode.operators.embedding import EmbeddingError, HashingEmbedder, checked
from siftlode.operators.graph import extract, resolve, search, tables, trace


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("/Library/", "Library/generated.md", True), ("/Library/", "src/Library/nested.md", False), ("Library/", "src/Library/nested.md", True),
        ("*.md", "a/b.md", True), ("*.md", "a/b.mdx", False), ("src/*.ts", "src/deep/x.ts", True), ("src/ignored.ts", "src/ignored.ts", True),
        ("", "x", False), ("a.b", "axb", False), ("build", "x/build/y.c", True), ("?.c", "a.c", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    row = spark.createDataFrame([(path,)], "p string").select(paths.ignored(F.col("p"), [pattern]).alias("x")).first()
    assert row.x is hit


def test_dot_parts_and_extensions(spark):
    df = spark.createDataFrame([(".hidden.md",), (".github/workflows/a.yml",), ("src/.cache/x",), ("src/keep.md",)], "p string")
    assert [r.p for r in df.where(~paths.has_dot_part(F.col("p"))).collect()] == ["src/keep.md"]
    assert paths.extension_list(["ts", ".py", "ts"]) == [".ts", ".py"]
    with pytest.raises(ValueError):
        paths.extension_list([". x"])


def test_line_split_limits_and_overlap(spark):
    lines = ["a" * 900, "b" * 900, "c" * 3000, "", "d"]
    df = spark.createDataFrame([("f", "\n".join(lines)), ("empty", ""), ("null", None)], "path string, content string")
    got = {r.seq: r.content for r in chunking.line_chunks(df).where("path = 'f'").collect()}
    assert [len(got[k]) for k in sorted(got)] == [1801, 3000, 1]  # a blank line in front of a piece is not kept
    assert chunking.line_chunks(df).where("path <> 'f'").count() == 0
    with_tail = {r.seq: r.content for r in chunking.with_overlap(chunking.line_chunks(df)).where("path = 'f'").collect()}
    assert with_tail[1].startswith("b" * 300 + "\n") and with_tail[0] == got[0]


def test_recursive_and_window_splits():
    t = "\n\n".join(f"paragraph {k} " + "word " * 30 for k in range(20))
    pieces = chunking.recursive_split(t, 400, 50)
    assert all(len(p) <= 400 for p in pieces) and "".join(t.split()) in "".join("".join(p.split()) for p in pieces) or len(pieces) > 5
    spans = chunking.window_split(t, 500, 100)
    assert spans[0][1] == 1 and spans[-1][2] == len(t.split("\n")) and all(a < b or a == b for _, a, b in spans)
    code = "import os\n\n@deco\ndef f():\n    def g():\n        return 1\n    return g\n\nclass A:\n    def m(self):\n        pass\n"
    assert [(a, b) for _, a, b in chunking.definition_split(code, "python")] == [(3, 7), (5, 6), (9, 11), (10, 11)]
    assert chunking.definition_split("", "python") == []


def test_dense_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "id int, vector array<float>")
    got = [(r.id, r.score) for r in retrieval.dense_topk(df, [1.0, 0.0], 4).collect()]
    assert got == [(1, 1.0), (4, 1.0), (2, 0.0), (5, 0.0)]
    assert retrieval.dense_topk(df.limit(0), [1.0, 0.0]).count() == 0
    index = retrieval.InvertedFile(cells=2).fit(df, "id", "vector")
    assert {r.id for r in index.search(index.assign(df, "vector"), [1.0, 0.0], 2, 2, "id", "vector").collect()} == {1, 4}


def test_bm25_and_fusion(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None)], "id int, content string")
    hits = retrieval.bm25_topk(df, "red fox").collect()
    assert [h.id for h in hits] == [1, 2] and hits[0].score > hits[1].score
    assert retrieval.bm25_topk(df, "").count() == 0
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id int, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id int, score double")
    fused = retrieval.rrf(a, b).collect()
    assert [r.id for r in fused] == [2, 1, 3] and abs(fused[0].score - (1 / 101 + 1 / 102)) < 1e-8


def test_overlaps_are_dropped_in_rank_order(spark):
    rows = [(1, "a", "f", 1, 10), (2, "b", "f", 6, 15), (3, "c", "f", 5, 14), (4, "d", "f", 14, 20), (5, "e", "g", 1, 3)]
    df = spark.createDataFrame(rows, "rank int, id string, file string, start_line int, end_line int")
    assert {r.id for r in retrieval.drop_overlaps(df, 0.5).collect()} == {"a", "b", "d", "e"}
    assert {r.id for r in retrieval.drop_overlaps(df, None).collect()} == {"a", "d", "e"}


def test_embedder_checks():
    e = HashingEmbedder(8)
    assert len(checked(e, ["a", ""])) == 2

    class Short:
        dimension = 8

        def embed_batch(self, texts):
            return []

    with pytest.raises(EmbeddingError, match="returned 0 embeddings for 2 chunks"):
        checked(Short(), ["a", "b"])


REG = "seq long, name string, qualified_name string, label string"
CALL = "call_id int, callee string, module_qn string, import_keys array<string>, import_vals array<string>"
GOLDEN = [
    (["test.db.queryUser"], "db.queryUser", "test.auth", ["db"], ["test.db"], "test.db.queryUser", "import_map", 0.95),
    (["test.auth.requireAdmin"], "requireAdmin", "test.handler", ["requireAdmin"], ["test.auth"], "test.auth.requireAdmin", "import_map", 0.95),
    (["test.auth.helper"], "helper", "test.auth", [], [], "test.auth.helper", "same_module", 0.90),
    (["test.utils.uniqueFunc"], "uniqueFunc", "test.other", [], [], "test.utils.uniqueFunc", "unique_name", 0.75),
    (["test.utils.uniqueFunc"], "uniqueFunc", "test.other", ["x"], ["test.foo"], "test.utils.uniqueFunc", "unique_name", 0.375),
    (["test.auth.handle", "test.middleware.handle"], "handle", "test.handler", ["auth"], ["test.auth"], "test.auth.handle", "suffix_match", None),
    (["test.auth.validate", "test.payment.validate"], "auth.validate", "test.handler", [], [], "test.auth.validate", "qualified_suffix", 0.90),
    (["test.foo"], "nonexistent", "test.x", [], [], "", "", 0.0),
    ([f"test.pkg{k}.handle" for k in range(300)], "handle", "test.x", [], [], "", "", 0.0),
    (["test.lib.square"], "lib::square", "test.main", ["lib"], ["test.lib"], "test.lib.square", "import_map", 0.95),
    (["test.auth.TestHandle", "test.auth.handle"], "handle", "x", [], [], "test.auth.handle", None, None),
    (["test.auth.sub.helper", "test.payment.helper"], "helper", "test.auth.other", [], [], "test.auth.sub.helper", None, None),
]


@pytest.mark.parametrize("case", GOLDEN, ids=range(len(GOLDEN)))
def test_call_resolution(spark, case):
    qns, callee, module, keys, vals, want, strategy, confidence = case
    reg = spark.createDataFrame([(k, q.split(".")[-1], q, "Function") for k, q in enumerate(qns)], REG).coalesce(1)
    call = spark.createDataFrame([(1, callee, module, keys, vals)], CALL).coalesce(1)
    got = resolve.resolve_calls(call, reg).first()
    assert got.qualified_name == want
    assert strategy is None or got.strategy == strategy
    assert confidence is None or abs(got.confidence - confidence) < 1e-9


def test_fuzzy_resolution(spark):
    reg = spark.createDataFrame([(0, "u", "test.utils.u", "Function"), (1, "h", "test.auth.h", "Function"), (2, "h", "test.mid.h", "Function")], REG)
    calls = spark.createDataFrame([(1, "u", "m", [], []), (2, "h", "m", ["a"], ["test.auth"])], CALL)
    got = {r.call_id: (r.qualified_name, r.confidence) for r in resolve.fuzzy_resolve(calls, reg).collect()}
    assert got == {1: ("test.utils.u", 0.40), 2: ("test.auth.h", 0.30)}


def test_trace_cycles_self_loops_and_cut_points(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("b", "b", "CALLS"), ("a", "t", "CALLS"), ("t", "z", "CALLS"), ("x", "a", "CALLS")], "source_id string, target_id string, type string")
    root = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in trace.trace(e, root, 3).collect()} == {("b", 1), ("c", 2), ("t", 1), ("z", 2)}
    allowed = spark.createDataFrame([(i,) for i in "abczx"], "id string")
    assert {r.id for r in trace.trace(e, root, 3, allowed=allowed).collect()} == {"b", "c"}
    both = {(r.id, r.direction) for r in trace.trace(e, root, 1, "both").collect()}
    assert both == {("c", "inbound"), ("x", "inbound"), ("b", "outbound"), ("t", "outbound")}


def test_extraction_routes_and_resources(spark):
    files = [
        ("p", "src/auth.ts", "export function validateUser(n: string) {\n    return hashPassword(n);\n}\nfunction hashPassword(p: string) {\n    return p;\n}\n"),
        ("p", "src/handler.ts", "import { validateUser } from './auth';\nexport function handleLogin(n: string) {\n    validateUser(n);\n}\napp.get('/users/${id}', handleLogin);\n"),
        ("p", "m.py", "class MyClass:\n    def greet(self):\n        return hello()\n\ndef hello():\n    return 1\n"),
        ("p", "bad.py", "def ("), ("p", "x.unknown", "zz"), ("p", "n.ts", None),
    ]
    facts = extract.file_facts(spark.createDataFrame(files, "project string, path string, content string"))
    nodes, registry, calls = extract.graph_of(facts)
    names = {r.qualified_name: r.label for r in nodes.collect()}
    assert names["p.src.auth.validateUser"] == "Function" and names["p.m.MyClass.greet"] == "Method"
    edges = extract.call_edges(calls, resolve.resolve_calls(calls, registry), nodes)
    by_id = {r.id: r.qualified_name for r in nodes.collect()}
    pairs = {(by_id[r.source_id], by_id[r.target_id]): r.properties for r in edges.collect()}
    assert '"crossFile":true' in pairs["p.src.handler.handleLogin", "p.src.auth.validateUser"]
    assert ("p.m.MyClass.greet", "p.m.hello") in pairs and ("p.src.auth.validateUser", "p.src.auth.hashPassword") in pairs
    assert [(r.label, r.name, r.detail) for r in facts.where("kind = 'route'").collect()] == [("GET", "/users/:param", "handleLogin")]
    every, links = extract.graph_rows(facts)
    named = {r.id: (r.label, r.name) for r in every.collect()}
    kinds = {(r.type, named[r.source_id], named[r.target_id]) for r in links.collect()}
    assert ("HANDLES", ("Route", "GET /users/:param"), ("Function", "handleLogin")) in kinds
    assert ("IMPORTS", ("Function", "handleLogin"), ("Module", "./auth")) in kinds


def test_calls_stay_in_their_project(spark):
    files = [("a", "m.py", "def run():\n    return helper()\n"), ("b", "h.py", "def helper():\n    return 1\n"), ("b", "m.py", "def run():\n    return helper()\n")]
    files += [(f"x{k}", "h.py", "def helper():\n    return 1\n") for k in range(300)]  # one each, so no name is crowded
    facts = extract.file_facts(spark.createDataFrame(files, "project string, path string, content string"))
    nodes, registry, calls = extract.graph_of(facts)
    edges = extract.call_edges(calls, resolve.resolve_calls(calls, registry), nodes)
    assert [r.project for r in edges.collect()] == ["b"]


def test_resources(spark):
    docker = "FROM base:1\nENV A=1\n\nEXPOSE 80\n"
    manifest = "kind: Service\nmetadata:\n  name: web\n---\nkind: Job\nmetadata:\n  name: web\n"
    rows = [("p", "svc/Dockerfile", docker), ("q", "svc/Dockerfile", docker), ("p", "k8s/a.yaml", manifest), ("p", "a.py", "x = 1"), ("p", "b.yml", None)]
    nodes, edges = extract.resource_rows(spark.createDataFrame(rows, "project string, path string, content string"))
    names = {r.id: (r.project, r.name) for r in nodes.collect()}
    assert sorted(n for p, n in names.values() if p == "p") == ["ENV A=1", "EXPOSE 80", "FROM base:1", "Job/web", "Service/web"]
    assert {(names[r.source_id], names[r.target_id]) for r in edges.where("project = 'p'").collect()} == {(("p", "FROM base:1"), ("p", "ENV A=1")), (("p", "ENV A=1"), ("p", "EXPOSE 80"))}
    assert '"baseImage":"base"' in nodes.where("name = 'FROM base:1'").first().properties


def test_code_search_uses_each_node_once(spark):
    files = spark.createDataFrame([("d/f.py", "a hit\nb hit\nc\nd HIT\n"), ("d/g.py", None), ("d/h.py", "")], "path string, content string")
    nodes = spark.createDataFrame([(7, "outer", "Function", "d/f.py", 1, 3)], "id long, name string, label string, file_path string, start_line int, end_line int")
    rows, totals = search.search_code(files, nodes, "hit")
    assert [(r.line, r.node_id, r.name, r.label) for r in rows.collect()] == [(1, "7", "outer", "Function"), (4, "-1", "f.py", "File")]
    assert totals == {"matches": 3, "results": 2}
    assert search.search_code(files, nodes, "HIT$", regex=True)[1] == {"matches": 1, "results": 1}


def test_impacted_paths_and_routes(spark):
    n = spark.createDataFrame([(1, "/root/src/a.py"), (2, "src/a.py"), (3, "xsrc/a.py"), (4, "b.py")], "id int, file_path string")
    changed = spark.createDataFrame([("src/a.py",), ("SRC/A.py",)], "file_path string")
    assert {r.id for r in search.impacted(n, changed).collect()} == {1, 2}
    routes = spark.createDataFrame([("p", "Route", f"GET /{k}") for k in range(7)] + [("p", "Class", "A")], "project string, label string, name string")
    assert [tuple(r) for r in search.route_summary(routes, 2).collect()] == [("p", 7, "GET /0; GET /1")]


def test_properties_search_and_tables(spark):
    one = spark.range(1).select(tables.merge_properties(F.lit('{"status":"proposed","a":"1"}'), F.lit('{"status":"accepted"}')).alias("p")).first().p
    assert '"accepted"' in one and '"a":"1"' in one and "proposed" not in one
    n = spark.createDataFrame([(1, "main_loop", "x.main_loop"), (2, "mainXloop", "y")], "id int, name string, qualified_name string")
    assert [r.id for r in search.find_nodes(n, name="main_").collect()] == [1]
    with pytest.raises(ValueError):
        search.cypher(n, "DELETE everything")
    assert [r.id for r in trace.resolve_root(n, "main").collect()] == [2]
    lines = spark.createDataFrame([("f", 3), ("f", 50), ("g", 1)], "path string, line int")
    spans = spark.createDataFrame([(7, "f", 1, 10), (8, "f", 2, 4)], "id int, file_path string, start_line int, end_line int")
    assert {(r.path, r.line, r.node_id) for r in search.smallest_node(lines, spans).collect()} == {("f", 3, "8"), ("f", 50, "-1"), ("g", 1, "-1")}
    slug = spark.range(1).select(text.adr_slug(F.lit("Use PostgreSQL for storage!"))).first()[0]
    assert slug == "use-postgresql-for-storage"
