"""Stored full-text and vector indexes, chunk caps, splitters, retries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlode.functions import text
from siftlode.operators import chunking, retrieval
from siftlode.operators.embedding import HashingEmbedder, Retrying, detected_dimension
from siftlode.operators.fulltext import FullTextIndex


def test_stored_index_equals_a_scan(spark, tmp_path):
    rows = [(k, f"word{k % 7} naïve Straße {'red ' * (k % 3)}", f"Title{k % 5}") for k in range(60)] + [(100, None, None), (101, "", "!"), (102, "東京 data", "")]
    df = spark.createDataFrame(rows, "id int, content string, title string")
    index = FullTextIndex(spark, f"file://{tmp_path}/t", 4)
    assert not index.exists()
    with pytest.raises(LookupError):
        index.search("x")
    index.build(df, "id", {"content": 1.0})
    for query in ("red word3", "naive", "straße 東京", "", "missing"):
        assert index.search(query, 20).collect() == retrieval.bm25_topk(df, query, 20).collect()
    first = index.search("red", 15).collect()
    assert index.search("red", 5, 10).collect() == first[10:15]
    index.build(df.where("id < 10"), "id", {"content": 1.0, "title": 3.0})
    again = FullTextIndex(spark, f"file://{tmp_path}/t", 4)
    weighted = retrieval.bm25_topk(df.where("id < 10"), "title3 red", 5, weights={"content": 1.0, "title": 3.0}).collect()
    assert again.search("title3 red", 5).collect() == weighted and len(list((tmp_path / "t").glob("*.done"))) == 1
    assert FullTextIndex(spark, f"file://{tmp_path}/u", 2).build(df.limit(0), "id", {"content": 1.0}).search("red").count() == 0


def test_a_search_reads_its_terms_only(spark, tmp_path):
    df = spark.createDataFrame([(k, f"term{k}") for k in range(50)], "id int, content string")
    index = FullTextIndex(spark, f"file://{tmp_path}/t", 8).build(df, "id", {"content": 1.0})
    plan = index.search("term3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    assert "bucket" in plan.split("PartitionFilters")[1][:80]


def test_words():
    assert text.words_of("Café-Straße, naïve_x 東京 ①x") == ["cafe", "straße", "naive", "x", "東京", "①x"]
    assert text.search_words("readFileSync my.module/path") == ["read", "file", "sync", "my", "module", "path"]


def test_inverted_file_recall(spark, tmp_path):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((40, 32))
    x = np.repeat(centre, 50, axis=0) + 0.4 * rng.standard_normal((2000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None)], "id int, vector array<float>")
    index = retrieval.InvertedFile(cells=16).fit(df, "id", "vector")
    placed = index.store(df, f"file://{tmp_path}/cells", "vector")
    assert placed.count() == 2001
    got = {}
    for r in index.search_many(placed, df.where("id % 100 = 0"), 10, 5, "id", "vector").collect():
        got.setdefault(r.query_id, set()).add(r.id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    hits = sum(len(got[q] & set(np.argsort(-s[q])[:10].tolist())) for q in range(0, 2000, 100))
    assert hits / 200 >= 0.9
    assert index.search(placed, x[3].tolist(), 1, 1, "id", "vector").first().id == 3


def test_caps_keep_whole_files(spark):
    rows = [(f"f{k:02d}", j) for k in range(20) for j in range(k % 4 + 1)]
    df = spark.createDataFrame(rows, "path string, seq int")
    kept, left = chunking.capped(df, 12)
    assert kept.count() <= 12 and {r.path for r in kept.collect()} | {r.path for r in left.collect()} == {r[0] for r in rows}
    assert not {r.path for r in kept.collect()} & {r.path for r in left.collect()}
    assert chunking.capped(df, 1)[0].count() == 1 and chunking.capped(df.where("path = 'f03'"), 1)[0].count() == 4  # the first is kept whole
    assert chunking.capped(df, 10**6)[1].count() == 0 and chunking.capped(df.limit(0), 5)[0].count() == 0


def test_any_splitter(spark):
    class Halves:
        def split(self, text, language):
            n = len(text) // 2
            return [(text[:n], 1, 1), (text[n:], 1, 1)]

    df = spark.createDataFrame([("a", None, "abcd"), ("b", "PY", "def f():\n    pass\n\ndef g():\n    pass\n"), ("c", "js", "function f() {\n  return 1;\n}\n"), ("d", "text", "x\n\ny"), ("e", "py", None)], "path string, language string, content string")
    assert [(r.path, r.content) for r in chunking.chunk_files(df.where("path = 'a'"), Halves()).collect()] == [("a", "ab"), ("a", "cd")]
    got = {(r.path, r.start_line, r.end_line) for r in chunking.chunk_files(df).collect()}
    assert got == {("a", 1, 1), ("b", 1, 2), ("b", 4, 5), ("c", 1, 3), ("d", 1, 3)}
    assert [text.SPLITTABLE[n] for n in ("c++", "rs", "cs")] == ["cpp", "rust", "csharp"]


def test_retries():
    class Busy:
        dimension = 2

        def __init__(self, failures):
            self.failures = failures

        def embed_batch(self, texts):
            if self.failures:
                error = RuntimeError("busy")
                error.status = self.failures.pop(0)
                raise error
            return [[1.0, 0.0]] * len(texts)

    waited = []
    assert Retrying(Busy([429, 500, 503]), sleep=waited.append).embed_batch(["a"]) == [[1.0, 0.0]] and waited == [1, 2, 4]
    with pytest.raises(RuntimeError):
        Retrying(Busy([500] * 4), sleep=waited.append).embed_batch(["a"])
    waited.clear()
    with pytest.raises(RuntimeError):
        Retrying(Busy([400]), sleep=waited.append).embed_batch(["a"])
    assert waited == [] and detected_dimension(HashingEmbedder(24)) == 24


def test_rows_over_a_threshold_are_not_cut(spark):
    df = spark.range(200).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    assert retrieval.dense_topk(df, [1.0, 0.0], None, threshold=0.5).count() == 200
