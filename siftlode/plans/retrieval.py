"""Retrieval queries: the corpus is ``documents``, the vectors ``embeddings`` (vec_id stands for doc_id)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftlode.functions.text import MARKED, UNMARKED
from siftlode.operators import retrieval as r
from siftlode.operators.fulltext import FullTextIndex
from siftlode.runtime import table, work_dir

WORDS = "index search token graph"


def _vectors(spark, d):
    return table(spark, d, "embeddings")


def _query(spark, d):
    return _vectors(spark, d).where("vec_id = 0").first()["embedding"]


def dense_topk(spark, d):
    return r.dense_topk(_vectors(spark, d), _query(spark, d), 10, "vec_id", "embedding")


def dense_topk_filtered(spark, d):
    return r.dense_topk(_vectors(spark, d), _query(spark, d), 10, "vec_id", "embedding", where=F.col("label").isin(1, 2, 3))


def dense_topk_per_label(spark, d):
    return r.dense_topk_per_group(_vectors(spark, d), _query(spark, d), "label", 3, "vec_id", "embedding")


def dense_threshold(spark, d):
    """All vectors of a similarity of 0.1 or more."""
    return r.dense_topk(_vectors(spark, d), _query(spark, d), None, "vec_id", "embedding", threshold=0.1)


def dense_inverted_file(spark, d):
    """The ten nearest of every vector whose id is divisible by 100, by an index of 16 cells of which 6 are probed."""
    v = _vectors(spark, d)
    index = r.InvertedFile(cells=16).fit(v, "vec_id", "embedding")
    placed = index.store(v, f"{work_dir(spark)}/cells-{uuid.uuid4().hex}", "embedding")
    return index.search_many(placed, v.where("vec_id % 100 = 0"), 10, 6, "vec_id", "embedding")


_TERMS: dict[tuple[str, str], FullTextIndex] = {}


def terms(spark, d):
    """The stored index over the documents, built once an application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TERMS:
        path = f"{work_dir(spark)}/terms-{len(_TERMS)}"
        _TERMS[key] = FullTextIndex(spark, path).build(table(spark, d, "documents").dropDuplicates(["doc_id"]), "doc_id", {"text": 1.0})
    return _TERMS[key]


def bm25_topk(spark, d):
    return terms(spark, d).search(WORDS, 20).withColumnRenamed("id", "doc_id")


def bm25_page(spark, d):
    """The third page of twenty."""
    return terms(spark, d).search(WORDS, 20, 40).withColumnRenamed("id", "doc_id")


def bm25_scan(spark, d):
    """The same without an index, by reading all texts."""
    return r.bm25_topk(table(spark, d, "documents"), WORDS, 20, "doc_id", "text")


def bm25_weighted_fields(spark, d):
    return r.bm25_topk(table(spark, d, "part"), "steel brand widget large small", 20, "p_partkey", weights={"p_name": 1.0, "p_brand": 2.0, "p_type": 0.5})


def postings(spark, d):
    return r.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _lists(spark, d):
    dense = r.dense_topk(_vectors(spark, d), _query(spark, d), 20, "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    sparse = terms(spark, d).search(WORDS, 20)
    return dense, sparse


def hybrid_rrf(spark, d):
    return r.rrf(*_lists(spark, d), k=10)


def hybrid_weighted(spark, d):
    return r.weighted_fusion(*_lists(spark, d), k=10)


def _ranked_chunks(spark, d):
    """The first chunks of each file of the test corpus, as a ranked hit list."""
    rows = table(spark, d, "vector_documents").where("start_line > 0 and end_line >= start_line").select(F.concat_ws("|", "project", "relative_path").alias("file"), F.col("vec_id").alias("id"), "start_line", "end_line").distinct()
    wide = rows.unionByName(rows.select("file", (F.col("id") + 1_000_000_000).alias("id"), (F.col("start_line") + 3).alias("start_line"), (F.col("end_line") + 3).alias("end_line")))
    return wide.withColumn("rank", F.col("id"))


def overlap_dedup_half(spark, d):
    return r.drop_overlaps(_ranked_chunks(spark, d), 0.5).select("id", "file", "start_line", "end_line")


def overlap_dedup_any(spark, d):
    return r.drop_overlaps(_ranked_chunks(spark, d), None).select("id", "file", "start_line", "end_line")


_ALL = (dense_topk, dense_topk_filtered, dense_topk_per_label, dense_threshold, dense_inverted_file, bm25_topk, bm25_page, bm25_scan, bm25_weighted_fields, postings, hybrid_rrf, hybrid_weighted, overlap_dedup_half, overlap_dedup_any)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_COS = """
with q as (select embedding::double[] as v from embeddings where vec_id = 0),
s as (select vec_id, label, round(list_cosine_similarity(embedding::double[], q.v), 6) as score from embeddings, q)"""


def tokens_sql(column: str) -> str:
    """The words of a column: letters and digits of any script, in lower case, Latin letters without marks."""
    return f"list_filter(regexp_split_to_array(regexp_replace(translate(lower(coalesce({column}, '')), '{MARKED}', '{UNMARKED}'), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(table_name: str, key: str, fields: dict[str, float], words: str, k: int, offset: int = 0) -> str:
    tok = ", ".join(f"{tokens_sql(c)} as t{i}" for i, c in enumerate(fields))
    dl = " + ".join(f"len(t{i}) * {w}" for i, w in enumerate(fields.values()))
    terms = sorted(set(words.split()))
    tf = lambda t: " + ".join(f"len(list_filter(t{i}, lambda x: x = '{t}')) * {w}" for i, w in enumerate(fields.values()))
    cols = ", ".join(f"({tf(t)})::double as tf{j}" for j, t in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (tf{j} > 0) as df{j}" for j in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{j} + 0.5) / (df{j} + 0.5)) * tf{j} * 2.2 / (tf{j} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for j in range(len(terms)))
    return f"""
t as (select {key} as id, {tok} from {table_name}),
r as (select id, ({dl})::double as dl, {cols} from t), w as (select * from r where dl > 0),
st as (select count(*) as n, avg(dl) as avgdl, {dfs} from w),
b as (select id, round({score}, 6) as score from w, st),
bm as (select * from b where score > 0 order by score desc, id limit {k} offset {offset})"""


def _greedy(hides: str) -> str:
    """Chunks of each file in order of rank, each kept unless ``hides`` holds for it (x) and a kept one (y)."""
    return f"""
with recursive v as (select distinct concat_ws('|', project, relative_path) as file, vec_id as id, start_line as s, end_line as e from vector_documents where start_line > 0 and end_line >= start_line),
u as (select * from v union all select file, id + 1000000000, s + 3, e + 3 from v),
f as (select file, list({{'id': id, 's': s, 'e': e}} order by id) as hits from u group by 1),
g(file, hits, i, kept) as (
  select file, hits, 0::bigint, [{{'id': 0::bigint, 's': 0::bigint, 'e': 0::bigint}}][1:0] from f
  union all
  select file, hits, i + 1, case when len(list_filter(kept, lambda y: {hides.replace("x.", "hits[i + 1].")})) > 0 then kept else list_append(kept, hits[i + 1]) end from g where i < len(hits)),
k as (select file, unnest(kept) as h from g where i = len(hits))
select h.id as id, file, h.s as start_line, h.e as end_line from k"""


_DOC_BM = bm25_sql("documents", "doc_id", {"text": 1.0}, WORDS, 20)


def oracle_sql() -> dict[str, str]:
    top = "select vec_id, score from s {} order by score desc, vec_id limit {}"
    lists = _COS + ", dn as (select vec_id as id, score from s order by score desc, vec_id limit 20)," + _DOC_BM
    ranks = ", d as (select id, row_number() over (order by score desc, id) as dense_rank from dn), p as (select id, row_number() over (order by score desc, id) as sparse_rank from bm)"
    return {
        "dense_topk": _COS + top.format("", 10),
        "dense_topk_filtered": _COS + top.format("where label in (1, 2, 3)", 10),
        "dense_topk_per_label": _COS + "select label, vec_id, score, rank from (select *, row_number() over (partition by label order by score desc, vec_id) as rank from s) where rank <= 3",
        "dense_threshold": _COS + "select vec_id, score from s where score >= 0.1",
        "bm25_topk": "with " + _DOC_BM + " select id as doc_id, score from bm",
        "bm25_scan": "with " + _DOC_BM + " select id as doc_id, score from bm",
        "bm25_page": "with " + bm25_sql("documents", "doc_id", {"text": 1.0}, WORDS, 20, 40) + " select id as doc_id, score from bm",
        "bm25_weighted_fields": "with " + bm25_sql("part", "p_partkey", {"p_name": 1.0, "p_brand": 2.0, "p_type": 0.5}, "steel brand widget large small", 20) + " select id as p_partkey, score from bm",
        "postings": f"with t as (select doc_id, unnest({tokens_sql('text')}) as term from documents) select term, count(distinct doc_id) as df, count(*) as cf from t group by term",
        "overlap_dedup_half": _greedy("(greatest(0, least(x.e, y.e) - greatest(x.s, y.s) + 1) / greatest(1, x.e - x.s + 1)) > 0.5"),
        "overlap_dedup_any": _greedy("y.s <= x.e and y.e >= x.s"),
        "hybrid_rrf": lists + ranks + "select id, round(coalesce(1.0::double / (100 + dense_rank), 0) + coalesce(1.0::double / (100 + sparse_rank), 0), 9) as score, dense_rank, sparse_rank from d full join p using (id) order by score desc, id limit 10",
        "hybrid_weighted": lists + "select id, round(0.5 * coalesce(dn.score / (select max(score) from dn), 0) + 0.5 * coalesce(bm.score / (select max(score) from bm), 0), 6) as score from dn full join bm using (id) order by score desc, id limit 10",
    }
