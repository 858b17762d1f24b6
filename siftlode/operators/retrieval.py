"""Dense, sparse and hybrid retrieval.

Ranked results are ``orderBy(...).limit(k)`` with a total order, so Spark keeps k rows a task and no sort shuffles the
corpus. Filters come before scores. Document statistics are aggregates with partial counts; a query's terms are a
literal list, so only their postings are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions import text, vectors
from siftlode.runtime import hashed_sample


def dense_topk(docs: DataFrame, query, k: int | None = 10, id_col: str = "id", vector_col: str = "vector", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(id, score): the k rows most similar to a query vector by cosine, ties to the smaller id.

    A null vector scores null and is left out; a zero vector scores 0. An empty table gives no rows. With k None all
    rows of the threshold or more are given, in no order.
    """
    rows = docs if where is None else docs.where(where)
    scored = rows.select(F.col(id_col), F.round(vectors.cosine(F.col(vector_col), vectors.literal(query)), 6).alias("score")).where("score is not null")
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored if k is None else scored.orderBy(F.desc("score"), id_col).limit(k)


def dense_topk_per_group(docs: DataFrame, query, group_col: str, k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(group, id, score, rank): the k best of each group; Spark limits groups before the shuffle."""
    scored = docs.select(group_col, id_col, F.round(vectors.cosine(F.col(vector_col), vectors.literal(query)), 6).alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


class InvertedFile:
    """An approximate index: vectors in the cells of centroids; a search reads the ``probes`` nearest cells.

    The centroids are fitted on at most ``sample`` vectors; every vector is placed in a cell, null vectors in none.
    With all cells probed a search is exact. Recall against an exact search is measured in the tests.
    """

    def __init__(self, cells: int = 32, sample: int = 10_000, seed: int = 1, rounds: int = 8):
        self.cells, self.sample, self.seed, self.rounds = cells, sample, seed, rounds
        self.centroids = np.empty((0, 0))

    def fit(self, docs: DataFrame, id_col: str, vector_col: str) -> InvertedFile:
        drawn = hashed_sample(docs.where(F.col(vector_col).isNotNull()).select(id_col, vector_col), id_col, self.sample).toPandas()[vector_col]
        width = max((len(v) for v in drawn), default=0)
        usable = [np.asarray(v, float) for v in drawn if len(v) == width]
        if not usable:
            return self
        x = np.stack(usable)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[np.random.default_rng(self.seed).choice(len(x), min(self.cells, len(x)), replace=False)]
        for _ in range(self.rounds):
            near = (x @ c.T).argmax(axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].mean(axis=0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        self.centroids = c
        return self

    def assign(self, docs: DataFrame, vector_col: str) -> DataFrame:
        """``docs`` with a column ``cell``, by one matrix product a batch; store it by cell (see ``store``)."""
        centroids = self.centroids

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            good = np.array([x is not None and len(x) == centroids.shape[1] for x in v], bool)
            out = np.full(len(v), -1)
            if good.any():
                out[good] = (np.stack(list(v[good])).astype(float) @ centroids.T).argmax(axis=1)
            return pd.Series(out)

        cell = nearest(F.col(vector_col)) if len(centroids) else F.lit(-1)
        return docs.withColumn("cell", F.when(F.col(vector_col).isNull(), F.lit(-1)).otherwise(cell))

    def store(self, docs: DataFrame, path: str, vector_col: str) -> DataFrame:
        """Write the placed rows in a folder a cell, so that a search reads the probed folders only; gives the table."""
        placed = self.assign(docs, vector_col)
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
        return docs.sparkSession.read.schema(placed.schema).parquet(path)

    def cells_of(self, query, probes: int) -> list[int]:
        """The nearest cells of a query, best first."""
        return [int(c) for c in np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[:probes]] if len(self.centroids) else []

    def search(self, placed: DataFrame, query, k: int, probes: int, id_col: str, vector_col: str) -> DataFrame:
        return dense_topk(placed.where(F.col("cell").isin(self.cells_of(query, probes))), query, k, id_col, vector_col)

    def search_many(self, placed: DataFrame, queries: DataFrame, k: int, probes: int, id_col: str, vector_col: str) -> DataFrame:
        """(query_id, id, score, rank) of a stated set of queries (id and vector columns as in ``placed``), against all rows of their cells."""
        centroids = self.centroids

        @F.pandas_udf("array<int>")
        def cells(v: pd.Series) -> pd.Series:
            return pd.Series([np.argsort(-(centroids @ np.asarray(x, float)), kind="stable")[:probes].tolist() for x in v])

        asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("__q"), F.explode(cells(F.col(vector_col))).alias("cell"))
        met = placed.select(id_col, vector_col, "cell").join(asked, "cell").where(F.col(id_col) != F.col("query_id"))
        scored = met.select("query_id", id_col, F.round(vectors.cosine(F.col(vector_col), F.col("__q")), 6).alias("score")).where("score is not null")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, dl): term counts with each document's length in words; texts without words give no rows."""
    t = docs.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_topk(docs: DataFrame, query: str, k: int = 10, id_col: str = "id", text_col: str = "content", k1: float = 1.2, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, score): BM25 over one column, or over several with ``weights`` by column (term counts are weighted).

    Documents count if they hold any word. A query without words gives no rows.
    """
    terms = sorted(set(text.words_of(query)))
    cols = weights or {text_col: 1.0}
    words = docs.select(F.col(id_col), *[text.tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"w{i}") for i, c in enumerate(cols)])
    arrays = [(F.col(f"w{i}"), w) for i, w in enumerate(cols.values())]
    lengths = [F.size(a) * F.lit(w) for a, w in arrays]
    counts = []
    for i, term in enumerate(terms):
        each = [(F.size(a) - F.size(F.array_remove(a, term))) * F.lit(w) for a, w in arrays]
        counts.append(sum(each[1:], each[0]).cast("double").alias(f"tf{i}"))
    rows = words.select(F.col(id_col), sum(lengths[1:], lengths[0]).cast("double").alias("dl"), *counts).where("dl > 0")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    joined = rows.crossJoin(F.broadcast(stats))  # the statistics are one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.select(id_col, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, id_col: str = "id", name: str = "rank") -> DataFrame:
    """A hit list of at most a few rows (a top k) with ranks from 1, by score, then id."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 10, constant: int = 100, id_col: str = "id") -> DataFrame:
    """(id, score, dense_rank, sparse_rank): reciprocal rank fusion of two top-k lists, each cut before fusing."""
    d = ranked(dense, id_col, "dense_rank").select(id_col, "dense_rank")
    s = ranked(sparse, id_col, "sparse_rank").select(id_col, "sparse_rank")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
    fused = d.join(s, id_col, "full_outer")
    return fused.select(id_col, F.round(part("dense_rank") + part("sparse_rank"), 9).alias("score"), "dense_rank", "sparse_rank").orderBy(F.desc("score"), id_col).limit(k)


def weighted_fusion(dense: DataFrame, sparse: DataFrame, weight: float = 0.5, k: int = 10, id_col: str = "id") -> DataFrame:
    """(id, score): a weighted sum of both scores, each divided by its list's maximum."""
    scaled = lambda df, n: df.select(id_col, (F.col("score") / F.max("score").over(Window.partitionBy())).alias(n))
    both = scaled(dense, "d").join(scaled(sparse, "s"), id_col, "full_outer")
    score = F.lit(weight) * F.coalesce("d", F.lit(0.0)) + F.lit(1 - weight) * F.coalesce("s", F.lit(0.0))
    return both.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def drop_overlaps(hits: DataFrame, share: float | None = 0.5, file_col: str = "file", id_col: str = "id", start_col: str = "start_line", end_col: str = "end_line", rank_col: str = "rank") -> DataFrame:
    """Hits in rank order without those that overlap a kept one of the same file.

    With ``share`` a hit goes if more than that share of its lines is covered by a kept one; with None if any line is.
    A top-k list bounds how many hits a file has.
    """
    item = F.struct(F.col(rank_col).alias("r"), F.col(id_col).alias("i"), F.col(start_col).alias("s"), F.col(end_col).alias("e"))
    per_file = hits.groupBy(file_col).agg(F.array_sort(F.collect_list(item)).alias("hits"))

    def hides(kept: Column, x: Column) -> Column:
        if share is None:
            return (kept["s"] <= x["e"]) & (kept["e"] >= x["s"])
        return text.overlap_share(x["s"], x["e"], kept["s"], kept["e"]) > share

    kept = F.aggregate("hits", F.slice(F.col("hits"), 1, 0), lambda acc, x: F.when(F.exists(acc, lambda q: hides(q, x)), acc).otherwise(F.concat(acc, F.array(x))))
    out = per_file.select(file_col, F.explode(kept).alias("h"))
    return out.select(F.col("h.r").alias(rank_col), F.col("h.i").alias(id_col), file_col, F.col("h.s").alias(start_col), F.col("h.e").alias(end_col))
