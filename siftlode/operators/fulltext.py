"""A stored full-text index: postings by term, so that a search reads its terms' rows and not the texts.

Under a folder: ``postings`` (term, id, tf, dl) in folders by a hash of the term and sorted by it, so that a search
reads one folder a term and in it the row groups that may hold the term; ``terms`` (term, df) the same way; ``stats``
(n, avgdl), one row. A new build is written beside the old one and counts once its marker exists, so readers never see
half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions import text


class FullTextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._current: tuple[str, str, int, float] | None = None

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def build(self, docs: DataFrame, id_col: str, fields: dict[str, float]) -> FullTextIndex:
        """Index the columns of ``fields`` with their weights: a term's count in a column counts that many times.

        Null and empty texts have no words; documents without any are not counted.
        """
        build = uuid.uuid4().hex
        words = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(text.tokens(F.coalesce(F.col(c), F.lit(""))).alias("t"), F.lit(float(w)).alias("w")) for c, w in fields.items()])).alias("f"))
        counted = words.select("id", "f.w", F.explode("f.t").alias("term")).groupBy("id", "term").agg(F.sum("w").alias("tf"))
        lengths = words.select("id", (F.size("f.t") * F.col("f.w")).alias("l")).groupBy("id").agg(F.sum("l").alias("dl")).where("dl > 0")
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        rows = counted.join(lengths, "id").withColumn("bucket", bucket)
        where = f"{self.path}/{build}"
        sorted_ = rows.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "id")
        sorted_.write.partitionBy("bucket").parquet(f"{where}/postings")
        stored = self.spark.read.schema("term string, bucket int").parquet(f"{where}/postings")
        stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{where}/terms")
        lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")).coalesce(1).write.parquet(f"{where}/stats")
        marker = self._fs().create(self._at(f"{build}.done"), True)  # it holds the type of the ids
        marker.write(bytearray(dict(docs.dtypes)[id_col].encode()))
        marker.close()
        for status in self._fs().listStatus(self._at("")):  # older builds
            name = status.getPath().getName()
            if name.removesuffix(".done") != build:
                self._fs().delete(status.getPath(), True)
        self._current = None
        return self

    def exists(self) -> bool:
        return self._open() is not None

    def _open(self) -> tuple[str, str, int, float] | None:
        """(folder, type of the ids, n, avgdl) of the last complete build."""
        if self._current is None and self._fs().exists(self._at("")):
            done = [s.getPath().getName() for s in self._fs().listStatus(self._at("")) if s.getPath().getName().endswith(".done")]
            if done:
                folder = f"{self.path}/{done[0].removesuffix('.done')}"
                row = self.spark.read.schema("n long, avgdl double").parquet(f"{folder}/stats").first()
                stream = self._fs().open(self._at(done[0]))
                kind = bytes(stream.readAllBytes()).decode()
                stream.close()
                self._current = (folder, kind, row["n"], row["avgdl"])
        return self._current

    def scores(self, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of all documents that hold any of the terms, by BM25."""
        opened = self._open()
        if opened is None:
            raise LookupError(f"no index under {self.path}")
        folder, kind, n, avgdl = opened
        terms = sorted(set(terms))
        of = {r[0]: r[1] for r in self.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.pmod(F.xxhash64(F.lit(t)), F.lit(self.buckets)).cast("int").alias("b")) for t in terms])).alias("x")).select("x.t", "x.b").collect()} if terms else {}
        mine = F.col("bucket").isin(sorted(set(of.values()))) & F.col("term").isin(terms)
        df = {r["term"]: r["df"] for r in self.spark.read.schema("term string, df long, bucket int").parquet(f"{folder}/terms").where(mine).collect()} if terms else {}
        postings = self.spark.read.schema(f"id {kind}, term string, tf double, dl double, bucket int").parquet(f"{folder}/postings").where(mine)
        idf = F.lit(0.0)
        for t, d in df.items():
            idf = F.when(F.col("term") == t, F.lit(d)).otherwise(idf)
        part = F.log(1 + (F.lit(n) - idf + 0.5) / (idf + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl or 1.0)))
        return postings.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))

    def search(self, query: str, k: int = 10, offset: int = 0, camel: bool = False) -> DataFrame:
        """(id, score): the best documents, ties to the smaller id. ``camel`` splits names at capitals, as node search does."""
        terms = text.search_words(query) if camel else text.words_of(query)
        return self.scores(terms).where("score > 0").orderBy(F.desc("score"), "id").offset(offset).limit(k)
