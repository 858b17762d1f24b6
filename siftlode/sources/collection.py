"""Collections of chunks with vectors, as Parquet tables partitioned by project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, vector array<float>, content string, relative_path string, start_line long, end_line long, file_extension string, metadata string, project string"
#: The widest text each column holds.
LIMITS = {"id": 512, "content": 65535, "relative_path": 1024, "file_extension": 32, "metadata": 65535}


class CollectionCatalog:
    """Tables of one schema under a folder; a change of a project replaces its partition in one overwrite."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))

    def create(self, name: str, hybrid: bool = False) -> None:
        """Make an empty collection, of vectors or of vectors and words (see ``FullTextIndex``)."""
        if hybrid:
            self._fs.create(self._hadoop(f"_{name}.hybrid"), True).close()
        if not self.has(name):
            self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").partitionBy("project").parquet(self._path(name))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(name))

    def drop(self, name: str) -> bool:
        self._fs.delete(self._hadoop(f"_{name}.hybrid"), False)
        return self._fs.delete(self._hadoop(name), True)

    def list(self, prefix: str = "") -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self._fs.exists(root):
            return []
        return sorted(n for s in self._fs.listStatus(root) if (n := s.getPath().getName()).startswith(prefix) and not n.startswith("_"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self._path(name))

    def count(self, name: str) -> int:
        return self.read(name).count() if self.has(name) else -1

    def query(self, name: str, where: Column | str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Filter and columns reach the Parquet scan; a limit is taken in order of id."""
        rows = self.read(name)
        rows = rows if where is None else rows.where(where)
        rows = rows.select(*columns) if columns else rows
        return rows.orderBy("id").limit(limit) if limit is not None else rows

    def insert(self, name: str, rows: DataFrame, dimension: int | None = None) -> None:
        """Append checked rows: texts within their limits, vectors of one length."""
        problem = F.lit(None).cast("string")
        for c, n in LIMITS.items():
            problem = F.coalesce(problem, F.when(F.length(c) > n, F.lit(f"{c} is longer than {n}")))
        if dimension:
            problem = F.coalesce(problem, F.when(F.coalesce(F.size("vector"), F.lit(-1)) != dimension, F.lit(f"a vector is not of length {dimension}")))
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        checked = F.when(problem.isNull(), F.col("id")).otherwise(F.raise_error(problem))
        rows.withColumn("id", checked).select(*cols).write.mode("append").partitionBy("project").parquet(self._path(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put ``rows`` in the place of all rows of the projects in it."""
        cols = [c.split()[0] for c in SCHEMA.split(", ")]
        rows.select(*cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(self._path(name))

    def put(self, name: str, project: str, rows: DataFrame) -> None:
        """Put ``rows``, all of one project, in the place of its rows; no rows leave none."""
        if rows.isEmpty():
            self._fs.delete(self._hadoop(f"{name}/{self._folder(project)}"), True)
        else:
            self.replace(name, rows)

    def _folder(self, project: str) -> str:
        return f"project={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)}"

    def describe(self, name: str) -> dict:
        """The columns, the number of rows and the kind of a collection."""
        return {"name": name, "columns": [f.name for f in self.read(name).schema.fields], "rows": self.count(name), "kind": self.kind(name)}

    def kind(self, name: str) -> str:
        return "hybrid" if self._fs.exists(self._hadoop(f"_{name}.hybrid")) else "dense"

    def delete(self, name: str, ids: DataFrame) -> None:
        """Remove rows by (project, id); only the partitions of those projects are written again."""
        from siftlode.runtime import cut

        projects = ids.select("project").distinct()
        touched = self.read(name).join(projects, "project", "left_semi")
        kept = cut(touched.join(ids.select("project", "id").distinct(), ["project", "id"], "left_anti"), "kept")
        emptied = projects.join(kept.select("project").distinct(), "project", "left_anti").collect()  # partitions left without rows
        self.replace(name, kept)
        for r in emptied:
            self._fs.delete(self._hadoop(f"{name}/{self._folder(r['project'])}"), True)


def document_rows(chunks: DataFrame, project: str) -> DataFrame:
    """Chunks (path, content, start_line, end_line, language, chunk_index, vector) as rows of a collection."""
    from siftlode.functions.text import chunk_id, extension

    p = F.col("path")
    meta = F.to_json(F.struct(F.lit(project).alias("codebasePath"), "language", F.col("chunk_index").alias("chunkIndex")))
    return chunks.select(
        chunk_id(p, F.col("start_line"), F.col("end_line")).alias("id"), "vector", "content", p.alias("relative_path"), F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"), extension(p).alias("file_extension"), meta.alias("metadata"), F.lit(project).alias("project"),
    )
