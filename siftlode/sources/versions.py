"""A table of which only whole versions are seen: a write makes a new one beside the old and then removes that."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions are folders ``v<number>``; one counts once Spark has put its _SUCCESS mark there, the greatest is read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, complete: bool) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        found = sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return [n for n in found if not complete or self._fs.exists(self._at(f"v{n}/_SUCCESS"))]

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def read(self, schema: str) -> DataFrame:
        """The last whole version, an empty table if there is none."""
        done = self._numbers(True)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{done[-1]}") if done else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame) -> None:
        """Write a version; ``rows`` may read the one before."""
        last = max(self._numbers(False), default=0)
        rows.write.parquet(f"{self.path}/v{last + 1}")
        for n in self._numbers(False):
            if n <= last:
                self._fs.delete(self._at(f"v{n}"), True)

    def clear(self) -> None:
        self._fs.delete(self._root, True)
