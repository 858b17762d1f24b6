"""Processing only new or changed records.

Method: a run rereads from the position of the oldest transaction that was open at the last successful run, since a
record of such a transaction may have become visible late, and removes the overlap by an anti-join of
key-and-version pairs against the ledger of what was processed. A run that fails commits nothing, so the next one
starts from the same place: no record is skipped, none is applied twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.runtime import cut


def last_success(snapshots: DataFrame) -> DataFrame:
    """(project, done_at, low_water) of each identity with a completed index.

    ``done_at`` is the greatest last_updated with status indexed and index_status completed; ``low_water`` the start
    of the run that ended there (its first ``indexing`` row after the previous run's end), the oldest transaction
    open at the last run. Rows without identity or time are ignored; repeated rows change nothing.
    """
    rows = snapshots.select(F.col("identity").alias("project"), "status", "index_status", "last_updated").where("identity is not null and last_updated is not null")
    complete = (F.col("status") == "indexed") & (F.col("index_status") == "completed")
    done = rows.where(complete).groupBy("project").agg(F.max("last_updated").alias("done_at"))
    before = rows.join(done, "project").where("last_updated < done_at")
    ended = F.col("status").isin("indexed", "indexfailed")
    previous = before.groupBy("project").agg(F.max(F.when(ended, F.col("last_updated"))).alias("previous"))
    starts = (
        before.where("status = 'indexing'")
        .join(previous, "project")
        .where("previous is null or last_updated > previous")
        .groupBy("project")
        .agg(F.min("last_updated").alias("started"))
    )
    return done.join(starts, "project", "left").select("project", "done_at", F.coalesce("started", "done_at").alias("low_water"))


def unprocessed(source: DataFrame, ledger: DataFrame, keys: list[str], version: list[str], position: str, low_water: Column | None) -> DataFrame:
    """Rows of ``source`` at or after ``low_water`` whose key and version are not in ``ledger``.

    A null low water means nothing was processed, so all rows are read; a null position is always reread. A row
    delivered again under the same key and version is removed. An empty ledger removes nothing.
    """
    pair = keys + version
    reread = source if low_water is None else source.where(low_water.isNull() | F.col(position).isNull() | (F.col(position) >= low_water))
    seen = ledger.select(*[F.col(c).alias(f"__seen_{c}") for c in pair])
    same = [F.col(c).eqNullSafe(F.col(f"__seen_{c}")) for c in pair]
    return reread.join(seen, same, "left_anti")


def changed_files(states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(project, relative_path, known_hash, current_hash, change) of files whose state differs from what the last run knew.

    A file's state is the content hash of its row with the greatest observed_at (ties: greatest state_id); deleted
    equals absent, that is null. Known is the state over rows recorded by the last completed index of the project;
    without one nothing was known. Rows without project or path name no file and are ignored; a null recorded_at
    counts as not yet recorded; a null observed_at sorts first. Extra columns are not read.
    """
    marks = last_success(snapshots)
    rows = states.select(
        "project",
        "relative_path",
        "state_id",
        F.when(F.coalesce(F.col("file_state"), F.lit("")) == "deleted", F.lit(None)).otherwise(F.col("content_hash")).alias("hash"),
        "observed_at",
        "recorded_at",
    ).where("project is not null and relative_path is not null").join(marks, "project", "left")
    ledger = rows.where("recorded_at <= done_at")
    fresh = unprocessed(rows, ledger, ["project", "relative_path"], ["state_id"], "recorded_at", F.col("low_water"))
    newest = F.max(F.struct("observed_at", "state_id", "hash"))
    known = ledger.groupBy("project", "relative_path").agg(newest.alias("known"))
    latest = fresh.groupBy("project", "relative_path").agg(newest.alias("latest"))
    both = latest.join(known, ["project", "relative_path"], "left")
    current = F.when(F.col("known").isNull() | (F.col("latest") > F.col("known")), F.col("latest.hash")).otherwise(F.col("known.hash"))
    out = both.select("project", "relative_path", F.col("known.hash").alias("known_hash"), current.alias("current_hash"))
    kind = F.when(F.col("known_hash").isNull(), "added").when(F.col("current_hash").isNull(), "removed").otherwise("modified")
    return out.where(~F.col("known_hash").eqNullSafe(F.col("current_hash"))).withColumn("change", kind)


class ChangeFeed:
    """Durable incremental runs over a growing table.

    Under ``path``: ``ledger/<run>`` holds the key-and-version pairs a run processed with their positions, ``commits``
    one small file a run. A run counts only once its commit exists, which is written last and in one rename; a run that
    died before leaves files nobody reads. Positions must be comparable.

    ``open_since`` is the position of the oldest transaction still open when the run begins to read. Who does not know
    it must not guess: without it rows of any position may still turn up, so the low water stays where it was and the
    next run rereads from there (from the start, if it was never given). With ``redelivered`` False a pair is never
    delivered again at a later position, and the ledger is read from the low water only; otherwise all of it is.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: list[str], position: str, redelivered: bool = True):
        self.spark, self.path, self.keys, self.version, self.position, self.redelivered = spark, path.rstrip("/"), keys, version, position, redelivered
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def commits(self) -> list[dict]:
        """The committed runs, oldest first; read in one go, without a job a run."""
        if not self._fs.exists(self._at("commits")):
            return []
        rows = self.spark.read.schema("run string, number long, low_water string").option("pathGlobFilter", "*.json").json(f"{self.path}/commits")
        return sorted((r.asDict() for r in rows.collect()), key=lambda c: c["number"])

    def _ledger(self, runs: list[dict], like: DataFrame, low: Column | None) -> DataFrame:
        schema = like.select(*self.keys, *self.version, F.col(self.position).alias("__position")).schema
        if not runs:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/ledger/{c['run']}" for c in runs])
        return rows if self.redelivered or low is None else rows.where(F.col("__position").isNull() | (F.col("__position") >= low))

    def _low(self, runs: list[dict], source: DataFrame) -> Column | None:
        known = runs[-1]["low_water"] if runs else None
        return None if known is None else F.lit(known).cast(source.schema[self.position].dataType)

    def pending(self, source: DataFrame) -> DataFrame:
        """The rows the next run has to process; a row repeated in the source is given once."""
        runs = self.commits()
        low = self._low(runs, source)
        return unprocessed(source, self._ledger(runs, source, low), self.keys, self.version, self.position, low).dropDuplicates(self.keys + self.version)

    def run(self, source: DataFrame, apply, open_since=None) -> DataFrame:
        """Apply ``apply`` to the pending rows, then record and commit them. If it raises, nothing is committed.

        ``apply`` should write by key, or to a place named by the run, so that a repeat after a failure is harmless.
        Rows that arrive while it works are left to the next run: what is recorded is what was read.
        """
        runs = self.commits()
        rows = cut(self.pending(source), "pending")
        apply(rows)
        run = uuid.uuid4().hex
        rows.select(*self.keys, *self.version, F.col(self.position).alias("__position")).write.parquet(f"{self.path}/ledger/{run}")
        before = runs[-1]["low_water"] if runs else None
        self._commit({"run": run, "number": len(runs), "low_water": before if open_since is None else str(open_since)})
        return rows

    def _commit(self, mark: dict) -> None:
        draft, final = self._at(f"drafts/{mark['run']}"), self._at(f"commits/{mark['number']:09d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"run {mark['number']} was committed by another writer")
