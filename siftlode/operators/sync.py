"""Change detection between file states, applying changes, snapshots and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_diff(old: DataFrame, new: DataFrame, key: str = "path", hash_col: str = "hash") -> DataFrame:
    """(key, change): added, removed or modified, by a full outer join of two states; unchanged rows are left out."""
    a = old.select(F.col(key), F.col(hash_col).alias("old_hash"), F.lit(True).alias("in_old"))
    b = new.select(F.col(key), F.col(hash_col).alias("new_hash"), F.lit(True).alias("in_new"))
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    return a.join(b, key, "full_outer").select(key, kind.alias("change")).where("change is not null")


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def root_digest(states: DataFrame, hash_col: str = "hash") -> DataFrame:
    """One row (digest): a digest of all leaf hashes, independent of their order and of how they are spread.

    The leaves are summed in 16 slices of their hash, so no task ever holds them all.
    """
    hexes = F.col(hash_col)
    parts = [F.sum(F.conv(F.substring(hexes, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    sums = states.select(hash_col).agg(F.count("*").alias("n"), *parts)
    body = F.concat_ws(":", F.col("n").cast("string"), *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(8)])
    return sums.select(F.sha2(F.concat(F.lit("root:"), body), 256).alias("digest"))


def apply_changes(chunks: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Chunks without those of changed files, with the fresh chunks of added and modified ones."""
    gone = changes.where(F.col("change").isin("removed", "modified", "added")).select(key)
    kept = chunks.join(gone, key, "left_anti")
    live = fresh.join(changes.where("change <> 'removed'").select(key), key, "left_semi")
    return kept.unionByName(live)


def latest_status(snapshots: DataFrame) -> DataFrame:
    """The last row of each identity, by last_updated, then status; a run left open reads as failed."""
    w = Window.partitionBy("identity").orderBy(F.desc("last_updated"), "status", "local_path", "indexing_percentage")
    last = snapshots.where("identity is not null").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    open_run = F.col("status") == "indexing"
    return last.withColumn("last_attempted_percentage", F.when(open_run, F.col("indexing_percentage")).otherwise(F.col("last_attempted_percentage"))).withColumn("status", F.when(open_run, "indexfailed").otherwise(F.col("status")))


def inherited_options(snapshots: DataFrame) -> DataFrame:
    """(identity, last_updated, request_splitter): a missing option inherits the last given one, an empty one clears it."""
    w = Window.partitionBy("identity").orderBy("last_updated", "status").rowsBetween(Window.unboundedPreceding, 0)
    given = F.last("request_splitter", ignorenulls=True).over(w)
    return snapshots.dropDuplicates().select("identity", "last_updated", "status", F.when(given == "", None).otherwise(given).alias("request_splitter"))


def merge_snapshots(memory: DataFrame, disk: DataFrame, removed: DataFrame, key: str = "identity") -> DataFrame:
    """Entries in memory, and those on disk that memory lacks and that were not removed just now."""
    extra = disk.join(memory.select(key), key, "left_anti").join(removed.select(key), key, "left_anti")
    return memory.unionByName(extra)


def reconcile(local: DataFrame, cloud: DataFrame, key: str = "identity", failed: bool = False) -> DataFrame:
    """Local entries still in the cloud; all of them if the cloud listing failed or is empty."""
    if failed or cloud.isEmpty():
        return local
    return local.join(cloud.select(key).distinct(), key, "left_semi")


def heal_empty(entries: DataFrame, counts: DataFrame, key: str = "identity") -> DataFrame:
    """(key, action) for entries marked complete with nothing in them: remove, heal, or keep if the count is unknown (-1)."""
    joined = entries.where("indexed_files = 0 and total_chunks = 0").select(key).join(counts, key, "left")
    action = F.when(F.col("rows").isNull() | (F.col("rows") == 0), "remove").when(F.col("rows") < 0, "keep").otherwise("heal")
    return joined.select(key, action.alias("action"))


def recent(entries: DataFrame, time_col: str, k: int = 5, key: str = "identity") -> DataFrame:
    return entries.orderBy(F.desc(time_col), key).limit(k)
