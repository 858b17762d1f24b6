"""Queries on file states, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.operators import sync
from siftlode.runtime import table
from siftlode.streaming import jobs


def _states(spark, d):
    """Two states of the scanned files: after the first half of what was recorded, and after all of it."""
    f = table(spark, d, "file_states").where("project is not null and relative_path is not null").withColumn("path", F.concat_ws("|", "project", "relative_path"))
    half = f.agg(F.max("state_id").alias("m")).first()["m"] or 0

    def state(rows):
        last = rows.groupBy("path").agg(F.max(F.struct("observed_at", "state_id", "content_hash")).alias("s"))
        return last.select("path", F.col("s.content_hash").alias("hash")).where("hash is not null")

    return state(f.where(F.col("state_id") * 2 <= half)), state(f)


def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


def file_diff(spark, d):
    return sync.file_diff(*_states(spark, d))


def file_except(spark, d):
    old, new = _states(spark, d)
    return sync.only_in(new, old, "path")


def root_digest(spark, d):
    """The digests of both states, the first one spread in another way."""
    old, new = _states(spark, d)
    return sync.root_digest(old.repartition(3)).select(F.lit("old").alias("state"), "digest").unionByName(sync.root_digest(new).select(F.lit("new").alias("state"), "digest"))


def apply_changes(spark, d):
    old, new = _states(spark, d)
    chunks = old.select("path", F.concat(F.lit("old"), F.col("path")).alias("content"))
    fresh = new.select("path", F.concat(F.lit("new"), F.col("path")).alias("content"))
    return sync.apply_changes(chunks, sync.file_diff(old, new), fresh)


def status_latest(spark, d):
    return sync.latest_status(table(spark, d, "codebases")).select("identity", "status", "last_updated", "last_attempted_percentage")


def snapshot_options(spark, d):
    return sync.inherited_options(table(spark, d, "codebases").select("identity", "last_updated", "status", "request_splitter"))


def _ever(c, where: str):
    return c.where("identity is not null").where(where).select("identity").distinct()


def snapshot_merge(spark, d):
    """Entries that were indexed, with those of the file that were not, unless a run of theirs failed."""
    c = table(spark, d, "codebases")
    return sync.merge_snapshots(_ever(c, "status = 'indexed'"), _ever(c, "true"), _ever(c, "status = 'indexfailed'"))


def cloud_reconcile(spark, d):
    c = table(spark, d, "codebases")
    return sync.reconcile(_ever(c, "true"), _ever(c, "index_status = 'completed'"))


def heal_zero(spark, d):
    """What to do with complete entries that say they hold nothing, by the stored chunks; those at a limit are unknown."""
    c = table(spark, d, "codebases")
    entries = _ever(c, "index_status is not null").select("identity", F.lit(0).alias("indexed_files"), F.lit(0).alias("total_chunks"))
    stored = table(spark, d, "vector_documents").groupBy(F.col("project").alias("identity")).agg(F.countDistinct("vec_id").alias("rows"))
    limited = _ever(c, "index_status = 'limit_reached'").select("identity", F.lit(True).alias("limited"))
    counts = stored.join(limited, "identity", "full_outer").select("identity", F.when(F.col("limited"), -1).otherwise(F.col("rows")).alias("rows"))
    return sync.heal_empty(entries, counts)


def recent_repositories(spark, d):
    c = table(spark, d, "codebases").groupBy("identity").agg(F.max("last_updated").alias("last_updated"))
    return sync.recent(c, "last_updated", 5)


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def stream_tumbling(spark, d):
    return jobs.tumbling(_events(spark, d))


def stream_sliding(spark, d):
    return jobs.sliding(_events(spark, d))


def stream_session(spark, d):
    return jobs.sessions(_events(spark, d))


def stream_dedup(spark, d):
    e = _events(spark, d)
    return jobs.distinct_events(e.unionByName(e)).select("event_id")


def stream_live(spark, d):
    """The tumbling windows again, by a streaming query that reads the table as a file stream."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_available(jobs.tumbling(timed, late="3650 days"), "live", "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_ALL = (content_hash, file_diff, file_except, root_digest, apply_changes, status_latest, snapshot_options, snapshot_merge, cloud_reconcile, heal_zero, recent_repositories, stream_tumbling, stream_sliding, stream_session, stream_dedup, stream_live)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


_STATE = "select path, arg_max(coalesce(content_hash, ''), (observed_at, state_id)) as hash from f {} group by 1 having hash <> ''"
_TWO = f"""
with f as (select *, concat_ws('|', project, relative_path) as path from file_states where project is not null and relative_path is not null),
o as ({_STATE.format("where state_id * 2 <= (select max(state_id) from f)")}), n as ({_STATE.format("")}),
g as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when o.hash <> n.hash then 'modified' end as change from o full join n on o.path = n.path)"""
_TUMBLING = "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"


def oracle_sql() -> dict[str, str]:
    two = _TWO + " "
    digest = "select '{0}' as state, sha256('root:' || count(*) || ':' || " + " || ':' || ".join(f"sum(('0x' || substr(hash, {1 + 8 * k}, 8))::ubigint)::hugeint" for k in range(8)) + ") as digest from {1}"
    return {
        "content_hash": "select doc_id, sha256(text) as hash from documents where text is not null",
        "file_diff": two + "select path, change from g where change is not null",
        "file_except": two + "select * from n anti join o using (path)",
        "root_digest": two + digest.format("old", "o") + " union all " + digest.format("new", "n"),
        "apply_changes": two + "select path, 'old' || path as content from o anti join (select path from g where change is not null) using (path) union all select path, 'new' || path from n semi join (select path from g where change in ('added', 'modified')) using (path)",
        "status_latest": "select identity, case when status = 'indexing' then 'indexfailed' else status end as status, last_updated, case when status = 'indexing' then indexing_percentage else last_attempted_percentage end as last_attempted_percentage from (select *, row_number() over (partition by identity order by last_updated desc, status, local_path, indexing_percentage) as r from codebases where identity is not null) where r = 1",
        "snapshot_options": "select identity, last_updated, status, nullif(last_value(request_splitter ignore nulls) over (partition by identity order by last_updated, status rows unbounded preceding), '') as request_splitter from (select distinct identity, last_updated, status, request_splitter from codebases)",
        "snapshot_merge": "select distinct identity from codebases where identity is not null and (identity in (select identity from codebases where status = 'indexed') or identity not in (select identity from codebases where status = 'indexfailed' and identity is not null))",
        "cloud_reconcile": "select distinct identity from codebases where index_status = 'completed' and identity is not null",
        "heal_zero": "with l as (select distinct identity from codebases where index_status = 'limit_reached'), v as (select project as identity, count(distinct vec_id) as n from vector_documents group by 1) select distinct identity, case when identity in (select identity from l) then 'keep' when n is null then 'remove' else 'heal' end as action from codebases left join v using (identity) where index_status is not null and identity is not null",
        "recent_repositories": "select identity, max(last_updated) as last_updated from codebases group by 1 order by 2 desc, 1 limit 5",
        "stream_tumbling": _TUMBLING,
        "stream_live": _TUMBLING,
        "stream_sliding": "select w as window_start, count(*) as n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as w from events) group by 1",
        "stream_session": "with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from l) select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k",
        "stream_dedup": "select distinct event_id from events",
    }
