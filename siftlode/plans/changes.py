"""Queries on incremental processing."""

from __future__ import annotations

from siftlode.operators.changes import changed_files
from siftlode.runtime import table


def p1_found(spark, sf_dir):
    return changed_files(table(spark, sf_dir, "file_states"), table(spark, sf_dir, "codebases")).select("project", "relative_path")


def queries() -> dict:
    return {"p1_found": p1_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
with s as (select identity as project, max(last_updated) as done_at from codebases where status = 'indexed' and index_status = 'completed' group by 1),
f as (select f.*, s.done_at from file_states f left join s using (project)),
n as (select project, relative_path, arg_max(coalesce(content_hash, ''), (observed_at, state_id)) as h from f group by 1, 2),
k as (select project, relative_path, arg_max(coalesce(content_hash, ''), (observed_at, state_id)) as h from f where recorded_at <= done_at group by 1, 2)
select n.project, n.relative_path from n left join k using (project, relative_path) where n.h <> coalesce(k.h, '')"""
    }
