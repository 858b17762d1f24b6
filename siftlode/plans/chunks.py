"""Queries on chunking, text functions and path filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.functions import paths, text
from siftlode.operators import chunking
from siftlode.operators.embedding import HashingEmbedder, with_vectors
from siftlode.plans.retrieval import tokens_sql
from siftlode.runtime import table

PATTERNS = ["/tools/", "*.md", "vendor/", "src/*/cache*"]


def _files(spark, d):
    return table(spark, d, "files").where("content is not null").select(F.concat_ws("|", "project", "rel_path").alias("path"), "language", "content").distinct()


def chunk_lines(spark, d):
    return chunking.line_chunks(_files(spark, d), 800)


def chunk_overlap(spark, d):
    return chunking.with_overlap(chunking.line_chunks(_files(spark, d), 800), 100)


def chunk_definitions(spark, d):
    return chunking.chunk_files(_files(spark, d), "definitions")


def chunk_recursive(spark, d):
    return chunking.chunk_files(_files(spark, d), "recursive", size=500, overlap=50)


def chunk_window(spark, d):
    return chunking.chunk_files(_files(spark, d), "window", size=500, overlap=100)


def chunk_ids(spark, d):
    rows = table(spark, d, "vector_documents").where("start_line is not null and relative_path is not null")
    return rows.select("vec_id", text.chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line")).alias("chunk_id")).distinct()


def chunk_filter(spark, d):
    return chunking.keep_long(table(spark, d, "vector_documents"), 200).select("vec_id").distinct()


def chunk_index(spark, d):
    rows = table(spark, d, "vector_documents").where("start_line > 0").select("project", "relative_path", "vec_id", "start_line").distinct().withColumn("path", F.concat_ws("|", "project", "relative_path")).withColumn("seq", F.struct("start_line", "vec_id"))
    return chunking.with_chunk_index(rows).select("vec_id", "chunk_index")


def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(text.token_estimate(F.col("text"))).alias("tokens"))


def languages(spark, d):
    ext = text.extension(F.col("rel_path"))
    return table(spark, d, "files").select("project", "rel_path", text.language(ext).alias("language"), text.graph_language(F.col("rel_path")).alias("graph_language")).distinct()


def ext_filter(spark, d):
    rows = table(spark, d, "files").where(text.extension(F.col("rel_path")).isin(*paths.extension_list(["ts", ".py"])))
    return rows.select("project", "rel_path").distinct()


def glob_filter(spark, d):
    return table(spark, d, "files").where(paths.ignored(F.col("rel_path"), PATTERNS)).select("project", "rel_path").distinct()


def dotfile_filter(spark, d):
    """The test paths have no dot parts, so one folder is read as one."""
    rows = table(spark, d, "files").select("project", F.regexp_replace("rel_path", "^tools/", ".tools/").alias("rel_path"))
    return rows.where(~paths.has_dot_part(F.col("rel_path"))).distinct()


def module_names(spark, d):
    return table(spark, d, "files").select("project", "rel_path", text.module_name(F.lit("p"), F.col("rel_path")).alias("module")).distinct()


def collection_names(spark, d):
    return table(spark, d, "codebases").select("identity", text.collection_name(F.col("identity")).alias("collection"), text.looks_like_identity(F.col("identity")).alias("remote")).distinct()


def truncation(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.truncated(F.col("text"), 150).alias("text"))


def metadata_fields(spark, d):
    rows = table(spark, d, "vector_documents").select("vec_id", F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("unknown")).alias("language"), F.get_json_object("metadata", "$.chunkIndex").cast("long").alias("chunk_index"))
    return rows.distinct()


def embed_hash(spark, d):
    """The positions and values of every text's hashed vector that are not zero."""
    rows = with_vectors(table(spark, d, "documents").select("doc_id", "text"), HashingEmbedder(32), "text")
    return rows.select("doc_id", F.posexplode("vector").alias("position", "value")).where("value <> 0").select("doc_id", "position", F.round(F.col("value").cast("double"), 5).alias("value"))


def splitter_languages(spark, d):
    """The rules each language label of the corpus is split by."""
    return table(spark, d, "files").where("language is not null").select("language", text.splitter_language(F.col("language")).alias("rules")).distinct()


def capped_chunks(spark, d):
    """The chunks a run of at most 500 would keep, as counts a file, and those left to a later run."""
    kept, left = chunking.capped(chunking.line_chunks(_files(spark, d), 800), 500)
    rows = kept.groupBy("path").agg(F.count("*").alias("n"))
    return rows.unionByName(left.select("path", F.lit(0).cast("long").alias("n")))


_ALL = (splitter_languages, capped_chunks, chunk_lines, chunk_overlap, chunk_definitions, chunk_recursive, chunk_window, chunk_ids, chunk_filter, chunk_index, token_estimate, languages, ext_filter, glob_filter, dotfile_filter, module_names, collection_names, truncation, metadata_fields, embed_hash)


_WINDOW = """
with recursive f as (select distinct concat_ws('|', project, rel_path) as path, string_split(content, chr(10)) as l, length(content) as n from files where content is not null),
w as (select path, l, greatest(1.0, n / len(l)) as avg, list_prepend(0, list_transform(range(1, len(l) + 1), lambda i: list_sum(list_transform(l[1:i], lambda x: length(x) + 1)))) as upto from f),
r(path, l, avg, upto, k, a, b) as (
  select path, l, avg, upto, 0, 0, greatest(1, len(list_filter(upto, lambda x: x <= 500)) - 1) from w
  union all
  select path, l, avg, upto, k + 1, s, s + greatest(1, len(list_filter(upto[s + 1:], lambda x: x - upto[s + 1] <= 500)) - 1)
  from (select *, greatest(b - least(floor(100 / avg)::bigint, b - a), a + 1) as s from r where b < len(l))),
p as (select path, k, array_to_string(l[a + 1:b], chr(10)) as content, a + 1 as start_line, b as end_line from r)
select path, (row_number() over (partition by path order by k) - 1)::int as seq, content, start_line::int as start_line, end_line::int as end_line from p where length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) > 10"""


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


#: Fixed values, stated apart from the operator's own: languages and the extensions that mean them.
_LANGUAGES = "typescript .ts .tsx / javascript .js .jsx / python .py / java .java / cpp .cpp .hpp / c .c .h / csharp .cs / go .go / rust .rs / php .php / ruby .rb / swift .swift / kotlin .kt / scala .scala / objective-c .m .mm / dart .dart / solidity .sol / jupyter .ipynb / markdown .md .markdown"
_GRAPH = "javascript .js .jsx .mjs / typescript .ts .tsx / python .py / java .java / cpp .cpp .c .h .hpp .cc / go .go / rust .rs / csharp .cs / yaml .yaml .yml"
_RULES = "javascript javascript js / typescript typescript ts / python python py / java java / cpp cpp c++ c / go go / rust rust rs / csharp csharp cs / scala scala"


def _case(groups: str, key: str, other: str) -> str:
    rows = [g.split() for g in groups.split(" / ")]
    return f"case {' '.join('when ' + key + ' in (' + ', '.join(repr(x) for x in ends) + ') then ' + repr(name) for name, *ends in rows)} else '{other}' end"


def oracle_sql() -> dict[str, str]:
    ext = r"lower(regexp_extract(rel_path, '(\.[^./\\]+)$', 1))"
    fold = """
with recursive f as (select distinct concat_ws('|', project, rel_path) as path, string_split(content, chr(10)) as l from files where content is not null),
r(path, l, i, cur, done) as (
  select path, l, 0::bigint, '', []::varchar[] from f
  union all
  select path, l, i + 1,
    case when length(cur) + length(l[i + 1]) + 1 <= 800 or cur = '' then case when cur = '' then l[i + 1] else cur || chr(10) || l[i + 1] end else l[i + 1] end,
    case when length(cur) + length(l[i + 1]) + 1 <= 800 or cur = '' then done else list_append(done, cur) end
  from r where i < len(l)),
p as (select path, list_filter(list_transform(list_append(done, cur), lambda x: rtrim(x, ' ')), lambda x: trim(x, ' ') <> '') as pieces from r where i = len(l)),
c as (select path, unnest(range(len(pieces)))::bigint as seq, unnest(pieces) as content from p)"""
    return {
        "chunk_lines": fold + "select path, seq::int as seq, content from c",
        "chunk_overlap": fold + "select path, seq::int as seq, case when t is null then content else right(t, 100) || chr(10) || content end as content from (select *, lag(content) over (partition by path order by seq) as t from c)",
        "chunk_ids": "select distinct vec_id, 'chunk_' || regexp_replace(relative_path, '[^a-zA-Z0-9._-]', '_', 'g') || ':' || start_line || ':' || end_line || ':' || substr(md5(relative_path), 1, 8) as chunk_id from vector_documents where start_line is not null and relative_path is not null",
        "chunk_filter": "select distinct vec_id from vector_documents where length(trim(content, ' ')) > 200",
        "chunk_index": "select vec_id, row_number() over (partition by project, relative_path order by start_line, vec_id) - 1 as chunk_index from (select distinct project, relative_path, vec_id, start_line from vector_documents where start_line > 0)",
        "token_estimate": "select source, sum(ceil(length(text) / 4.0)::bigint)::bigint as tokens from documents group by source",
        "languages": f"select distinct project, rel_path, {_case(_LANGUAGES, ext, 'text')} as language, {_case(_GRAPH, ext, '')} as graph_language from files",
        "ext_filter": f"select distinct project, rel_path from files where {ext} in ('.ts', '.py')",
        "glob_filter": r"select distinct project, rel_path from files where starts_with(rel_path, '.') or contains(rel_path, '/.') or regexp_matches(rel_path, '^tools/') or regexp_matches(rel_path, '(^|/)[^/]*\.md$') or regexp_matches(rel_path, '(^|/)[^/]*\.md/') or regexp_matches(rel_path, '(^|/)vendor/') or regexp_matches(rel_path, '^src/.*/cache.*$') or regexp_matches(rel_path, '^src/.*/cache.*/')",
        "dotfile_filter": "select distinct project, rel_path from files where not starts_with(rel_path, 'tools/')",
        "module_names": r"select distinct project, rel_path, array_to_string(list_prepend('p', list_filter(string_split(regexp_replace(rel_path, '\.[^./]+$', ''), '/'), lambda x: x not in ('', 'index', '__init__'))), '.') as module from files",
        "collection_names": "select distinct identity, 'code_chunks_' || substr(md5(identity), 1, 8) as collection, contains(identity, '://') or contains(identity, 'git@') as remote from codebases",
        "truncation": "select doc_id, case when length(text) > 150 then substr(text, 1, 150) || '...' else text end as text from documents where text is not null",
        "metadata_fields": "select distinct vec_id, coalesce(metadata::json ->> 'language', 'unknown') as language, (metadata::json ->> 'chunkIndex')::bigint as chunk_index from vector_documents",
        "embed_hash": f"with w as (select doc_id, md5(unnest({tokens_sql('text')})) as h from documents), p as (select doc_id, (('0x' || substr(h, 1, 8))::ubigint % 32)::int as position, sum(case when substr(h, 9, 1) >= '8' then 1 else -1 end)::double as v from w group by 1, 2) select doc_id, position, round((v / sqrt(sum(v * v) over (partition by doc_id)))::float::double, 5) as value from p where v <> 0 qualify true",
        "splitter_languages": f"select distinct language, {_case(_RULES, 'lower(language)', '')} as rules from files where language is not null",
        "capped_chunks": fold + ", n as (select path, count(*) as n from c group by 1), u as (select *, sum(n) over (order by path) as upto from n) select path, case when upto > 500 and upto > n then 0 else n end as n from u",
        "chunk_window": _WINDOW,
    }
