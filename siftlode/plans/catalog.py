"""Queries on collections, node and edge lookups, decisions and composed code search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftlode.functions import paths, text
from siftlode.operators import retrieval as r
from siftlode.operators import sync
from siftlode.operators.graph import search, tables, trace
from siftlode.plans.graphs import _G, _N, edges, nodes
from siftlode.runtime import cut, table, work_dir
from siftlode.sources.collection import CollectionCatalog, document_rows
from siftlode.sources.files import is_infrastructure


def _chunks(spark, d):
    """The chunks of the corpus as rows of a collection, those that keep its limits; ids are unique in a project."""
    v = table(spark, d, "vector_documents").where("vector is not null and content is not null and relative_path is not null and size(vector) = 64")
    cols = ["id", "vector", "content", "relative_path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "file_extension", "metadata", "project"]
    return v.select("vec_id", *cols).dropDuplicates(["vec_id"]).drop("vec_id")


_CHUNKS = "c as (select distinct on (vec_id) * from vector_documents where vector is not null and content is not null and relative_path is not null and len(vector) = 64)"


def _collection(spark, d):
    catalog = CollectionCatalog(spark, f"{work_dir(spark)}/catalog-{uuid.uuid4().hex}")
    catalog.create("chunks", hybrid=True)
    catalog.insert("chunks", _chunks(spark, d), 64)
    return catalog


def collection_query(spark, d):
    """Rows of one kind of file, from a collection made of all chunks."""
    return _collection(spark, d).query("chunks", F.col("file_extension") == ".py", ["project", "id", "relative_path", "start_line"])


def collection_delete(spark, d):
    """What is left after all chunks of Markdown files were deleted by id."""
    catalog = _collection(spark, d)
    catalog.delete("chunks", catalog.query("chunks", "file_extension = '.md'", ["project", "id"]))
    return catalog.read("chunks").groupBy("project", "file_extension").agg(F.count("*").alias("n"))


def collection_file(spark, d):
    """The chunks of the first file by name."""
    rows = _collection(spark, d).read("chunks")
    first = rows.agg(F.min("relative_path").alias("p")).first()["p"]
    return rows.where(F.col("relative_path") == first).select("project", "id", "relative_path")


def collection_count(spark, d):
    catalog = _collection(spark, d)
    return spark.createDataFrame([(catalog.count("chunks"), catalog.count("none"), catalog.describe("chunks")["kind"])], "rows long, missing long, kind string")


def document_projection(spark, d):
    """Files as rows of a collection, one chunk each."""
    f = table(spark, d, "files").where("content is not null and rel_path is not null").select("project", F.col("rel_path").alias("path"), "content", F.coalesce("language", F.lit("text")).alias("language")).distinct()
    rows = f.select("path", "content", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), "language", F.lit(0).alias("chunk_index"), F.array().cast("array<float>").alias("vector"))
    made = document_rows(rows, "p")
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return made.select("id", "relative_path", "file_extension", "end_line", get("codebasePath").alias("base"), get("language").alias("language"), get("chunkIndex").alias("chunk_index")).distinct()


def ignored_folders(spark, d):
    return table(spark, d, "file_states").where(paths.in_ignored_folder(F.col("relative_path"))).select("project", "relative_path").distinct()


def infrastructure_files(spark, d):
    every = table(spark, d, "vector_documents").select("project", F.col("relative_path").alias("path")).unionByName(table(spark, d, "files").select("project", F.col("rel_path").alias("path")))
    return every.where("path is not null").where(is_infrastructure(F.col("path"))).distinct()


def test_paths(spark, d):
    return table(spark, d, "file_states").where("relative_path is not null").where(trace.is_test_path("relative_path")).select("relative_path").distinct()


def _sources(spark, d):
    return table(spark, d, "files").where("content is not null").select(F.concat_ws("|", "project", "rel_path").alias("path"), "content").distinct()


def line_regex(spark, d):
    """Lines that match a regular expression, in files whose path matches another."""
    return search.grep(_sources(spark, d), r"^\s*(?:import|from)\s+\w+", True, r"\.(?:py|ts)$")


def _spans(spark, d):
    v = table(spark, d, "vector_documents").where("start_line > 0 and end_line >= start_line")
    return v.select(F.col("vec_id").alias("id"), F.concat("project", F.lit("/"), "relative_path").alias("file_path"), "start_line", "end_line", F.col("id").alias("name"), F.lit("Chunk").alias("label")).distinct()


def code_search(spark, d):
    """Grep with the smallest chunk around each hit, each chunk once; the whole result, not a page of it."""
    f = table(spark, d, "files").where("content is not null").select(F.concat("project", F.lit("/"), "rel_path").alias("path"), "content").distinct()
    rows, _ = search.search_code(f, _spans(spark, d), "return", limit=2**31 - 1)
    return rows.select("path", "line", "node_id", "label")


def code_search_totals(spark, d):
    f = table(spark, d, "files").where("content is not null").select(F.concat("project", F.lit("/"), "rel_path").alias("path"), "content").distinct()
    _, totals = search.search_code(f, _spans(spark, d), "token")
    return spark.createDataFrame([(totals["matches"], totals["results"])], "matches long, results long")


def nodes_by_ids(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.concat(F.lit("o"), "l_orderkey").alias("id"))
    return tables.nodes_by_id(nodes(spark, d), ids).select("id", "name", "label")


def node_by_name(spark, d):
    return tables.by_qualified_name(nodes(spark, d), "suppliers", "suppliers.Supplier#000000003").select("id", "name", "label")


def edges_by_end(spark, d):
    """Edges of one type from a source, and to a target."""
    e = edges(spark, d)
    return tables.edges_at(e, source="c1", types=("CALLS",)).unionByName(tables.edges_at(e, target="p1")).select("source_id", "target_id", "type")


def edge_page(spark, d):
    return tables.edges_at(edges(spark, d), types=("CONTAINS",), project="sales", limit=1000).select("source_id", "target_id", "type")


def adjacency(spark, d):
    ids = nodes(spark, d).where("label = 'Method'").select("id")
    return tables.adjacency(edges(spark, d), ids, "outbound", ("CALLS",)).select("id", F.size("others").alias("n"), F.element_at("others", 1).alias("first"))


def distinct_files(spark, d):
    return tables.distinct_files(nodes(spark, d))


def delete_label(spark, d):
    n, e = tables.delete_label(nodes(spark, d), edges(spark, d), "suppliers", "Method")
    return n.groupBy("label").agg(F.count("*").alias("n")).unionByName(e.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


def page_totals(spark, d):
    """Whether there is more behind each of three pages of a name search."""
    rows = search.find_nodes(nodes(spark, d), name="order1", limit=None)
    made = []
    for offset in (0, 200, 1_000_000):
        page, total, more = search.found_page(rows, ["name", "id"], 200, offset)
        made.append((offset, page.count(), total, more))
    return spark.createDataFrame(made, "offset long, shown long, total long, more boolean")


def trace_mode(spark, d):
    """What calls reach from a customer; other edges are not followed."""
    return trace.trace(edges(spark, d), spark.createDataFrame([("c1",)], "id string"), 3, "outbound", trace.mode_types("calls"))


def merged_edges(spark, d):
    """Edges written twice, with the properties of both, the later ones over the earlier."""
    e = edges(spark, d).where("type = 'CALLS'")
    first = e.withColumn("properties", F.lit('{"a":"1","b":"1"}')).withColumn("seq", F.lit(1))
    then = e.where("source_id like 's%'").withColumn("properties", F.lit('{"b":"2"}')).withColumn("seq", F.lit(2))
    return tables.dedupe_edges(first.unionByName(then), keep="merge").groupBy("type", "properties").agg(F.count("*").alias("n"))


def decisions(spark, d):
    """Decision texts of the corpus as nodes, accepted where they are long, listed again."""
    docs = table(spark, d, "documents").where("doc_kind = 'adr' and length(trim(text)) > 0")
    first = F.element_at(F.split(F.trim("text"), "\n"), 1)
    rows = docs.select(F.col("source").alias("project"), F.concat(first, F.lit(" "), F.col("doc_id")).alias("title"), F.col("text").alias("content"), F.lit("proposed").alias("status"), F.col("lang").alias("created"), "n_chars")
    made = tables.adr_rows(rows.drop("n_chars"))
    long = tables.adr_rows(rows.where("n_chars > 500").drop("n_chars")).select("id", F.lit('{"status":"accepted"}').alias("properties"))
    return tables.adrs(tables.update_properties(made, long), most=2**31 - 1).select("project", "title", "status", F.length("content").alias("chars"))


def sync_totals(spark, d):
    """How many files each project gained, lost and changed between the last complete index and now."""
    from siftlode.operators.changes import changed_files

    return changed_files(table(spark, d, "file_states"), table(spark, d, "codebases")).groupBy("project", "change").agg(F.count("*").alias("n"))


def hits_by_file(spark, d):
    """The chunks of each file in order, as search groups its hits."""
    v = table(spark, d, "vector_documents").where("start_line > 0").select("project", "relative_path", "vec_id", "start_line").distinct()
    lists = F.array_sort(F.collect_list(F.struct("start_line", "vec_id")))
    return v.groupBy("project", "relative_path").agg(lists.alias("l")).select("project", "relative_path", F.size("l").alias("n"), F.element_at("l", 1)["vec_id"].alias("first"), F.element_at("l", -1)["vec_id"].alias("last"))


def cosine_all(spark, d):
    """Every usable stored vector against the first one, vectors of zeros included."""
    v = table(spark, d, "vector_documents").where("size(vector) = 64").select("vec_id", "vector").dropDuplicates(["vec_id"])
    query = v.where(F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))) > 0).orderBy("vec_id").first()["vector"]
    return r.dense_topk(v, query, None, "vec_id", "vector")


def name_functions(spark, d):
    """What the functions on names give for the module name of every file."""
    q = text.module_name(F.lit("p"), F.col("rel_path"))
    return table(spark, d, "files").where("rel_path is not null").select(
        "rel_path", text.simple_name(q).alias("simple"), text.common_prefix(q, F.lit("p.src.core.index")).alias("shared"), text.is_test_name(q).alias("is_test"), text.is_dockerfile(F.col("rel_path")).alias("docker"),
    ).distinct()


def text_functions(spark, d):
    """Functions on texts: search terms, slugs, route templates and the text that is embedded."""
    t = F.substring(F.coalesce("text", F.lit("")), 1, 400)
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(text.query_terms(F.regexp_replace(F.col("source"), "^", "readFile ")), "|").alias("terms"), text.adr_slug(F.col("source")).alias("slug"),
        text.route_parameters(F.concat(F.lit("/u/${"), F.col("source"), F.lit("}/x"))).alias("route"), F.length(text.embedding_text(F.col("text"), 50)).alias("embedded"),
        text.progress_percent(F.col("doc_id"), F.lit(1000.0)).cast("long").alias("progress"), F.round(text.count_penalty(0.55, F.length(t) + 1), 9).alias("penalty"),
    )


def overlap_shares(spark, d):
    """How much of each chunk the chunk of the same file before it covers."""
    v = table(spark, d, "vector_documents").where("start_line > 0 and end_line >= start_line").select("project", "relative_path", "vec_id", "start_line", "end_line").distinct()
    a, b = v.alias("a"), v.alias("b")
    on = (F.col("a.project") == F.col("b.project")) & (F.col("a.relative_path") == F.col("b.relative_path")) & (F.col("b.vec_id") == F.col("a.vec_id") - 1)
    share = text.overlap_share(F.col("a.start_line"), F.col("a.end_line"), F.col("b.start_line"), F.col("b.end_line"))
    return a.join(b, on).select(F.col("a.vec_id").alias("vec_id"), F.round(share, 6).alias("share"))


def digest_of_states(spark, d):
    """The digest of the current file states."""
    rows = table(spark, d, "file_states").where("content_hash is not null").select(F.sha2("content_hash", 256).alias("hash"))
    return sync.root_digest(cut(rows, "hashes"))


_ALL = (
    collection_query, collection_delete, collection_file, collection_count, document_projection, ignored_folders, infrastructure_files, test_paths, line_regex, code_search, code_search_totals, nodes_by_ids, node_by_name, edges_by_end, edge_page,
    adjacency, distinct_files, delete_label, page_totals, trace_mode, merged_edges, decisions, sync_totals, hits_by_file, cosine_all, name_functions, text_functions, overlap_shares, digest_of_states,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    lines = "string_split(content, chr(10))"
    folders = ", ".join(f"'{x}'" for x in paths.IGNORED_FOLDERS)
    infra = r"regexp_matches(lower(string_split(path, '/')[-1]), '^dockerfile(\..*)?$') or regexp_matches(lower(path), '(?:^|/)[^/]*(?:k8s|kubernetes|deploy|deployment|infra|manifests|helm|charts)[^/]*/.*\.ya?ml$')"
    hits = f"""
with f as (select distinct project || '/' || rel_path as path, content from files where content is not null),
h as (select path, unnest(range(1, len({lines}) + 1))::int as line, unnest({lines}) as text from f),
g as (select path, line from h where contains(lower(text), 'WORD')),
s as (select distinct vec_id as id, project || '/' || relative_path as path, start_line, end_line from vector_documents where start_line > 0 and end_line >= start_line),
n as (select g.path, g.line, coalesce(arg_min(s.id, (end_line - start_line, s.id))::varchar, '-1') as node_id from g left join s on s.path = g.path and line between start_line and end_line group by 1, 2),
o as (select *, row_number() over (partition by path, node_id order by line) as k from n),
r as (select path, line, node_id, case when node_id = '-1' then 'File' else 'Chunk' end as label from o where k = 1 or node_id = '-1')"""
    module = r"array_to_string(list_prepend('p', list_filter(string_split(regexp_replace(rel_path, '\.[^./]+$', ''), '/'), lambda x: x not in ('', 'index', '__init__'))), '.')"
    slices = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::ubigint)::hugeint as p{k}" for k in range(8))
    return {
        "collection_query": f"with {_CHUNKS} select project, id, relative_path, start_line from c where file_extension = '.py'",
        "collection_delete": f"with {_CHUNKS} select project, file_extension, count(*) as n from c where file_extension is distinct from '.md' group by all",
        "collection_file": f"with {_CHUNKS} select project, id, relative_path from c where relative_path = (select min(relative_path) from c)",
        "collection_count": f"with {_CHUNKS} select count(*) as rows, -1::bigint as missing, 'hybrid' as kind from c",
        "document_projection": r"select distinct 'chunk_' || regexp_replace(rel_path, '[^a-zA-Z0-9._-]', '_', 'g') || ':1:' || len(string_split(content, chr(10))) || ':' || substr(md5(rel_path), 1, 8) as id, rel_path as relative_path, lower(regexp_extract(rel_path, '(\.[^./\\]+)$', 1)) as file_extension, len(string_split(content, chr(10)))::bigint as end_line, 'p' as base, coalesce(language, 'text') as language, '0' as chunk_index from files where content is not null and rel_path is not null",
        "ignored_folders": f"select distinct project, relative_path from file_states where list_has_any(string_split(relative_path, '/'), [{folders}])",
        "infrastructure_files": f"select distinct project, path from (select project, relative_path as path from vector_documents union all select project, rel_path from files) where {infra}",
        "test_paths": "select distinct relative_path from file_states where contains(lower(relative_path), 'test') or contains(lower(relative_path), 'spec')",
        "line_regex": rf"select path, line, text from (select path, unnest(range(1, len({lines}) + 1))::int as line, unnest({lines}) as text from (select distinct concat_ws('|', project, rel_path) as path, content from files where content is not null)) where regexp_matches(text, '^\s*(?:import|from)\s+\w+') and regexp_matches(path, '\.(?:py|ts)$')",
        "code_search": hits.replace("WORD", "return") + " select * from r",
        "code_search_totals": hits.replace("WORD", "token") + " select (select count(*) from g) as matches, (select count(*) from r) as results",
        "nodes_by_ids": _G + " select id, name, label from n where id in (select 'o' || l_orderkey from lineitem where l_quantity >= 49)",
        "node_by_name": _G + " select id, name, label from n where project = 'suppliers' and name = 'Supplier#000000003'",
        "edges_by_end": _G + " select * from e where source_id = 'c1' and type = 'CALLS' union all select * from e where target_id = 'p1'",
        "edge_page": _G + " select * from e where type = 'CONTAINS' order by source_id, target_id limit 1000",
        "adjacency": _G + " select source_id as id, count(*)::int as n, min(target_id) as first from e where type = 'CALLS' and source_id in (select id from n where label = 'Method') group by 1",
        "distinct_files": _G + " select distinct project, file_path from n",
        "delete_label": _G + " select label, count(*) as n from n where label <> 'Method' group by 1 union all select type, count(*) from e where source_id not like 's%' group by 1",
        "page_totals": _G + ", m as (select count(*) as total from n where contains(lower(name), 'order1')) select o as offset, greatest(0, least(200, total - o)) as shown, total, o + greatest(0, least(200, total - o)) < total and o < total as more from m, (values (0::bigint), (200), (1000000)) t(o)",
        "trace_mode": f"with recursive {_N.strip()}, r(id, d) as (select 'c1', 0 union select e.target_id, d + 1 from r join e on e.source_id = r.id and e.type = 'CALLS' where d < 3) select id, min(d)::int as depth, 'outbound' as direction from r where id <> 'c1' group by id",
        "merged_edges": _G + " select type, case when source_id like 's%' then '{\"a\":\"1\",\"b\":\"2\"}' else '{\"a\":\"1\",\"b\":\"1\"}' end as properties, count(*) as n from e where type = 'CALLS' group by all",
        "decisions": "select source as project, string_split(trim(text, ' '), chr(10))[1] || ' ' || doc_id as title, case when n_chars > 500 then 'accepted' else 'proposed' end as status, length(text)::int as chars from documents where doc_kind = 'adr' and length(trim(text, ' ')) > 0",
        "sync_totals": """
with s as (select identity as project, max(last_updated) as done_at from codebases where status = 'indexed' and index_status = 'completed' group by 1),
f as (select f.*, s.done_at from file_states f left join s using (project)),
n as (select project, relative_path, arg_max(coalesce(content_hash, ''), (observed_at, state_id)) as h from f group by 1, 2),
k as (select project, relative_path, arg_max(coalesce(content_hash, ''), (observed_at, state_id)) as h from f where recorded_at <= done_at group by 1, 2)
select n.project, case when coalesce(k.h, '') = '' then 'added' when n.h = '' then 'removed' else 'modified' end as change, count(*) as n from n left join k using (project, relative_path) where n.h <> coalesce(k.h, '') group by all""",
        "hits_by_file": "select project, relative_path, count(*)::int as n, arg_min(vec_id, (start_line, vec_id)) as first, arg_max(vec_id, (start_line, vec_id)) as last from (select distinct project, relative_path, vec_id, start_line from vector_documents where start_line > 0) group by 1, 2",
        "cosine_all": "with v as (select distinct on (vec_id) vec_id, vector::double[] as v from vector_documents where len(vector) = 64), z as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from v), q as (select v, n from z where n > 0 order by vec_id limit 1) select z.vec_id, round(case when z.n = 0 then 0 else list_dot_product(z.v, q.v) / (z.n * q.n) end, 6) as score from z, q",
        "name_functions": f"with m as (select distinct rel_path, {module} as q from files where rel_path is not null), x as (select *, string_split(q, '.') as a from m) select rel_path, regexp_extract(q, '([^.:]*)$', 1) as simple, case when a[1] <> 'p' then 0 when coalesce(a[2], '') <> 'src' then 1 when coalesce(a[3], '') <> 'core' then 2 when coalesce(a[4], '') <> 'index' then 3 else 4 end::int as shared, regexp_matches(lower(q), 'test|mock|stub|fake|fixture|spec') as is_test, regexp_matches(lower(string_split(rel_path, '/')[-1]), '^dockerfile(\\..*)?$') as docker from x",
        "text_functions": r"with t as (select doc_id, source, text, string_split(regexp_replace(regexp_replace('readFile ' || source, '([a-z])([A-Z])', '\1 \2', 'g'), '[\s_\-.:/]+', ' ', 'g'), ' ') as w from documents) select doc_id, array_to_string(list_reverse(list_reduce(list_prepend([]::varchar[], list_transform(list_filter(w, lambda x: x <> ''), lambda x: [lower(x)])), lambda a, x: case when list_contains(a, x[1]) then a else list_prepend(x[1], a) end)), '|') as terms, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '(^-+|-+$)', '', 'g') as slug, '/u/:param/x' as route, case when coalesce(text, '') = '' then 1 else least(200, length(text)) end::int as embedded, round(10 + doc_id / 1000.0 * 90)::bigint as progress, round(0.55 * least(1.0, 5.0 / (least(400, length(coalesce(text, ''))) + 1)), 9)::double as penalty from t",
        "overlap_shares": "with v as (select distinct project, relative_path, vec_id, start_line, end_line from vector_documents where start_line > 0 and end_line >= start_line) select a.vec_id, round(greatest(0, least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1) / greatest(1, a.end_line - a.start_line + 1), 6)::double as share from v a join v b on a.project = b.project and a.relative_path = b.relative_path and b.vec_id = a.vec_id - 1",
        "digest_of_states": f"with h as (select sha256(content_hash) as h from file_states where content_hash is not null), s as (select count(*) as n, {slices} from h) select sha256('root:' || n || ':' || " + " || ':' || ".join(f"p{k}" for k in range(8)) + ") as digest from s",
    }
