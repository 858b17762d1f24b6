"""Graph queries: the foreign keys of the sales tables as a graph, and the graph of the test source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlode.functions.text import module_name
from siftlode.operators.fulltext import FullTextIndex
from siftlode.operators.graph import architecture as arch
from siftlode.operators.graph import extract, resolve, search, tables, trace
from siftlode.runtime import table, work_dir

# nodes: customers and orders as functions, parts as classes, suppliers as methods; edges: placed, contains, supplies


def nodes(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("project"), F.lit("Function").alias("label"), F.col("c_name").alias("name"), F.concat(F.lit("customer/n"), "c_nationkey", F.lit("/c.ts")).alias("file_path"))
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.lit("Function").alias("label"), F.concat(F.lit("Order"), "o_orderkey").alias("name"), F.concat(F.lit("order/"), "o_orderstatus", F.lit("/o.ts")).alias("file_path"))
    p = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("project"), F.lit("Class").alias("label"), F.col("p_name").alias("name"), F.concat(F.lit("part/s"), "p_size", F.lit("/p.ts")).alias("file_path"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("suppliers").alias("project"), F.lit("Method").alias("label"), F.col("s_name").alias("name"), F.concat(F.lit("supplier/n"), "s_nationkey", F.lit("/test.ts")).alias("file_path"))
    every = c.unionByName(o).unionByName(p).unionByName(s)
    return every.withColumn("qualified_name", F.concat_ws(".", "project", "name")).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(10))


def edges(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"), F.lit("CALLS").alias("type"))
    li = table(spark, d, "lineitem")
    c = li.select(F.concat(F.lit("o"), "l_orderkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("CONTAINS").alias("type"))
    s = li.select(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.lit("CALLS").alias("type"))
    return o.unionByName(c).unionByName(s).distinct().withColumn("project", F.lit("sales")).withColumn("properties", F.lit("{}"))


_N = """
n as (select 'c' || c_custkey as id, c_mktsegment as project, 'Function' as label, c_name as name, 'customer/n' || c_nationkey || '/c.ts' as file_path from customer
union all select 'o' || o_orderkey, o_orderpriority, 'Function', 'Order' || o_orderkey, 'order/' || o_orderstatus || '/o.ts' from orders
union all select 'p' || p_partkey, p_brand, 'Class', p_name, 'part/s' || p_size || '/p.ts' from part
union all select 's' || s_suppkey, 'suppliers', 'Method', s_name, 'supplier/n' || s_nationkey || '/test.ts' from supplier),
e as (select 'c' || o_custkey as source_id, 'o' || o_orderkey as target_id, 'CALLS' as type from orders
union select 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS' from lineitem
union select 's' || l_suppkey, 'p' || l_partkey, 'CALLS' from lineitem)"""
_G = "with" + _N
_DEG = _G + ", dg as (select id, coalesce(i, 0)::bigint as in_degree, coalesce(o, 0)::bigint as out_degree from n left join (select target_id as id, count(*) as i from e group by 1) using (id) left join (select source_id as id, count(*) as o from e group by 1) using (id)) "
_DIR = "case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else 'root' end"


def project_stats(spark, d):
    return tables.project_stats(nodes(spark, d), edges(spark, d))


def label_counts(spark, d):
    return tables.label_counts(nodes(spark, d))


def edge_type_counts(spark, d):
    return tables.edge_type_counts(edges(spark, d))


def schema_listing(spark, d):
    return tables.schema_listing(nodes(spark, d), edges(spark, d))


def node_degree(spark, d):
    return tables.degrees(nodes(spark, d), edges(spark, d))


def degree_filter(spark, d):
    return search.find_nodes(nodes(spark, d), edges(spark, d), label="Function", min_degree=12, limit=50).select("id", "name", "in_degree", "out_degree")


def find_nodes_page(spark, d):
    return search.find_nodes(nodes(spark, d), name="order1", limit=20, offset=20).select("id", "name")


def like_name_search(spark, d):
    return search.find_nodes(nodes(spark, d), name="R#0000001*", file="CUSTOMER", limit=1000).select("id", "name")


def cypher_eq(spark, d):
    return search.cypher(nodes(spark, d), "MATCH (n) WHERE n.label = 'Method' AND n.name = 'Supplier#000000003' RETURN n").select("id", "name")


def cypher_contains(spark, d):
    return search.cypher(nodes(spark, d), "MATCH (n:Function) WHERE n.name CONTAINS '99' RETURN n").select("id", "name")


def entry_points(spark, d):
    return arch.entry_points(nodes(spark, d), edges(spark, d))


def cluster_cohesion(spark, d):
    return arch.clusters(nodes(spark, d), edges(spark, d))


def cluster_top_nodes(spark, d):
    return arch.top_nodes(nodes(spark, d))


def package_tree(spark, d):
    return arch.package_tree(nodes(spark, d))


def _root(spark):
    return spark.createDataFrame([("c1",), ("s1",)], "id string")


def trace_outbound(spark, d):
    return trace.trace(edges(spark, d), _root(spark).where("id = 'c1'"), 3, "outbound")


def trace_inbound(spark, d):
    return trace.trace(edges(spark, d), spark.createDataFrame([("p1",)], "id string"), 3, "inbound")


def trace_both(spark, d):
    """Both ways from an order, test nodes pruned."""
    n = nodes(spark, d)
    return trace.trace(edges(spark, d), spark.createDataFrame([("o1",)], "id string"), 2, "both", None, n.where(~trace.is_test_path()))


def enrich_layer1(spark, d):
    return search.enrich(nodes(spark, d), edges(spark, d))


def snippet_neighbors(spark, d):
    return search.neighbours(edges(spark, d), nodes(spark, d)).groupBy("id", "direction").agg(F.count("*").alias("n"), F.min("neighbour").alias("first"))


def dedupe_edges(spark, d):
    e = edges(spark, d)
    twice = e.withColumn("seq", F.lit(1)).unionByName(e.withColumn("seq", F.lit(2)).withColumn("properties", F.lit('{"again":1}')))
    return tables.dedupe_edges(twice, keep="last")


def upsert_nodes(spark, d):
    n = nodes(spark, d).select("id", "project", "qualified_name", "label", "name", "file_path")
    again = n.where("label = 'Class'").withColumn("name", F.upper("name")).withColumn("seq", F.lit(2))
    return tables.upsert_nodes(n.withColumn("seq", F.monotonically_increasing_id() * 0 + 1).unionByName(again)).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col("name") == F.upper("name"), 1).otherwise(0)).alias("upper"))


def cascade_delete(spark, d):
    n, e = tables.delete_nodes(nodes(spark, d), edges(spark, d), nodes(spark, d).where("label = 'Method'"))
    return tables.label_counts(n).select("label", "n").groupBy("label").agg(F.sum("n").alias("n")).unionByName(tables.edge_type_counts(e).select(F.col("type").alias("label"), "n"))


def delete_by_file(spark, d):
    n = nodes(spark, d)
    left, e = tables.delete_files(n, edges(spark, d), n.where("file_path like 'customer/n1%'"))
    return tables.edge_type_counts(e).select(F.col("type").alias("kind"), "n").unionByName(left.groupBy(F.lit("nodes").alias("kind")).agg(F.count("*").alias("n")))


def dangling_edges(spark, d):
    e = tables.drop_dangling(edges(spark, d), nodes(spark, d).where("label <> 'Class' or id like '%1'"))
    return tables.edge_type_counts(e).select("type", "n")


def _code(spark, d):
    rows = table(spark, d, "files").where("content is not null").groupBy("project", F.col("rel_path").alias("path"))
    return rows.agg(F.min("content").alias("content"))  # of a path with two contents always the same one


def code_facts(spark, d):
    """Definitions, imports, calls and routes of all source files."""
    return extract.file_facts(_code(spark, d))


def code_calls(spark, d):
    """The call graph of all source files: resolved calls with strategy and confidence."""
    n, registry, calls = extract.graph_of(extract.file_facts(_code(spark, d)))
    return extract.call_edges(calls, resolve.resolve_calls(calls, registry), n)


def code_graph(spark, d):
    """Counts of the whole graph of all source files: definitions, modules and routes; calls, imports and handlers."""
    n, e = extract.graph_rows(extract.file_facts(_code(spark, d)))
    return n.groupBy("project", F.col("label").alias("kind")).agg(F.count("*").alias("n")).unionByName(e.groupBy("project", F.col("type").alias("kind")).agg(F.count("*").alias("n")))


def _registry(spark, d):
    """Every scanned file as a definition named like its module, and every folder as one named like the top folder, a
    name that many share; the order of definitions is that of a hash."""
    f = table(spark, d, "file_states").where("project is not null and relative_path is not null").select("project", F.explode(F.array(module_name(F.col("project"), F.col("relative_path")), F.concat(module_name(F.col("project"), F.concat(F.regexp_replace("relative_path", "/[^/]*$", ""), F.lit("/__init__.py"))), F.lit("."), F.element_at(F.split("relative_path", "/"), 1)))).alias("qualified_name")).distinct()
    return f.withColumn("seq", F.conv(F.substring(F.md5("qualified_name"), 1, 8), 16, 10).cast("long")).withColumn("name", F.col("qualified_name")).withColumn("label", F.lit("Function"))


def _calls(spark, d):
    """A call a chunk: of its file's or its top folder's name, plain or behind its folder's, with or without imports, from three places."""
    c = table(spark, d, "code_chunks").where("file_path is not null and project is not null").select("chunk_id", "project", "file_path").distinct()
    base = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]+$", "")
    parent = F.element_at(F.split(F.concat(F.lit("x/"), F.col("file_path")), "/"), -2)
    base = F.when(F.length("file_path") % 11 < 5, F.element_at(F.split("file_path", "/"), 1)).otherwise(base)
    n, folder = F.length("file_path"), F.regexp_replace("file_path", "/[^/]*$", "")
    place = module_name(F.col("project"), F.concat(folder, F.lit("/__init__.py")))
    callee = F.when(n % 3 == 0, base).when(n % 3 == 1, F.concat(parent, F.lit("."), base)).otherwise(F.concat(parent, F.lit("::"), base))
    value = F.when(n % 5 == 0, F.lit("else.where")).otherwise(place)
    none = F.array().cast("array<string>")
    return c.select(
        F.col("chunk_id").alias("call_id"), "project", callee.alias("callee"), F.when(n % 7 == 0, place).otherwise(F.concat("project", F.lit(".src"))).alias("module_qn"),
        F.when(n % 2 == 0, F.array(parent)).otherwise(none).alias("import_keys"), F.when(n % 2 == 0, F.array(value)).otherwise(none).alias("import_vals"),
    )


def resolve_calls(spark, d):
    return resolve.resolve_calls(_calls(spark, d), _registry(spark, d))


def fuzzy_calls(spark, d):
    return resolve.fuzzy_resolve(_calls(spark, d), _registry(spark, d)).select("call_id", "qualified_name", F.round("confidence", 6).alias("confidence"))


def line_grep(spark, d):
    return search.grep(_code(spark, d).withColumn("path", F.concat_ws("|", "project", "path")), "watermark")


def line_in_node(spark, d):
    """Grep hits with the smallest chunk around each, the chunks of the test corpus as nodes."""
    spans = table(spark, d, "vector_documents").where("start_line > 0 and end_line >= start_line").select(F.col("vec_id").alias("id"), F.concat_ws("|", "project", "relative_path").alias("file_path"), "start_line", "end_line").distinct()
    lines = spans.select(F.col("file_path").alias("path"), F.explode(F.array(F.lit(1).cast("long"), F.col("start_line") + 2, F.col("end_line") + 5)).alias("line")).distinct()
    return search.smallest_node(lines, spans)


def snippets(spark, d):
    v = table(spark, d, "files").where("content is not null")
    return v.select("project", "rel_path", search.snippet(F.col("content"), F.lit(3), F.lit(7)).alias("code")).distinct()


def impacted_nodes(spark, d):
    return search.impacted(nodes(spark, d), spark.createDataFrame([("part/s7/p.ts",), ("order/F/o.ts",)], "file_path string")).select("id")


_NODE_TERMS: dict[tuple[str, str], FullTextIndex] = {}


def node_terms(spark, d):
    """The stored index over the names and paths of all nodes, built once an application and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _NODE_TERMS:
        path = f"{work_dir(spark)}/node-terms-{len(_NODE_TERMS)}"
        _NODE_TERMS[key] = FullTextIndex(spark, path, 16).build(nodes(spark, d), "id", search.WEIGHTS)
    return _NODE_TERMS[key]


def node_search(spark, d):
    """Nodes by the words of a query, split at capitals, best first."""
    return node_terms(spark, d).search("machineryCustomer steel.n7 000000012", 50, camel=True)


def node_search_page(spark, d):
    """The second page of it, joined to the nodes."""
    return nodes(spark, d).join(node_terms(spark, d).search("machineryCustomer steel.n7 000000012", 20, 20, camel=True), "id").select("id", "name", "score")


def dockerfile_nodes(spark, d):
    """The instructions of a Dockerfile made for every part, each with the one before it."""
    body = F.concat(F.lit("FROM "), "p_brand", F.lit(":"), "p_size", F.lit("\n# note\nRUN "), "p_type", F.lit(" && \\\n  "), "p_name", F.lit("\n\ncopy . /"), F.col("p_partkey"), F.lit("\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey", F.lit("/Dockerfile")).alias("path"), body.alias("content"))
    n, e = extract.dockerfile_resources(files)
    return n.join(e.select("path", F.col("to_position").alias("position"), "from_position"), ["path", "position"], "left")


def k8s_nodes(spark, d):
    """The resources of a manifest of two documents made for every supplier."""
    name = F.concat(F.lit("s"), "s_suppkey")
    body = F.concat(F.lit("apiVersion: v1\nkind: Service\nmetadata:\n  name: \""), name, F.lit("\"\n  labels:\n    name: no\nspec:\n  name: no\n---\nkind: Job\nmetadata:\n  namespace: n"), F.col("s_nationkey"), F.lit("\n  name: job-"), name, F.lit("\n"))
    files = table(spark, d, "supplier").select(F.concat(F.lit("k8s/"), name, F.lit(".yaml")).alias("path"), body.alias("content"))
    return extract.kubernetes_resources(files)


_ALL = (
    project_stats, label_counts, edge_type_counts, schema_listing, node_degree, degree_filter, find_nodes_page, like_name_search, cypher_eq, cypher_contains, entry_points, cluster_cohesion, cluster_top_nodes, package_tree,
    trace_outbound, trace_inbound, trace_both, enrich_layer1, snippet_neighbors, dedupe_edges, upsert_nodes, cascade_delete, delete_by_file, dangling_edges, code_facts, code_calls, code_graph, resolve_calls, fuzzy_calls, node_search, node_search_page, line_grep, line_in_node, snippets, impacted_nodes, dockerfile_nodes, k8s_nodes,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _module(path: str) -> str:
    return f"array_to_string(list_prepend(project, list_filter(string_split(regexp_replace({path}, '\\.[^./]+$', ''), '/'), lambda x: x not in ('', 'index', '__init__'))), '.')"


_RESOLVE = f"""
with fs as (select distinct project, relative_path, regexp_replace(relative_path, '/[^/]*$', '') || '/__init__.py' as init from file_states where project is not null and relative_path is not null),
reg as (select project, {_module('relative_path')} as qn from fs union select project, {_module('init')} || '.' || string_split(relative_path, '/')[1] from fs),
r as (select *, regexp_extract(qn, '([^.:]*)$', 1) as simple, ('0x' || substr(md5(qn), 1, 8))::ubigint as seq, count(*) over (partition by project, regexp_extract(qn, '([^.:]*)$', 1)) as n_all from reg),
c0 as (select distinct chunk_id as call_id, project, file_path, length(file_path) as n, case when length(file_path) % 11 < 5 then string_split(file_path, '/')[1] else regexp_replace(string_split(file_path, '/')[-1], '\\.[^.]+$', '') end as base, string_split('x/' || file_path, '/')[-2] as parent, regexp_replace(file_path, '/[^/]*$', '') || '/__init__.py' as init from code_chunks where file_path is not null and project is not null),
c1 as (select *, {_module('init')} as place from c0),
c as (select call_id, project, case n % 3 when 0 then base when 1 then parent || '.' || base else parent || '::' || base end as callee, case when n % 7 = 0 then place else project || '.src' end as module_qn, case when n % 2 = 0 then parent end as k, case when n % 2 = 0 then case when n % 5 = 0 then 'else.where' else place end end as v from c1),
b as (select *, regexp_extract(callee, '([^.:]*)$', 1) as simple, regexp_extract(callee, '^(.*?)(?:\\.|::)', 1) as prefix from c),
a as (select *, case when prefix <> '' then replace(regexp_replace(callee, '^.*?(?:\\.|::)', ''), '::', '.') end as rest, case when k = callee then v end as whole, case when k = prefix then v end as via, coalesce(v, '') <> '' as imported from b),
m as (select a.*, r.qn, r.seq, r.n_all, regexp_replace(r.qn, '[.:]+[^.:]*$', '') as mod, string_split(r.qn, '.') as x, string_split(a.module_qn, '.') as y from a join r on r.project = a.project and r.simple = a.simple where r.n_all <= 256),
s as (select *, coalesce(v <> '' and (contains(mod, v) or contains(v, mod)), false) as reach, case when regexp_matches(lower(simple), 'test|mock|stub|fake|fixture|spec') or regexp_matches(lower(qn), '(^|[._/])(test|mock|stub|fake|fixture|spec)s?[._/]') then 0 else 1000 end + len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])) as score from m),"""
_STRATEGIES = """
d as (select call_id, project, coalesce(via || '.' || rest, whole || '.' || simple) as qn, 'import_map' as strategy, 0.95 as confidence, 1 as candidate_count, 1 as priority from a
  union all select call_id, project, case when rest is null then whole end, 'import_map', 0.95, 1, 1 from a
  union all select call_id, project, module_qn || '.' || callee, 'same_module', 0.9, 1, 3 from a
  union all select call_id, project, module_qn || '.' || rest, 'same_module', 0.9, 1, 3 from a),
w as (select call_id, qn, strategy, confidence, candidate_count, priority from d where exists (select 1 from reg where reg.project = d.project and reg.qn = d.qn)
  union all select call_id, arg_min(qn, (-score, seq)), 'import_map_suffix', 0.85, 1, 2 from s where via is not null and rest is not null and starts_with(qn, via || '.') group by call_id
  union all select call_id, min(qn), 'qualified_suffix', 0.9, min(n_all), 4 from s where rest is not null and n_all > 1 and ends_with(qn, '.' || replace(callee, '::', '.')) group by call_id having count(*) = 1
  union all select call_id, qn, 'unique_name', case when imported and not reach then 0.375 else 0.75 end, n_all, 5 from s where n_all = 1
  union all select call_id, arg_min(qn, (-score, seq)), 'suffix_match', case when min(nr) = 0 and bool_and(imported) then 0.275 else 0.55 end * least(1.0, 5.0 / case when min(nr) > 1 then min(nr) else min(n_all) end), case when min(nr) > 1 then min(nr) else min(n_all) end, 6
    from (select *, count(*) filter (reach) over (partition by call_id) as nr from s where n_all > 1) where nr = 0 or reach group by call_id),
t as (select *, row_number() over (partition by call_id order by priority, qn) as i from w)
select c.call_id, coalesce(qn, '') as qualified_name, coalesce(strategy, '') as strategy, round(coalesce(confidence, 0), 6)::double as confidence, coalesce(candidate_count, 0)::bigint as candidate_count from c left join t on t.call_id = c.call_id and i = 1"""


def _node_bm25(offset: int, limit: int) -> str:
    from siftlode.plans.retrieval import bm25_sql

    fields = {"name": 1.0, "qualified_name": 2.0, "file_path": 0.5}
    return _G + ", nq as (select *, concat_ws('.', project, name) as qualified_name from n)," + bm25_sql("nq", "id", fields, "machinery customer steel n7 000000012", limit, offset)


def _walk(root: str, way: str, depth: int) -> str:
    a, b = ("source_id", "target_id") if way == "outbound" else ("target_id", "source_id")
    return f"with recursive {_N.strip()}, r(id, d) as (select '{root}', 0 union select e.{b}, d + 1 from r join e on e.{a} = r.id where d < {depth}) select id, min(d)::int as depth, '{way}' as direction from r where id <> '{root}' group by id"


def oracle_sql() -> dict[str, str]:
    near = "select source_id as id, 'callee' as direction, coalesce(name, 'id:' || target_id) as neighbour from e left join n on n.id = target_id where type = 'CALLS' union select target_id, 'caller', coalesce(name, 'id:' || source_id) from e left join n on n.id = source_id where type = 'CALLS'"
    lines = "string_split(content, chr(10))"
    return {
        "project_stats": _G + "select coalesce(a.project, b.project) as project, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges from (select project, count(*) as nodes from n group by 1) a full join (select 'sales' as project, count(*) as edges from e) b on a.project = b.project",
        "label_counts": _G + "select project, label, count(*) as n from n group by 1, 2",
        "edge_type_counts": _G + "select 'sales' as project, type, count(*) as n from e group by 2",
        "schema_listing": _G + "select distinct 'label' as kind, label as name from n union select 'type', type from e",
        "node_degree": _DEG + "select * from dg",
        "degree_filter": _DEG + "select id, name, in_degree, out_degree from dg join n using (id) where label = 'Function' and in_degree + out_degree >= 12 order by name, id limit 50",
        "find_nodes_page": _G + "select id, name from n where contains(lower(name), 'order1') order by name, id limit 20 offset 20",
        "like_name_search": _G + "select id, name from n where contains(lower(name), 'r#0000001') and contains(lower(file_path), 'customer') order by name, id limit 1000",
        "cypher_eq": _G + "select id, name from n where label = 'Method' and name = 'Supplier#000000003'",
        "cypher_contains": _G + "select id, name from n where label = 'Function' and contains(lower(name), '99')",
        "entry_points": _DEG + "select id, out_degree - 2 * in_degree as score from dg join n using (id) where label in ('Function', 'Method') and out_degree - 2 * in_degree > 0 order by 2 desc, 1 limit 10",
        "cluster_cohesion": _G + f", p as (select id, {_DIR} as folder from n), f as (select a.folder, count(*) as outgoing, count(*) filter (a.folder = b.folder) as internal from e join p a on a.id = source_id left join p b on b.id = target_id group by 1) select folder, size, coalesce(internal, 0) as internal, coalesce(outgoing, 0) as outgoing, round(case when coalesce(outgoing, 0) = 0 then 0 else internal / outgoing end, 6)::double as cohesion from (select folder, count(*) as size from p group by 1 having count(*) >= 2) left join f using (folder) order by size desc, folder limit 20",
        "cluster_top_nodes": _G + f"select folder, name, id, rank from (select {_DIR} as folder, name, id, row_number() over (partition by {_DIR} order by name, id) as rank from n) where rank <= 5",
        "package_tree": _G + ", s as (select string_split(file_path, '/') as p from n), x as (select array_to_string(p[1:k], '/') as path from (select p, unnest(range(1, len(p))) as k from s)) select path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent, len(string_split(path, '/'))::int as depth, count(*) as nodes from x group by 1",
        "trace_outbound": _walk("c1", "outbound", 3),
        "trace_inbound": _walk("p1", "inbound", 3),
        "enrich_layer1": _G + ", k as (select target_id as id, 'caller' as direction, coalesce(name, '?') as neighbour from e left join n on n.id = source_id where type = 'CALLS' union all select source_id, 'callee', coalesce(name, '?') from e left join n on n.id = target_id), g as (select id, direction, count(*) as c, list_sort(list(distinct neighbour))[1:3] as names from k group by 1, 2) select n.id, coalesce(a.c, 0) as callers, coalesce(b.c, 0) as callees, coalesce(array_to_string(a.names, ','), '') as top_callers, coalesce(array_to_string(b.names, ','), '') as top_callees, case when a.c is null and b.c is null then 'unused' when a.c is null and label = 'Function' then 'entry' else '' end as flag from n left join g a on a.id = n.id and a.direction = 'caller' left join g b on b.id = n.id and b.direction = 'callee'",
        "resolve_calls": _RESOLVE + _STRATEGIES,
        "fuzzy_calls": _RESOLVE + " f as (select *, row_number() over (partition by call_id order by reach desc, score desc, seq) as i from s) select call_id, qn as qualified_name, round(case when n_all = 1 then 0.4 else 0.3 end / case when v is not null and not reach then 2 else 1 end, 6)::double as confidence from f where i = 1",
        "node_search": _node_bm25(0, 50) + " select id, score from bm",
        "node_search_page": _node_bm25(20, 20) + " select id, name, score from bm join n using (id)",
        "trace_both": _G + """, ok as (select id from n where not (contains(lower(file_path), 'test') or contains(lower(file_path), 'spec'))),
i1 as (select distinct source_id as id from e join ok on ok.id = source_id where target_id = 'o1' and source_id <> 'o1'),
i2 as (select distinct source_id as id from e join ok on ok.id = source_id where target_id in (select id from i1) and source_id <> 'o1' and source_id not in (select id from i1)),
o1 as (select distinct target_id as id from e join ok on ok.id = target_id where source_id = 'o1' and target_id <> 'o1' and target_id not in (select id from i1 union select id from i2)),
o2 as (select distinct target_id as id from e join ok on ok.id = target_id where source_id in (select id from o1) and target_id <> 'o1' and target_id not in (select id from i1 union select id from i2 union select id from o1))
select id, 1 as depth, 'inbound' as direction from i1 union all select id, 2, 'inbound' from i2 union all select id, 1, 'outbound' from o1 union all select id, 2, 'outbound' from o2""",
        "snippet_neighbors": _G + f"select id, direction, count(*) as n, min(neighbour) as first from ({near}) group by 1, 2",
        "dedupe_edges": _G + "select 'sales' as project, source_id, target_id, type, '{\"again\":1}' as properties from e",
        "upsert_nodes": _G + ", k as (select label, case when label = 'Class' then upper(name) else name end as name, project, project || '.' || n.name as q from n), u as (select distinct on (project, q) * from k order by project, q, label) select label, count(*) as n, count(*) filter (name = upper(name))::bigint as upper from u group by 1",
        "cascade_delete": _G + "select label, count(*)::bigint as n from n where label <> 'Method' group by 1 union all select type, count(*) from e where source_id not like 's%' group by 1",
        "delete_by_file": _G + ", g as (select id from n where file_path like 'customer/n1%') select type as kind, count(*) as n from e where source_id not in (select id from g) and target_id not in (select id from g) group by 1 union all select 'nodes', count(*) from n where id not in (select id from g)",
        "dangling_edges": _G + ", k as (select id from n where label <> 'Class' or id like '%1') select type, count(*) as n from e where source_id in (select id from k) and target_id in (select id from k) group by 1",
        "line_grep": f"select path, line, text from (select concat_ws('|', project, rel_path) as path, unnest(range(1, len({lines}) + 1))::int as line, unnest({lines}) as text from (select project, rel_path, min(content) as content from files where content is not null group by 1, 2)) where contains(lower(text), 'watermark')",
        "line_in_node": "with s as (select distinct vec_id as id, concat_ws('|', project, relative_path) as path, start_line, end_line from vector_documents where start_line > 0 and end_line >= start_line), l as (select distinct path, unnest([1, start_line + 2, end_line + 5])::bigint as line from s) select l.path, l.line, coalesce(arg_min(s.id, (end_line - start_line, s.id))::varchar, '-1') as node_id from l left join s on s.path = l.path and line between start_line and end_line group by 1, 2",
        "snippets": f"select distinct project, rel_path, array_to_string({lines}[3:7], chr(10)) as code from files where content is not null",
        "impacted_nodes": _G + "select id from n where file_path in ('part/s7/p.ts', 'order/F/o.ts')",
        "dockerfile_nodes": "select 'p' || p_partkey || '/Dockerfile' as path, unnest([1, 2, 3])::int as position, unnest(['FROM', 'RUN', 'COPY']) as instruction, unnest([p_brand || ':' || p_size, p_type || ' &&    ' || p_name, '. /' || p_partkey]) as argument, unnest([1, 3, 6])::bigint as line, unnest([null, 1, 2])::int as from_position from part",
        "k8s_nodes": "select 'k8s/s' || s_suppkey || '.yaml' as path, unnest(['Service', 'Job']) as kind, unnest(['s' || s_suppkey, 'job-s' || s_suppkey]) as name, unnest(['', 'n' || s_nationkey]) as namespace, unnest([2, 10])::int as line from supplier",
    }
