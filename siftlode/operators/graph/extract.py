"""From source files to graph rows: definitions, imports, calls, routes, Dockerfiles and Kubernetes manifests.

Python is parsed with the standard library; other languages by line patterns and brace depth, which is approximate.
Files are parsed in map-only tasks; calls are resolved later by joins.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlode.functions.text import graph_language, module_name
from siftlode.runtime import spread

_NAME = r"([A-Za-z_$][\w$]*)"
#: Patterns of a definition's first line, with the label it makes.
_DEFINITIONS = {
    "typescript": [(rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}", "Function"), (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", "Class"), (rf"^\s*(?:export\s+)?interface\s+{_NAME}", "Interface"), (rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_NAME}", "Enum"), (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "Function"), (rf"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!if|for|while|switch|catch|return|function){_NAME}\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?::[^;{{]+)?\{{\s*$", "Method")],
    "go": [(rf"^func\s+\([^)]*\)\s*{_NAME}", "Method"), (rf"^func\s+{_NAME}", "Function"), (rf"^type\s+{_NAME}\s+struct", "Struct"), (rf"^type\s+{_NAME}\s+interface", "Interface")],
    "rust": [(rf"^\s+(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", "Method"), (rf"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", "Function"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}", "Struct"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}", "Enum"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}", "Interface")],
    "java": [(rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+{_NAME}", "Class"), (rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_NAME}", "Interface"), (rf"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_NAME}", "Enum"), (rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return|new|else|throw)[\w<>\[\],.? ]+\s+{_NAME}\s*\([^;]*\)\s*(?:throws[^{{]*)?\{{", "Method")],
    "csharp": [(rf"^\s*(?:(?:public|private|protected|internal|static|sealed|abstract|partial)\s+)*(?:class|record)\s+{_NAME}", "Class"), (rf"^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+{_NAME}", "Interface"), (rf"^\s*(?:(?:public|private|protected|internal|readonly)\s+)*struct\s+{_NAME}", "Struct"), (rf"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+{_NAME}", "Enum"), (rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)*(?!return|new|else|throw)[\w<>\[\],.? ]+\s+{_NAME}\s*\([^;]*\)\s*\{{", "Method")],
    "cpp": [(rf"^\s*(?:class|struct)\s+{_NAME}[^;]*\{{", "Class"), (rf"^\s*enum\s+(?:class\s+)?{_NAME}", "Enum"), (rf"^(?!return|else|if|for|while|switch)(?:[\w:<>,~*&]+[\s*&]+)+(?:\w+::)*{_NAME}\s*\([^;]*\)[^;]*\{{", "Function"), (rf"^\s+(?!return|else|if|for|while|switch|throw)(?:[\w:<>,~*&]+[\s*&]+)+{_NAME}\s*\([^;]*\)[^;=]*\{{", "Method")],
}
_DEFINITIONS["javascript"] = _DEFINITIONS["typescript"]
_DEFINITIONS = {k: [(re.compile(p), label) for p, label in v] for k, v in _DEFINITIONS.items()}
#: A variable at the top level of a file.
_VARIABLE = {
    "typescript": re.compile(rf"^(?:export\s+)?(?:const|let|var)\s+{_NAME}\b"), "go": re.compile(rf"^(?:var|const)\s+{_NAME}\b"),
    "rust": re.compile(rf"^(?:pub(?:\([^)]*\))?\s+)?(?:static|const)\s+(?:mut\s+)?{_NAME}\s*:"),
}
_VARIABLE["javascript"] = _VARIABLE["typescript"]
_IMPORTS = {
    "typescript": re.compile(r"^\s*import\s+(?:type\s+)?(.+?)\s+from\s+['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\)", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$", re.M),
    "rust": re.compile(r"^\s*use\s+([\w:]+)(?:::\{[^}]*\})?", re.M),
    "java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?;", re.M),
    "csharp": re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+);", re.M),
    "cpp": re.compile(r"^\s*#include\s+[<\"]([^>\"]+)[>\"]", re.M),
}
_IMPORTS["javascript"] = _IMPORTS["typescript"]
_CALL = re.compile(r"(?<![\w.$])((?:[A-Za-z_$][\w$]*(?:\.|::))*[A-Za-z_$][\w$]*)\s*\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn def class new throw sizeof typeof await match elif except with and or not in is lambda super assert defer go select print".split())
#: Patterns of a web route: method and path.
_ROUTES = [
    re.compile(r"\b(?:app|router|server|fastify|api)\.(get|post|put|patch|delete|all)\(\s*['\"`]([^'\"`]+)['\"`](?:[^)]*?,\s*(\w+)\s*\))?"),
    re.compile(r"@(?:app|router|bp|blueprint|api)\.(get|post|put|patch|delete|route)\(\s*['\"]([^'\"]+)['\"]"),
    re.compile(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?['\"]([^'\"]+)['\"]"),
    re.compile(r"\.(HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE)\(\s*\"([^\"]+)\"(?:\s*,\s*(\w+))?"),
    re.compile(r"\[Http(Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\""),
]


def _python_rows(text: str) -> tuple[list, list, list]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], []
    defs, imports, calls = [], [], []

    def name_of(node) -> str:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            inner = name_of(node.value)
            return f"{inner}.{node.attr}" if inner else node.attr
        return ""

    def walk(node, outer: str, in_class: bool, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                qn = f"{outer}.{child.name}" if outer else child.name
                defs.append((qn, child.name, "Class" if cls else "Method" if in_class else "Function", child.lineno, child.end_lineno))
                walk(child, qn, cls, owner if cls else qn)
                continue
            if isinstance(child, ast.Import):
                imports.extend((a.asname or a.name, a.name, child.lineno) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                imports.extend((a.asname or a.name, module, child.lineno) for a in child.names)
            elif isinstance(child, ast.Call) and (callee := name_of(child.func)):
                calls.append((owner, callee, child.lineno))
            walk(child, outer, in_class, owner)

    for top in tree.body:
        targets = top.targets if isinstance(top, ast.Assign) else [top.target] if isinstance(top, ast.AnnAssign) else []
        defs.extend((t.id, t.id, "Variable", top.lineno, top.end_lineno) for t in targets if isinstance(t, ast.Name))
    walk(tree, "", False, "")
    return defs, imports, calls


def _line_rows(text: str, lang: str) -> tuple[list, list, list]:
    lines = text.split("\n")
    defs: list[list] = []
    open_: list[tuple[int, int]] = []  # (depth before, index in defs)
    calls, depth = [], 0
    for k, line in enumerate(lines, 1):
        bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|//.*$", "", line)
        made = False
        for pattern, label in _DEFINITIONS[lang]:
            m = pattern.match(bare)
            if m:
                name = next(g for g in m.groups() if g)
                outer = defs[open_[-1][1]][0] if open_ else ""
                defs.append([f"{outer}.{name}" if outer else name, name, label, k, k])
                if "{" in bare or lang not in ("go",):
                    open_.append((depth, len(defs) - 1))
                made = True
                break
        if not made and depth == 0 and lang in _VARIABLE and (m := _VARIABLE[lang].match(bare)):
            defs.append([m.group(1), m.group(1), "Variable", k, k])
        if not made:
            owner = next((defs[i][0] for _, i in reversed(open_) if defs[i][2] in ("Function", "Method")), "")
            calls += [(owner, c, k) for c in _CALL.findall(bare) if c not in _NOT_CALLS]
        depth += bare.count("{") - bare.count("}")
        while open_ and depth <= open_[-1][0] and (k > defs[open_[-1][1]][3] or "}" in bare):
            defs[open_.pop()[1]][4] = k
    for _, i in open_:
        defs[i][4] = len(lines)
    imports = []
    for m in _IMPORTS[lang].finditer(text):
        groups = [g for g in m.groups() if g]
        path = groups[-1]
        names = re.findall(r"[A-Za-z_$][\w$]*", groups[0]) if len(groups) > 1 else [re.split(r"[./:]+", path)[-1]]
        imports += [(n, path, text.count("\n", 0, m.start()) + 1) for n in names if n not in ("as", "type")]
    return [tuple(d) for d in defs], imports, calls


def routes_of(text: str) -> list[tuple[str, str, str, int]]:
    """(method, path, handler, line) of the web routes a text declares."""
    found = []
    for pattern in _ROUTES:
        for m in pattern.finditer(text):
            method = (m.group(1) or "any").strip(". ").upper()
            handler = m.group(3) if pattern.groups > 2 and m.group(3) else ""
            found.append((method, re.sub(r"\$\{[^}]*\}", ":param", m.group(2)), handler, text.count("\n", 0, m.start()) + 1))
    return sorted(set(found), key=lambda r: (r[3], r))


FACTS = "project string, path string, kind string, name string, detail string, label string, start_line int, end_line int"


def file_facts(files: DataFrame, project_col: str = "project", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(project, path, kind, name, detail, label, start_line, end_line), kind def, import, call or route.

    A def has its dotted name in the file in detail; an import its path; a call its callee in name and its enclosing
    definition in detail; a route its path in name and handler in detail. Files of unknown language, and texts that
    cannot be read, give no rows.
    """
    base = files.select(F.col(project_col).alias("project"), F.col(path_col).alias("path"), graph_language(F.col(path_col)).alias("lang"), F.col(content_col).alias("text")).where("text is not null and lang <> '' and lang <> 'yaml'")

    def run(batches):
        for batch in batches:
            rows = []
            for project, path, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                defs, imports, calls = _python_rows(text) if lang == "python" else _line_rows(text, lang)
                rows += [(project, path, "def", n, qn, label, a, b) for qn, n, label, a, b in defs]
                rows += [(project, path, "import", n, p, "", a, a) for n, p, a in imports]
                rows += [(project, path, "call", c, owner, "", a, a) for owner, c, a in calls]
                rows += [(project, path, "route", p, h, m, a, a) for m, p, h, a in routes_of(text)]
            types = [pa.string()] * 6 + [pa.int32()] * 2
            cols = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["project", "path", "kind", "name", "detail", "label", "start_line", "end_line"])

    return spread(base).mapInArrow(run, FACTS)


def _qualified(detail: Column) -> Column:
    return F.concat_ws(".", module_name(F.col("project"), F.col("path")), F.when(detail == "", F.lit(None)).otherwise(detail))


def graph_of(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, registry, calls) of facts: definitions as nodes, and the inputs of call resolution, by project.

    The imports of a file travel as one map a file, joined to its calls; of a name imported twice the first path counts.
    """
    defs = facts.where("kind = 'def'")
    qn = _qualified(F.col("detail"))
    nodes = defs.select(F.xxhash64("project", qn).alias("id"), "project", "label", "name", qn.alias("qualified_name"), F.col("path").alias("file_path"), "start_line", "end_line", F.lit("{}").alias("properties")).dropDuplicates(["project", "qualified_name"])
    order = F.xxhash64("id")  # a stable order of definitions
    registry = nodes.where(F.col("label").isin("Function", "Method", "Class")).select("project", order.alias("seq"), "name", "qualified_name", "label")
    once = facts.where("kind = 'import'").groupBy("project", "path", "name").agg(F.min("detail").alias("detail"))
    dotted = F.regexp_replace(F.regexp_replace("detail", r"^[./]+", ""), "[/:]+", ".")
    pairs = F.array_sort(F.collect_list(F.struct("name", dotted.alias("value"))))
    imports = once.groupBy("project", "path").agg(pairs.alias("i"))
    calls = facts.where("kind = 'call'").join(imports, ["project", "path"], "left")
    names, values = F.transform("i", lambda x: x["name"]), F.transform("i", lambda x: x["value"])
    none = F.array().cast("array<string>")
    rows = calls.select("project", F.xxhash64("project", "path", "detail", "name", "start_line").alias("call_id"), F.col("name").alias("callee"), module_name(F.col("project"), F.col("path")).alias("module_qn"), F.coalesce(names, none).alias("import_keys"), F.coalesce(values, none).alias("import_vals"), _qualified(F.col("detail")).alias("caller_qn"))
    return nodes, registry, rows.dropDuplicates(["call_id"])


def call_edges(calls: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, source_id, target_id, type, properties): resolved calls between known definitions, no self calls."""
    ids = nodes.select("id", "qualified_name", "project", "file_path")
    met = calls.select("project", "call_id", "caller_qn").join(resolved.where("qualified_name <> ''"), "call_id")
    src = ids.select("project", F.col("id").alias("source_id"), F.col("qualified_name").alias("caller_qn"), F.col("file_path").alias("source_file"))
    tgt = ids.select("project", F.col("id").alias("target_id"), "qualified_name", F.col("file_path").alias("target_file"))
    both = met.join(src, ["project", "caller_qn"]).join(tgt, ["project", "qualified_name"]).where("source_id <> target_id")
    props = F.to_json(F.struct("strategy", "confidence", (F.col("source_file") != F.col("target_file")).alias("crossFile")))
    return both.groupBy("project", "source_id", "target_id").agg(F.max(props).alias("properties")).select("project", "source_id", "target_id", F.lit("CALLS").alias("type"), "properties")


_NODE = ("id", "project", "label", "name", "qualified_name", "file_path", "start_line", "end_line", "properties")


def _node(rows: DataFrame, label: str, name: Column, qn: Column, properties: Column) -> DataFrame:
    made = rows.select(F.xxhash64("project", qn).alias("id"), "project", F.lit(label).alias("label"), name.alias("name"), qn.alias("qualified_name"), F.col("path").alias("file_path"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), properties.alias("properties"))
    return made.dropDuplicates(["project", "qualified_name"]).select(*_NODE)


def module_rows(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module nodes of imports, one a project and import path, and IMPORTS edges from the definitions that call what was imported.

    A node lists its imported names; an edge goes from a definition whose call's first part is an imported name.
    """
    imports = facts.where("kind = 'import'").select("project", "path", F.col("name").alias("imported"), "detail", "start_line")
    grouped = imports.groupBy("project", "detail").agg(F.min(F.struct("path", "start_line")).alias("at"), F.array_sort(F.collect_set("imported")).alias("names"))
    rows = grouped.select("project", F.col("at.path").alias("path"), F.col("at.start_line").alias("start_line"), F.col("at.start_line").alias("end_line"), "detail", "names")
    qn = F.concat_ws(".", "project", F.lit("module"), "detail")
    modules = _node(rows, "Module", F.col("detail"), qn, F.to_json(F.struct(F.col("detail").alias("importPath"), F.col("names").alias("importedNames"))))
    head = F.regexp_extract("name", r"^([^.:]+)", 1)
    used = facts.where("kind = 'call'").select("project", "path", head.alias("imported"), _qualified(F.col("detail")).alias("qualified_name"))
    met = used.join(imports.select("project", "path", "imported", "detail"), ["project", "path", "imported"])
    src = met.join(nodes.select("project", "qualified_name", F.col("id").alias("source_id")), ["project", "qualified_name"])
    edges = src.groupBy("project", "source_id", F.xxhash64("project", qn).alias("target_id")).agg(F.to_json(F.struct(F.array_sort(F.collect_set("imported")).alias("names"))).alias("properties"))
    return modules, edges.select("project", "source_id", "target_id", F.lit("IMPORTS").alias("type"), "properties")


def route_rows(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route nodes (method and path), and HANDLES edges to the handler of that name in the route's file."""
    rows = facts.where("kind = 'route'").withColumnRenamed("name", "route")
    title = F.concat_ws(" ", "label", "route")
    qn = F.concat(F.col("project"), F.lit(".route."), F.regexp_replace("path", "/", "."), F.lit("."), F.col("label"), F.lit(":"), F.col("route"))
    routes = _node(rows, "Route", title, qn, F.to_json(F.struct(F.col("label").alias("method"), F.col("route").alias("path"), F.col("detail").alias("handlerName"))))
    named = rows.where("detail <> ''").select("project", F.col("path").alias("file_path"), F.col("detail").alias("name"), F.xxhash64("project", qn).alias("source_id"), F.to_json(F.struct(F.col("label").alias("method"), F.col("route").alias("path"))).alias("properties"))
    handlers = nodes.where(F.col("label").isin("Function", "Method")).groupBy("project", "file_path", "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("target_id"))
    edges = named.join(handlers, ["project", "file_path", "name"]).groupBy("project", "source_id", "target_id").agg(F.min("properties").alias("properties"))
    return routes, edges.select("project", "source_id", "target_id", F.lit("HANDLES").alias("type"), "properties")


def resource_rows(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resource nodes of Dockerfiles and manifests of (project, path, content), and CONFIGURES edges between instructions."""
    from siftlode.functions.text import is_dockerfile

    keyed = files.where("content is not null").select("project", "path", F.concat_ws("\n", "project", "path").alias("key"), "content")
    docker, steps = dockerfile_resources(keyed.where(is_dockerfile(F.col("path"))), "key")
    named = lambda df: df.select(F.element_at(F.split("path", "\n"), 1).alias("project"), F.element_at(F.split("path", "\n"), 2).alias("file"), *[c for c in df.columns if c != "path"]).withColumnRenamed("file", "path")
    rows = named(docker).withColumn("start_line", F.col("line")).withColumn("end_line", F.col("line"))
    qn = F.concat(F.col("project"), F.lit(".dockerfile."), F.col("path"), F.lit(".L"), F.col("line").cast("string"), F.lit("."), F.col("instruction"))
    title = F.concat(F.col("instruction"), F.lit(" "), F.substring("argument", 1, 60))
    image = F.when(F.col("instruction") == "FROM", F.element_at(F.split("argument", ":"), 1))
    props = F.to_json(F.struct("instruction", F.col("argument").alias("args"), F.lit("dockerfile").alias("language"), image.alias("baseImage"), F.when(F.col("instruction") == "EXPOSE", F.col("argument")).alias("port"), F.when(F.col("instruction") == "ENV", F.element_at(F.split("argument", "="), 1)).alias("envVar")))
    nodes = _node(rows, "Resource", title, qn, props)
    at = rows.select("project", "path", "position", F.xxhash64("project", qn).alias("id"))
    linked = named(steps).join(at.select("project", "path", F.col("position").alias("from_position"), F.col("id").alias("source_id")), ["project", "path", "from_position"])
    linked = linked.join(at.select("project", "path", F.col("position").alias("to_position"), F.col("id").alias("target_id")), ["project", "path", "to_position"])
    edges = linked.select("project", "source_id", "target_id", F.lit("CONFIGURES").alias("type"), F.to_json(F.struct(F.col("to_position").alias("order"))).alias("properties"))
    manifests = named(kubernetes_resources(keyed.where(F.lower("path").rlike(r"\.ya?ml$")), "key")).withColumn("start_line", F.col("line")).withColumn("end_line", F.col("line"))
    kube = _node(manifests, "Resource", F.concat_ws("/", "kind", "name"), F.concat(F.col("project"), F.lit(".k8s."), F.col("path"), F.lit("."), F.col("kind"), F.lit("."), F.col("name"), F.lit(".L"), F.col("line").cast("string")), F.to_json(F.struct("kind", "name", "namespace", F.lit("kubernetes").alias("language"))))
    return nodes.unionByName(kube), edges


def graph_rows(facts: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of facts: definitions, modules and routes; calls, imports and handlers.

    Calls resolve against ``registry`` where it is given, so that part of a project can be read anew.
    """
    from siftlode.operators.graph.resolve import resolve_calls

    nodes, own, calls = graph_of(facts)
    known = own if registry is None else registry
    modules, imported = module_rows(facts, nodes)
    routes, handled = route_rows(facts, nodes)
    return nodes.unionByName(modules).unionByName(routes), call_edges(calls, resolve_calls(calls, known), nodes).unionByName(imported).unionByName(handled)


def dockerfile_resources(files: DataFrame, path_col: str = "path", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Dockerfile instructions: nodes (path, position, instruction, argument, line), edges (path, from_position, to_position).

    Comments and blank lines are skipped; a line ending in a backslash goes on in the next. Each instruction
    configures the one after it in the file.
    """
    joined = F.regexp_replace(F.regexp_replace(F.col(content_col), r"\r", ""), r"\\\n", "\u0001")
    lines = files.select(F.col(path_col).alias("path"), F.posexplode(F.split(joined, "\n")).alias("at", "raw"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    folds = F.length("raw") - F.length(F.translate("raw", "\u0001", ""))
    numbered = lines.withColumn("line", F.col("at") + 1 + F.coalesce(F.sum(folds).over(before), F.lit(0)))
    text = F.trim(F.translate("raw", "\u0001", " "))
    rows = numbered.select("path", "line", F.upper(F.regexp_extract(text, r"^([A-Za-z]+)\s", 1)).alias("instruction"), F.regexp_extract(text, r"^[A-Za-z]+\s+(.*)$", 1).alias("argument")).where("instruction <> ''")
    w = Window.partitionBy("path").orderBy("line")
    nodes = rows.withColumn("position", F.row_number().over(w)).select("path", "position", "instruction", "argument", "line")
    edges = nodes.select("path", F.lag("position").over(Window.partitionBy("path").orderBy("position")).alias("from_position"), F.col("position").alias("to_position")).where("from_position is not null")
    return nodes, edges


def manifest_resources(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, namespace, line) of each document of a Kubernetes manifest that has a kind."""
    found, kind, name, space, line, meta = [], "", "", "", 0, None
    for k, raw in enumerate([*text.split("\n"), "---"], 1):
        bare = raw.rstrip("\r")
        if bare.strip() == "---":
            if kind:
                found.append((kind, name or "unnamed", space, line))
            kind, name, space, meta = "", "", "", None
            continue
        m = re.match(r"^(\s*)([\w.-]+):\s*(.*?)\s*(?:#.*)?$", bare)
        if not m:
            continue
        indent, key, value = len(m.group(1)), m.group(2), m.group(3).strip("'\"")
        if indent == 0:
            meta = 0 if key == "metadata" else None
            if key == "kind":
                kind, line = value, k
        elif meta is not None:
            meta = meta or indent
            if indent == meta and key == "name":
                name = value
            elif indent == meta and key == "namespace":
                space = value
    return found


def kubernetes_resources(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, kind, name, namespace, line) of all manifests."""

    def run(batches):
        for batch in batches:
            rows = [(p, *r) for p, t in zip(*(c.to_pylist() for c in batch.columns)) for r in manifest_resources(t or "")]
            types = [pa.string()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [()] * 5, types)], ["path", "kind", "name", "namespace", "line"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("text")).mapInArrow(run, "path string, kind string, name string, namespace string, line int")
