"""The engine as one object: index a folder, search it, look at its graph, keep it current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlode.functions.paths import extension_list
from siftlode.functions.text import collection_name
from siftlode.operators import chunking, retrieval, sync
from siftlode.operators.embedding import Embedder, HashingEmbedder, with_vectors
from siftlode.operators.fulltext import FullTextIndex
from siftlode.operators.graph import architecture, extract, resolve, search, tables, trace
from siftlode.runtime import cut, ship
from siftlode.sources import files
from siftlode.sources.collection import CollectionCatalog, document_rows
from siftlode.sources.versions import Versions
from siftlode.state import Abort, Files, Lock, StatusStore

_STATES = "path string, hash string"


class Engine:
    """Collections, file states, full-text indexes and graphs under one folder.

    With ``cells`` dense search probes an inverted file of that many cells instead of reading all vectors of a project.
    """

    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None, cells: int | None = None, probes: int = 4):
        ship(spark)
        self.spark, self.home, self.embedder, self.cells, self.probes = spark, home.rstrip("/"), embedder or HashingEmbedder(), cells, probes
        self.catalog = CollectionCatalog(spark, f"{self.home}/collections")
        self.graph = Graph(spark, f"{self.home}/graph")
        self.files = Files(spark, self.home)
        self.statuses = StatusStore(self.files)
        self._cells: dict[str, retrieval.InvertedFile] = {}

    def _name(self, project: str) -> str:
        return self.spark.range(1).select(collection_name(F.lit(project))).first()[0]

    def _states(self, name: str) -> Versions:
        return Versions(self.spark, f"{self.home}/states/{name}")

    def _terms(self, name: str) -> FullTextIndex:
        return FullTextIndex(self.spark, f"{self.home}/terms/{name}")

    def index(self, root: str, project: str | None = None, extensions: list[str] | None = None, ignore: list[str] | None = None, splitter: str | chunking.Splitter = "definitions", most: int = 450_000, abort: Abort | None = None) -> dict:
        """Index a folder anew; gives the status and the counts. A project is replaced as a whole, last its states.

        A run that reaches ``most`` chunks stops at the end of a file, and states are written for the files it has, so
        ``sync`` goes on with the rest. A run that fails or is stopped leaves the status indexfailed.
        """
        project = project or files.repository_identity(root)
        options = {"request_custom_extensions": extensions or [], "request_ignore_patterns": ignore or [], "request_splitter": splitter if isinstance(splitter, str) else ""}
        self.statuses.indexing(project, root, 0, options)
        try:
            found = self._scan(root, extensions, ignore)
            name = self._name(project)
            if abort:
                abort.check()
            self.catalog.drop(name)
            self.catalog.create(name)
            self._states(name).clear()
            return self._write(root, project, found, found, None, splitter, most, abort)
        except Exception as e:
            self.statuses.failed(project, root, str(e)[:500], 0)
            raise

    def _scan(self, root: str, extensions: list[str] | None, ignore: list[str] | None) -> DataFrame:
        rules = files.ignore_patterns(root) + list(ignore or [])
        return cut(files.scan(self.spark, root, extensions, rules), "files")

    def _write(self, root: str, project: str, found: DataFrame, live: DataFrame, changes: DataFrame | None, splitter, most: int, abort: Abort | None) -> dict:
        """Put the chunks of ``live`` files in the place of theirs, then the index, the states and the graph."""
        name = self._name(project)
        rows = cut(self._rows(live, project, splitter), "rows")
        kept, left = chunking.capped(rows, most, "relative_path")
        kept, left = cut(kept, "kept"), cut(left.withColumnRenamed("relative_path", "path"), "left")
        if abort:
            abort.check()
        if changes is None:
            self.catalog.insert(name, kept, self.embedder.dimension)
        else:
            old = self.catalog.read(name).withColumnRenamed("relative_path", "path")
            fresh = kept.withColumnRenamed("relative_path", "path").select(*old.columns)
            merged = cut(sync.apply_changes(old, changes, fresh).withColumnRenamed("path", "relative_path"), "merged")
            self.catalog.put(name, project, merged)
        self.statuses.progress(project, 1, 3)
        docs = self.catalog.read(name).where(F.col("project") == project)
        self._terms(name).build(docs, "id", {"content": 1.0})
        if self.cells:
            self._cells[name] = retrieval.InvertedFile(self.cells).fit(docs, "id", "vector")
            self._cells[name].store(docs.select("id", "vector"), f"{self.home}/cells/{name}", "vector")
        self.statuses.progress(project, 2, 3)
        self.graph.update(found.withColumn("project", F.lit(project)), None if changes is None else changes, project)
        self._states(name).write(files.file_states(found).join(left, "path", "left_anti"))
        outcome = "limit_reached" if not left.isEmpty() else "completed"
        counts = {"indexed_files": found.join(left, "path", "left_anti").count(), "total_chunks": docs.count()}
        self.statuses.indexed(project, root, counts["indexed_files"], counts["total_chunks"], outcome)
        return {"project": project, "status": outcome} | counts

    def _rows(self, found: DataFrame, project: str, splitter) -> DataFrame:
        pieces = chunking.chunk_files(found, splitter)
        cut_up = pieces.select("path", "start_line", "end_line", "seq", F.posexplode(chunking.split_lines(F.col("content"))).alias("part", "content"))
        ordered = chunking.with_chunk_index(cut_up.withColumn("order", F.col("seq") * 100000 + F.col("part")), order="order")
        languages = found.select("path", "language")
        made = with_vectors(ordered.join(languages, "path"), self.embedder)
        rows = document_rows(made, project)
        return rows.withColumn("id", F.concat("id", F.lit(":"), F.get_json_object("metadata", "$.chunkIndex")))

    def sync(self, root: str, project: str | None = None, extensions: list[str] | None = None, ignore: list[str] | None = None, splitter: str | chunking.Splitter = "definitions", most: int = 450_000, abort: Abort | None = None) -> dict:
        """Index what changed since the last run, and what it left; states are written last, so a failure loses nothing.

        After a run that failed half-way all files are read anew: chunks are replaced by path, so none is there twice.
        """
        project = project or files.repository_identity(root)
        name = self._name(project)
        if not self.catalog.has(name):
            self.index(root, project, extensions, ignore, splitter, most, abort)
            return {"added": self.statuses.get(project).get("indexed_files", 0), "removed": 0, "modified": 0}
        broken = self.statuses.status(project) == "indexfailed"
        found = self._scan(root, extensions, ignore)
        before = self._states(name).read(_STATES)
        known = self.catalog.read(name).where(F.col("project") == project).select(F.col("relative_path").alias("path")).distinct().withColumn("hash", F.lit(""))
        changes = cut(sync.file_diff(known if broken else before, files.file_states(found)), "changes")
        counts = {r["change"]: r["n"] for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if counts:
            self.statuses.indexing(project, root, 0)
            try:
                live = found.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
                self._write(root, project, found, live, changes, splitter, most, abort)
            except Exception as e:
                self.statuses.failed(project, root, str(e)[:500], 0)
                raise
        return {k: counts.get(k, 0) for k in ("added", "removed", "modified")}

    def sync_all(self, roots: dict[str, str] | None = None, lock: Lock | None = None) -> list[dict]:
        """Sync every indexed project, or the given ones (project to folder), under the lock of this home.

        A folder that is gone is passed over, an error is noted and the next project goes on; nothing happens if
        another process holds the lock.
        """
        lock = lock or Lock(self.files)
        if not lock.acquire():
            return []
        done = []
        try:
            for project, root in sorted((roots or {p: self.statuses.get(p)["local_path"] for p in self.statuses.listed("indexed")}).items()):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
                if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                    done.append({"project": project, "error": "the folder is gone"})
                    continue
                try:
                    info = self.statuses.get(project)
                    done.append({"project": project, "error": None} | self.sync(root, project, info.get("request_custom_extensions"), info.get("request_ignore_patterns"), info.get("request_splitter") or "definitions"))
                except Exception as e:
                    done.append({"project": project, "error": str(e)[:500]})
        finally:
            lock.release()
        return done

    def search(self, project: str, query: str, limit: int = 10, extensions: list[str] | None = None, hybrid: bool = True, threshold: float | None = None) -> DataFrame:
        """(rank, content, relative_path, start_line, end_line, language, score): fused hits without overlaps.

        Words are looked up in the stored index, vectors in the probed cells if there are any. Contents are fetched
        after ranking, for the hits only. Where neither finds anything, nodes of the graph named like the query are
        given instead, with their lines.
        """
        k, name = min(limit, 50), self._name(project)
        docs = self.catalog.read(name).where(F.col("project") == project)
        if extensions:
            docs = docs.where(F.col("file_extension").isin(*extension_list(extensions)))
        vector = self.embedder.embed_batch([query or " "])[0]
        index = self._cells.get(name)
        pool = docs
        if index is not None and not extensions:
            pool = self.spark.read.parquet(f"{self.home}/cells/{name}").where(F.col("cell").isin(index.cells_of(vector, self.probes)))
        hits = dense = retrieval.dense_topk(pool, vector, k, threshold=threshold)
        if hybrid:
            scored = self._terms(name).scores(retrieval.text.words_of(query)).where("score > 0")
            if extensions:
                scored = scored.join(docs.select("id"), "id", "left_semi")
            hits = retrieval.rrf(dense, scored.orderBy(F.desc("score"), "id").limit(k), k).select("id", "score")
        rows = retrieval.ranked(hits).join(docs.select("id", "content", F.col("relative_path").alias("file"), "start_line", "end_line", "metadata"), "id")
        rows = cut(rows, "hits")
        if rows.isEmpty():
            return self._by_name(project, query, k)
        kept = retrieval.drop_overlaps(rows).select("rank", "id")
        out = rows.join(kept, ["rank", "id"]).select("rank", "content", F.col("file").alias("relative_path"), "start_line", "end_line", F.coalesce(F.get_json_object("metadata", "$.language"), F.lit("unknown")).alias("language"), "score")
        return out.orderBy("rank")

    def _by_name(self, project: str, query: str, k: int) -> DataFrame:
        nodes = self.graph.find_text(project, query, k)
        rows = nodes.select("id", F.col("qualified_name").alias("content"), F.col("file_path").alias("relative_path"), F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.lit("unknown").alias("language"), "score")
        return retrieval.ranked(rows).select("rank", "content", "relative_path", "start_line", "end_line", "language", "score").orderBy("rank")

    def context(self, project: str, hits: DataFrame) -> dict[str, DataFrame]:
        """What the graph knows about search hits, in three layers.

        ``relations``: the nodes of the hits' files with their callers and callees; ``chain``: what the first function
        of the best hit's file reaches and is reached from, to depth 3; ``architecture``: entry points and clusters.
        """
        nodes, edges = self.graph.nodes(project), self.graph.edges(project)
        ranked = cut(hits.select("rank", F.col("relative_path").alias("file_path")), "context")
        near = nodes.join(ranked.select("file_path").distinct(), "file_path", "left_semi")
        relations = search.enrich(nodes, edges).join(near.select("id", "name", "file_path", "start_line"), "id")
        first = ranked.orderBy("rank").limit(1).select("file_path")
        root = nodes.join(first, "file_path", "left_semi").where(F.col("label").isin("Function", "Method")).orderBy("name", "id").limit(1).select("id")
        chain = trace.trace(edges, root, 3, "both", trace.mode_types("calls")).join(nodes.select("id", "name", "file_path"), "id")
        return {"relations": relations, "chain": chain, "entry_points": architecture.entry_points(nodes, edges), "clusters": architecture.clusters(nodes, edges)}

    def clear(self, project: str) -> bool:
        """Remove all that is known of a project."""
        name = self._name(project)
        self.graph.clear(project)
        self._states(name).clear()
        for kind in ("terms", "cells"):
            self.files.fs.delete(self.files.at(f"{kind}/{name}"), True)
        self._cells.pop(name, None)
        self.statuses.remove(project)
        return self.catalog.drop(name)

    def status(self, project: str) -> dict:
        name = self._name(project)
        told = self.statuses.get(project)
        status = told.get("status") or ("indexed" if self.catalog.has(name) else "not_found")
        return {"project": project, "status": status, "chunks": self.catalog.count(name)} | {k: v for k, v in told.items() if k != "status"} | self.graph.stats(project)

    def projects(self) -> list[str]:
        """Projects that are indexed, the most recently written first."""
        return sorted(self.statuses.listed("indexed"), key=lambda p: self.statuses.get(p).get("last_updated", ""), reverse=True)

    def commands(self) -> dict[str, Callable]:
        """The operations by the names callers send: those of tools, of a browser and of an editor."""
        graph = {n: getattr(self.graph, n) for n in ("find", "trace", "snippet", "schema", "architecture", "detect_changes", "cypher", "search_code", "stats")}
        return graph | {
            "index": self.index, "search": self.search, "clear": self.clear, "status": self.status, "sync": self.sync, "sync_all": self.sync_all,
            "indexRepo": self.index, "searchCode": self.search, "clearIndex": self.clear, "checkIndexStatus": self.status, "getIndexedRepos": self.projects,
        }


class Graph:
    """Node and edge tables of projects, and the queries on them.

    What a file says (``facts``: definitions, imports, calls, routes) is kept, so when files change only they are read
    again, and all calls of the project resolve anew against all of its definitions.
    """

    _NODES = "id long, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string, project string"
    _EDGES = "source_id long, target_id long, type string, properties string, project string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _key(self, project: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(project)

    def _kept(self, project: str, what: str) -> Versions:
        return Versions(self.spark, f"{self.root}/{what}/{self._key(project)}")

    def build(self, found: DataFrame, project: str) -> None:
        """Build a project's graph from all of its files (project, path, content)."""
        self.update(found, None, project)

    def update(self, found: DataFrame, changes: DataFrame | None, project: str) -> None:
        """Bring a project's graph up to date: only changed files (path, change) are read, all if ``changes`` is None."""
        if changes is None:
            facts = cut(extract.file_facts(found), "facts")
        else:
            old = self._kept(project, "facts").read(extract.FACTS)
            live = found.join(changes.where("change <> 'removed'").select("path"), "path", "left_semi")
            facts = cut(old.join(changes.select("path"), "path", "left_anti").unionByName(extract.file_facts(live)), "facts")
        nodes, edges = extract.graph_rows(facts)
        resources, steps = extract.resource_rows(found)
        adrs = self.nodes(project).where("label = 'ADR'")
        nodes = cut(nodes.unionByName(resources).unionByName(adrs.select(*nodes.columns)), "nodes")
        edges = cut(tables.drop_dangling(edges.unionByName(steps), nodes), "edges")
        self._kept(project, "facts").write(facts)
        self.put(project, nodes, edges)

    def put(self, project: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Put rows in the place of all rows of a project; no rows leave none. The words of its nodes are read anew when asked for."""
        self._delete(f"terms/{self._key(project)}")
        for name, df in (("nodes", nodes), ("edges", edges)):
            if df.isEmpty():
                self._delete(f"{name}/project={self._key(project)}")
            else:
                df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{self.root}/{name}")

    def _delete(self, name: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _read(self, name: str, schema: str, project: str | None) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)  # nothing was built yet
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return df if project is None else df.where(F.col("project") == project)

    def nodes(self, project: str | None = None) -> DataFrame:
        return self._read("nodes", self._NODES, project)

    def edges(self, project: str | None = None) -> DataFrame:
        return self._read("edges", self._EDGES, project)

    def find(self, project: str, limit: int = 200, offset: int = 0, **how) -> DataFrame:
        return search.find_nodes(self.nodes(project), self.edges(project), limit=limit, offset=offset, **how)

    def page(self, project: str, limit: int = 200, offset: int = 0, **how) -> tuple[DataFrame, int, bool]:
        """(nodes, total, has_more)."""
        return search.found_page(search.find_nodes(self.nodes(project), None, limit=None, **how), ["name", "id"], limit, offset)

    def find_text(self, project: str, query: str, k: int = 10, offset: int = 0) -> DataFrame:
        """Nodes with a column ``score``: by the words of their name, qualified name and path, weighted 1, 2 and 0.5."""
        index = FullTextIndex(self.spark, f"{self.root}/terms/{self._key(project)}", 8)
        nodes = self.nodes(project)
        if not index.exists():
            index.build(nodes, "id", search.WEIGHTS)
        return nodes.join(index.search(query, k, offset, camel=True), "id").orderBy(F.desc("score"), "id")

    def get(self, project: str, qualified_name: str) -> DataFrame:
        return tables.by_qualified_name(self.nodes(project), project, qualified_name)

    def cypher(self, project: str, query: str) -> DataFrame:
        return search.cypher(self.nodes(project), query)

    def trace(self, project: str, name: str, depth: int = 3, direction: str = "both", mode: str = "calls", tests: bool = False) -> DataFrame:
        nodes = self.nodes(project)
        allowed = None if tests else nodes.where(~trace.is_test_path())
        return trace.trace(self.edges(project), trace.resolve_root(nodes, name), depth, direction, trace.mode_types(mode), allowed)

    def search_code(self, project: str, contents: DataFrame, pattern: str, **how) -> tuple[DataFrame, dict]:
        """Grep over (path, content) with the node around each hit, and the totals."""
        return search.search_code(contents, self.nodes(project), pattern, **how)

    def architecture(self, project: str) -> dict[str, DataFrame]:
        n, e = self.nodes(project), self.edges(project)
        return {"labels": tables.label_counts(n), "types": tables.edge_type_counts(e), "entry_points": architecture.entry_points(n, e), "clusters": architecture.clusters(n, e), "packages": architecture.package_tree(n), "routes": search.route_summary(n)}

    def detect_changes(self, project: str, root: str, base: str | None = None) -> DataFrame:
        return search.impacted(self.nodes(project), files.changed_files(self.spark, root, base))

    def projects(self) -> DataFrame:
        return tables.project_stats(self.nodes(), self.edges())

    def schema(self, project: str) -> DataFrame:
        return tables.schema_listing(self.nodes(project), self.edges(project))

    def snippet(self, project: str, qualified_name: str, contents: DataFrame) -> DataFrame:
        """(qualified_name, code) from (file_path, content) rows."""
        rows = self.nodes(project).where(F.col("qualified_name") == qualified_name).join(contents, "file_path")
        return rows.select("qualified_name", search.snippet(F.col("content"), F.col("start_line"), F.col("end_line")).alias("code"))

    def add_adr(self, project: str, title: str, content: str, status: str = "proposed", created: str = "") -> None:
        """Record a decision; one of the same title is replaced."""
        row = tables.adr_rows(self.spark.createDataFrame([(project, title, content, status, created)], "project string, title string, content string, status string, created string"))
        nodes = self.nodes(project)
        kept = nodes.join(row.select("id"), "id", "left_anti").unionByName(row.select(*nodes.columns))
        self.put(project, cut(kept, "nodes"), cut(self.edges(project), "edges"))

    def update_adr(self, project: str, title: str, properties: str) -> None:
        """Merge a JSON object into the properties of a decision."""
        nodes = self.nodes(project)
        one = nodes.where((F.col("label") == "ADR") & (F.col("name") == title)).select("id", F.lit(properties).alias("properties"))
        self.put(project, cut(tables.update_properties(nodes, one), "nodes"), cut(self.edges(project), "edges"))

    def adrs(self, project: str) -> DataFrame:
        return tables.adrs(self.nodes(project), project)

    def delete_file(self, project: str, path: str) -> None:
        self._keep(project, *tables.delete_files(self.nodes(project), self.edges(project), self.spark.createDataFrame([(project, path)], "project string, file_path string")))

    def delete_label(self, project: str, label: str) -> None:
        self._keep(project, *tables.delete_label(self.nodes(project), self.edges(project), project, label))

    def _keep(self, project: str, nodes: DataFrame, edges: DataFrame) -> None:
        self.put(project, cut(nodes, "nodes"), cut(edges, "edges"))

    def stats(self, project: str) -> dict:
        row = tables.project_stats(self.nodes(project), self.edges(project)).first()
        return {"nodes": row["nodes"], "edges": row["edges"]} if row else {"nodes": 0, "edges": 0}

    def clear(self, project: str) -> None:
        for name in (f"nodes/project={self._key(project)}", f"edges/project={self._key(project)}", f"facts/{self._key(project)}", f"terms/{self._key(project)}"):
            self._delete(name)
