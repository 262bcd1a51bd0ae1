"""The tools of a code index, by name: a session answers calls with DataFrames. Also the index build itself."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import community, incremental, lookup, resolve, search, stats, store, traverse
from ..session import attach
from ..sources import extract, scan
from ..sources.registry import Registry
from . import cypher, raw_sql
from .runtime import cut

#: Tools that may be asked of another repository.
READ_ONLY = ("query", "context", "impact", "cypher", "symbol_coordinates", "get_symbols_overview", "find_referencing")
DEFAULTS = {"limit": 20, "min_confidence": 0.5, "max_depth": 5, "resolution": 1.0, "trace_depth": 10}


class ToolError(ValueError):
    """The call can't be answered."""


def _kept(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old whose file hasn't changed, and those of new."""
    return old.join(changed, "file_path", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def analyze(spark: SparkSession, registry: Registry, name: str, root: str, ignore: list[str] | None = None, force: bool = False, embed: bool = False) -> dict:
    """Indexes a tree of files: all of it, or what changed since. Gives the mode and the numbers of changes and broken files.

    ignore are lines in place of the root's ignore file, and are remembered. All references are kept with their files and
    resolved anew against all symbols, so after a partial change the edges are those of a full build.
    """
    attach(spark)
    lines = scan.ignore_lines(spark, root) if ignore is None else ignore
    files = scan.scan(spark, root, lines)
    current = cut(files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("hash")))
    before = registry.read(name, "files")
    full = incremental.mode(before, force) == "full"
    changes = cut(incremental.first_listing(current) if full else incremental.snapshot_diff(before, current))
    n = changes.count()
    if not n and not full:
        return {"mode": "fresh", "changed": 0, "failed": 0}
    old = {t: registry.read(name, t) for t in ("nodes", "references", "owners", "failures")}
    if full:
        old = {t: df.limit(0) for t, df in old.items()}
    changed = changes.select(F.col("path").alias("file_path"))
    found = cut(extract.records(current.join(changes.filter("status <> 'deleted'").select("path"), "path")))
    every = cut(_kept(old["nodes"], changed, store.upsert_nodes(old["nodes"].limit(0), extract.nodes_of(found))))
    references = cut(_kept(old["references"], changed, extract.references_of(found)))
    owners = cut(_kept(old["owners"], changed, extract.owners_of(found)))
    failures = cut(_kept(old["failures"], changed, extract.failures_of(found)))
    new = resolve.resolve(references, every).unionByName(resolve.member_edges(every, owners))
    links = cut(store.named_edges(new))
    members = cut(community.louvain(every, links, DEFAULTS["resolution"]))
    every = cut(community.assigned(every, members))
    clusters = cut(community.clusters(members, every, community.cluster_graph(every, links)))
    steps = traverse.trace(links, traverse.entry_points(every, links), DEFAULTS["trace_depth"])
    steps = cut(steps.join(traverse.classify(steps, every), "process_id"))
    tables = {"nodes": every, "edges": links, "clusters": clusters, "process_steps": steps, "postings": search.build_index(every), "files": current}
    tables |= {"references": references, "owners": owners, "failures": failures}
    if embed:
        cache = registry.read(name, "embeddings").select("text_hash", "embedding").dropDuplicates(["text_hash"])
        hits, misses = search.split_by_cache(every, cache)
        tables["embeddings"] = cut(hits.unionByName(search.embedded(search.embed(misses))))
    tables["index_meta"] = spark.createDataFrame([("repo_path", root), ("ignore", json.dumps(lines))], "key string, value string")
    for table, df in tables.items():
        registry.write(name, table, df)
    registry.register(name, root)
    return {"mode": "full" if full else "incremental", "changed": n, "failed": failures.count()}


class Session:
    """Answers tool calls over the repositories of a registry."""

    def __init__(self, registry: Registry, repo: str = "") -> None:
        self.registry, self.repo = registry, repo
        self.tools: dict[str, Callable[..., DataFrame]] = {
            "list_repos": self._list, "query": self._query, "context": self._context, "impact": self._impact, "detect_changes": self._changes,
            "rename": self._rename, "cypher": self._cypher, "find_referencing": self._referencing, "symbol_coordinates": self._coordinates,
            "get_symbols_overview": self._overview, "query_repo": self._query_repo, "find_symbol_body": self._body,
        }

    def call(self, tool: str, /, **args: object) -> DataFrame:
        if tool not in self.tools:
            raise ToolError(f"unknown tool {tool}")
        return self.tools[tool](**args)

    def _table(self, table: str) -> DataFrame:
        name = self.registry.resolve(self.repo)
        if not name or not self.registry.get(name):
            raise ToolError(f"unknown repository {name!r}")
        return self.registry.read(name, table)

    def _root(self) -> str:
        return store.get_meta(self._table("index_meta"), "repo_path").first()[0]

    def _list(self) -> DataFrame:
        return self.registry.frame()

    def _query(self, query: str, limit: int = DEFAULTS["limit"]) -> DataFrame:
        spark = self.registry.spark
        terms = spark.range(1).select(T.query_terms(F.lit(query)).alias("t")).first()["t"]
        return search.hybrid(self._table("nodes"), self._table("postings"), None, terms, None, limit)

    def _context(self, name: str) -> DataFrame:
        return lookup.context(self._table("nodes"), self._table("edges"), name)

    def _impact(self, target: str, direction: str = "downstream", min_confidence: float = DEFAULTS["min_confidence"], max_depth: int = DEFAULTS["max_depth"]) -> DataFrame:
        nodes, edges = self._table("nodes"), self._table("edges")
        start = lookup.first_of(nodes, target).select("uid")
        found = traverse.impact(edges, start, direction, min_confidence, max_depth)
        return found.join(nodes.select("uid", "name", "kind", "file_path"), "uid").select("uid", "name", "kind", "file_path", "depth", "confidence")

    def _changes(self) -> DataFrame:
        lines = store.get_meta(self._table("index_meta"), "ignore").first()[0]
        files = scan.scan(self.registry.spark, self._root(), json.loads(lines) if lines else None)
        return incremental.snapshot_diff(self._table("files").select("path", "hash"), scan.snapshot(files))

    def _rename(self, symbol: str, new_name: str) -> DataFrame:
        return lookup.rename_plan(self._table("nodes"), symbol, new_name)

    def _cypher(self, query: str) -> DataFrame:
        return cypher.run(query, self._table("nodes"), self._table("edges"))

    def _referencing(self, name: str, edge_types: list[str] | None = None, min_confidence: float = 0.0) -> DataFrame:
        return lookup.references(self._table("nodes"), self._table("edges"), name, edge_types, min_confidence)

    def _coordinates(self, name: str) -> DataFrame:
        return lookup.coordinates(self._table("nodes"), name)

    def _overview(self, file: str, include_private: bool = True) -> DataFrame:
        return lookup.overview(self._table("nodes"), self._table("edges"), file, include_private, self._root())

    def _body(self, name: str) -> DataFrame:
        return lookup.bodies(self._table("nodes"), self._table("files").select("path", "text"), name)

    def _query_repo(self, tool: str, target: str, **args: object) -> DataFrame:
        """A reading tool's rows from another repository, with what was asked of whom."""
        if tool not in READ_ONLY:
            raise ToolError(f"{tool} can't be asked of another repository")
        found = Session(self.registry, target).call(tool, **args)
        return found.withColumns({"target_repo": F.lit(target), "current_repo": F.lit(self.registry.resolve(self.repo)), "tool": F.lit(tool)})

    def sql(self, text: str) -> DataFrame:
        return raw_sql.run(self.registry.spark, text, **{t: self._table(t) for t in ("nodes", "edges", "clusters", "process_steps", "postings", "index_meta")})

    def resource(self, uri: str) -> DataFrame:
        """repos, context, clusters, processes, schema, cluster/<id> or process/<id>."""
        kind, _, key = uri.partition("/")
        if kind == "repos":
            return self._list()
        if kind == "context":
            return stats.counts(*(self._table(t) for t in ("nodes", "edges", "clusters", "process_steps")))
        if kind == "schema":
            rows = [(t, c.name, c.dataType.simpleString()) for t in ("nodes", "edges", "clusters", "process_steps") for c in self._table(t).schema]
            return self.registry.spark.createDataFrame(rows, "table string, column string, type string")
        if kind in ("clusters", "cluster"):
            found = self._table("clusters")
            return found.filter(F.col("community") == key) if key else found
        if kind in ("processes", "process"):
            found = traverse.processes(self._table("process_steps"))
            return found.filter(F.col("process_id") == key) if key else found
        raise ToolError(f"unknown resource {uri}")

    def resources(self) -> list[str]:
        own = ["context", "clusters", "processes", "schema"]
        return ["repos", *own, *(f"{r['name']}/{kind}" for r in self.registry.all() for kind in own)]
