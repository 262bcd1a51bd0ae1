"""Lookups and projections over nodes and edges. Each takes DataFrames and gives one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NODE = ("uid", "name", "kind", "file_path", "start_line", "end_line", "exported", "package_path", "cluster_id")
PLACE = ("file_path", "start_line", "uid")


def whole(nodes: DataFrame) -> DataFrame:
    """Nodes as they are read: no null package or cluster."""
    return nodes.withColumns({c: F.coalesce(c, F.lit("")) for c in ("package_path", "cluster_id")}).select(*NODE)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return whole(nodes.filter(F.col("name") == name))


def by_file(nodes: DataFrame, path: str) -> DataFrame:
    return whole(nodes.filter(F.col("file_path") == path))


def by_uid(nodes: DataFrame, uid: str) -> DataFrame:
    return whole(nodes.filter(F.col("uid") == uid)).limit(1)


def first_of(nodes: DataFrame, name: str) -> DataFrame:
    """The node that a name stands for: the first by file, line, uid."""
    return by_name(nodes, name).orderBy(*PLACE).limit(1)


def in_file(path: str) -> Column:
    """The file itself or, without regard to case, a path that ends in it. A path's % and _ match as in LIKE."""
    return (F.col("file_path") == path) | F.col("file_path").ilike("%/" + path)


def top_level(nodes: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """Symbols of a file that are no methods and members of nothing, by line."""
    members = edges.filter("type = 'MEMBER_OF'").select(F.col("from_uid").alias("uid"))
    return whole(nodes.filter(in_file(path) & (F.col("kind") != "Method")).join(members, "uid", "left_anti")).orderBy("start_line", "uid")


def edges_from(edges: DataFrame, uid: str) -> DataFrame:
    return edges.filter(F.col("from_uid") == uid)


def edges_to(edges: DataFrame, uid: str) -> DataFrame:
    return edges.filter(F.col("to_uid") == uid)


def hydrate(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the uids in scores (uid, score), best first; unknown uids go."""
    return whole(nodes).join(scores.select("uid", "score"), "uid").orderBy(F.col("score").desc(), "uid")


def coordinates(nodes: DataFrame, name: str) -> DataFrame:
    return by_name(nodes, name).select("uid", "name", "kind", "file_path", "start_line", "end_line", "exported")


def overview(nodes: DataFrame, edges: DataFrame, path: str, include_private: bool = True, root: str = "") -> DataFrame:
    """top_level() of a file; with the repository's root, a relative path also finds absolute ones."""
    full = path if path.startswith("/") or not root else root.rstrip("/") + "/" + path
    found = top_level(nodes, edges, path)
    if full != path:
        found = found.unionByName(top_level(nodes, edges, full)).dropDuplicates(["uid"]).orderBy("start_line", "uid")
    return found if include_private else found.filter("exported")


def bodies(nodes: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Every symbol of a name with its lines of text; empty where its file is missing. files: path, text."""
    joined = by_name(nodes, name).join(files, F.col("file_path") == F.col("path"), "left")
    body = F.coalesce(T.line_range("text", F.col("start_line"), F.col("end_line")), F.lit(""))
    return joined.select("uid", "name", "kind", "file_path", "start_line", "end_line", body.alias("body"))


def references(nodes: DataFrame, edges: DataFrame, name: str, types: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Who points to the first symbol of a name, with what edge; callers without a node go."""
    wanted = edges.filter(F.col("confidence") >= least)
    if types:
        wanted = wanted.filter(F.col("type").isin([t.upper() for t in types]))
    target = first_of(nodes, name).first()  # one row, so that its uid reaches the scan of edges
    wanted = wanted.filter(F.col("to_uid") == target["uid"] if target else F.lit(False))
    callers = nodes.select(F.col("uid").alias("from_uid"), "name", "kind", "file_path", "start_line", "end_line")
    return wanted.join(callers, "from_uid").select("from_uid", "name", "kind", "file_path", "start_line", "end_line", "type", "confidence")


def context(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Edges of the first symbol of a name, both ways."""
    symbol = first_of(nodes, name).select("uid")
    out = edges.join(symbol, F.col("from_uid") == F.col("uid")).select(F.lit("outgoing").alias("direction"), F.col("to_uid").alias("other_uid"), "type", "confidence")
    inside = edges.join(symbol, F.col("to_uid") == F.col("uid")).select(F.lit("incoming").alias("direction"), F.col("from_uid").alias("other_uid"), "type", "confidence")
    return out.unionByName(inside)


def rename_plan(nodes: DataFrame, name: str, new: str) -> DataFrame:
    """Definition sites that a renaming would touch; nothing is changed."""
    return by_name(nodes, name).select("file_path", F.col("start_line").alias("line"), F.lit(name).alias("old_name"), F.lit(new).alias("new_name"), F.lit("planned").alias("status"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name holds needle, whatever its case, and their neighbours; hit tells which."""
    hits = nodes.filter(F.lower("name").contains(needle.lower())).select("uid").distinct()
    both = edges.select(F.col("from_uid").alias("uid"), F.col("to_uid").alias("other")).unionByName(edges.select(F.col("to_uid").alias("uid"), F.col("from_uid").alias("other")))
    near = both.join(hits, "uid").select(F.col("other").alias("uid"))
    marked = hits.withColumn("hit", F.lit(1)).unionByName(near.withColumn("hit", F.lit(0)))
    return marked.groupBy("uid").agg((F.max("hit") == 1).alias("hit"))


def edge_shades(edges: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """Edges of shown types with their confidence as opacity."""
    shown = edges.filter(~F.col("type").isin(hidden)) if hidden else edges
    return shown.select("from_uid", "to_uid", "type", T.alpha_hex(F.col("confidence")).alias("alpha"))
