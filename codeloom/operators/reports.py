"""Text reports as DataFrames, for text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """label, members, cohesion (two decimals), most cohesive first."""
    return clusters.select("community", "label", F.size("members").alias("members"), F.format_string("%.2f", "cohesion").alias("cohesion")).orderBy(F.col("cohesion").desc(), "community")


def process_rows(steps: DataFrame) -> DataFrame:
    return steps.groupBy("process_id", "name").agg(F.count(F.lit(1)).alias("steps")).orderBy("name", "process_id")


def wiki(clusters: DataFrame, steps: DataFrame) -> DataFrame:
    """page, line, text of a wiki: one page of communities, one of processes."""
    a = cluster_rows(clusters).select(F.lit("communities.md").alias("page"), F.format_string("| %s | %d | %s |", F.coalesce("label", F.lit("")), "members", "cohesion").alias("text"))
    b = process_rows(steps).select(F.lit("processes.md").alias("page"), F.format_string("| %s | %d |", "name", "steps").alias("text"))
    return a.unionByName(b)


def agent_context(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, name: str) -> DataFrame:
    """One row: text of a summary of the index."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    n = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", count(edges)).withColumn("clusters", count(clusters))
    shown = [F.format_number(c, 0) for c in ("nodes", "edges", "clusters")]
    return n.select(F.format_string(f"# {name.replace('%', '%%')}\n\n%s symbols, %s relations, %s communities.", *shown).alias("text"))


def module_pages(clusters: DataFrame, least: float = 0.3) -> DataFrame:
    """file, text of a page for each community of some cohesion."""
    good = clusters.filter(F.col("cohesion") >= least)
    body = F.format_string("# %s\n\nCohesion %.2f\n\n%s", "label", "cohesion", F.array_join(F.transform("members", lambda m: F.concat(F.lit("- "), m)), "\n"))
    return good.select(F.concat(T.file_name("label"), F.lit(".md")).alias("file"), body.alias("text"))


def graph_export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """json: a line for each node and edge."""
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("record"), *nodes.columns)).alias("json"))
    return a.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), *edges.columns)).alias("json")))
