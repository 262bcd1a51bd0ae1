"""Counts and summaries of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.runtime import cut


def counts(nodes: DataFrame, edges: DataFrame, clusters: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges and, where they are given, clusters and processes."""
    out = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", edges.agg(F.count(F.lit(1))).scalar())
    if clusters is not None:
        out = out.withColumn("clusters", clusters.agg(F.count(F.lit(1))).scalar())
    if steps is not None:
        out = out.withColumn("processes", steps.agg(F.countDistinct("process_id")).scalar())
    return out


def by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("exported").alias("exported"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, degree over all types both ways, and the size to draw it with: from 3 to 15 by share of the largest degree.

    Edges are read once, for degrees, which are written, as the largest must be known before the first size.
    """
    ends = edges.select(F.explode(F.array("from_uid", "to_uid")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("degree"))
    every = cut(nodes.select("uid").join(ends, "uid", "left").withColumn("degree", F.coalesce("degree", F.lit(0))))
    most = every.agg(F.max("degree").alias("most"))
    size = F.lit(3.0) + F.when(F.col("most") > 0, F.lit(12.0) * F.col("degree") / F.col("most")).otherwise(F.lit(0.0))
    return every.crossJoin(F.broadcast(most)).select("uid", "degree", size.alias("size"))  # one row


def cluster_count(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.coalesce("cluster_id", F.lit("")) != "").agg(F.countDistinct("cluster_id").alias("clusters"))


def call_profile(edges: DataFrame) -> DataFrame:
    """uid, CALLS out and CALLS in of all nodes that have any."""
    ends = F.array(F.struct(F.col("from_uid").alias("uid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_uid").alias("uid"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    each = edges.filter("type = 'CALLS'").select(F.explode(ends).alias("e")).select("e.*")
    return each.groupBy("uid").agg(F.sum("o").alias("calls_out"), F.sum("i").alias("calls_in"))


def status(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: nodes, edges, embedded nodes and their percentage."""
    some = nodes.select("uid").join(embeddings.select("uid").distinct().withColumn("has", F.lit(1)), "uid", "left")
    one = some.agg(F.count(F.lit(1)).alias("nodes"), F.count("has").alias("embedded")).withColumn("edges", edges.agg(F.count(F.lit(1))).scalar())
    return one.select("nodes", "edges", "embedded", T.percentage(F.col("embedded"), F.col("nodes")).alias("coverage"))
