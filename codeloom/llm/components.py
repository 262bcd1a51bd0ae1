"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_join, written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node in edges (a, b).

    Each node points to a parent, at first the least of itself and its neighbours. Each round, a node and its parent point to
    the least grandparent among the node's neighbours, then every pointer is shortened, until nothing changes. The rounds
    needed grow with the logarithm of a component's diameter. A parent of many nodes and a neighbour of many are joined
    without shuffling those, and messages are reduced to minima before they are shuffled, so no component or hub becomes one
    task. Each round is written to the shared folder, so that lineage stays short and lost executors cost no more than a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = written(both, "component-edges")
    links = both.count()
    known = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "node"), "component-nodes")
    nodes = known.count()
    f = known.select("node", "p")
    while True:
        children = f.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        parents = written(children.join(f.select(F.col("node").alias("p"), F.col("p").alias("gp")), "p"), "component-parents")
        g = written(keyed_join(f, parents, ["p"], nodes).select("node", "p", "gp"), "component-round")
        told = written(g.join(known.select("node", "degree"), "node").select(F.col("node").alias("b"), "gp", F.col("degree").alias("n")), "component-told")
        heard = keyed_join(both, told, ["b"], links).groupBy("a").agg(F.min("gp").alias("gp"))
        own = g.select(F.col("node").alias("a"), "p").join(heard, "a")
        calls = own.select(F.col("a").alias("node"), "gp").unionByName(own.select(F.col("p").alias("node"), "gp")).unionByName(g.select("node", "gp"))
        new = written(calls.groupBy("node").agg(F.min("gp").alias("p")), "component-round")
        if new.join(f.withColumnRenamed("p", "old"), "node").filter("p <> old").isEmpty():
            return new.select("node", F.col("p").alias("component"))
        f = new
