"""Recursive traversal: impact closures and execution traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.runtime import cut

REACHING = ("CALLS", "IMPORTS")
#: Nodes of a frontier that are given to a scan by name, at most.
FRONT = 200


def _reach(edges: DataFrame, front: DataFrame) -> DataFrame:
    """edges (at, next, c) from the nodes of front, a written table.

    Up to FRONT nodes, their names reach the scan of edges as a list of values, so that stored edges in the order of their ends
    are skipped; beyond, and in any case for the join, Spark decides by sizes at run time.
    """
    names = [r[0] for r in front.select("at").distinct().limit(FRONT + 1).collect()]
    some = edges.filter(F.col("at").isin(names)) if len(names) <= FRONT else edges
    return some.join(front, "at")


def impact(edges: DataFrame, start: DataFrame, direction: str = "downstream", least: float = 0.5, depth: int = 5) -> DataFrame:
    """start_uid, uid, depth, confidence of all paths from the uids in start, as a set.

    Each edge must have the least confidence; a path's is the product. downstream follows edges, upstream goes against them.
    Depth 1 always counts. A uid may come at several depths and confidences, the start itself where there are cycles. Each
    level keeps its distinct rows only and is computed once; small frontiers are given to the scan
    by name and broadcast at run time, large ones shuffled.
    """
    if direction not in ("downstream", "upstream"):
        raise ValueError("direction is downstream or upstream")
    here, there = ("from_uid", "to_uid") if direction == "downstream" else ("to_uid", "from_uid")
    good = edges.filter(F.col("type").isin(*REACHING) & (F.col("confidence") >= least))
    good = good.select(F.col(here).alias("at"), F.col(there).alias("next"), F.col("confidence").alias("c"))
    front = start.select(F.col("uid").alias("start_uid"), F.col("uid").alias("at")).distinct()
    level = _reach(good, cut(front)).select("start_uid", F.col("next").alias("uid"), F.lit(1).alias("depth"), F.col("c").alias("confidence")).distinct()
    levels = []
    for k in range(1, max(1, depth) + 1):
        level = cut(level)
        if level.isEmpty():
            break
        levels.append(level)
        if k < depth:
            step = _reach(good, level.withColumnRenamed("uid", "at"))
            level = step.select("start_uid", F.col("next").alias("uid"), F.lit(k + 1).alias("depth"), (F.col("c") * F.col("confidence")).alias("confidence")).distinct()
    out = level.limit(0) if not levels else levels[0]
    for other in levels[1:]:
        out = out.unionByName(other)
    return out


def impact_nodes(nodes: DataFrame, edges: DataFrame, uid: str, direction: str = "downstream", least: float = 0.5, depth: int = 5) -> DataFrame:
    """Nodes in the impact closure of one uid with depth and confidence; uids without a node go."""
    start = edges.sparkSession.createDataFrame([(uid,)], "uid string")
    found = impact(edges, start, direction, least, depth)
    return found.join(nodes.select("uid", "name", "kind", "file_path"), "uid").select("uid", "name", "kind", "file_path", "depth", "confidence")


#: What entry points are called, or their files.
ENTRY_NAME, ENTRY_PREFIXES = "main", ("handle", "serve", "route", "controller")
ENTRY_FILES, ENTRY_FILE_PREFIX = ("main.go", "server.go", "router.go"), "handler"


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods where execution may begin: by name, by calling without being called, or by file."""
    from ..functions.text import basename
    from .stats import call_profile

    joined = nodes.filter(F.col("kind").isin("Function", "Method")).join(call_profile(edges), "uid", "left")
    name, file = F.lower("name"), F.lower(basename("file_path"))
    named = name == ENTRY_NAME
    for p in ENTRY_PREFIXES:
        named = named | name.startswith(p)
    root = (F.coalesce("calls_in", F.lit(0)) == 0) & (F.coalesce("calls_out", F.lit(0)) > 0)
    return joined.filter((F.col("exported") & (named | root)) | file.isin(*ENTRY_FILES) | file.startswith(ENTRY_FILE_PREFIX)).select(*nodes.columns)


def trace(edges: DataFrame, entries: DataFrame, depth: int = 10) -> DataFrame:
    """process_id, name, entry_uid, symbol_uid, depth, step_index: the CALLS reached from each entry (uid, name), breadth first.

    A symbol counts once a process, where it is reached first; steps of a level go by their parent's step, then uid.
    """
    calls = edges.filter("type = 'CALLS'").select(F.col("from_uid").alias("at"), F.col("to_uid").alias("next")).distinct().persist()
    level = entries.select("uid", "name").dropDuplicates(["uid"]).select(ids.process_id("uid").alias("process_id"), "name", F.col("uid").alias("entry_uid"), F.col("uid").alias("symbol_uid"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("step_index"))
    level = cut(level)
    seen = level
    for k in range(1, depth + 1):
        base = seen.groupBy("process_id").agg(F.count(F.lit(1)).alias("base"))
        reached = calls.join(level.select("process_id", "name", "entry_uid", F.col("symbol_uid").alias("at"), F.col("step_index").alias("parent")), "at")
        first = reached.groupBy("process_id", "name", "entry_uid", F.col("next").alias("symbol_uid")).agg(F.min("parent").alias("parent"))
        new = first.join(seen.select("process_id", "symbol_uid"), ["process_id", "symbol_uid"], "left_anti").join(base, "process_id")
        place = F.row_number().over(Window.partitionBy("process_id").orderBy("parent", "symbol_uid"))
        level = cut(new.select("process_id", "name", "entry_uid", "symbol_uid", F.lit(k).alias("depth"), (F.col("base") + place - 1).alias("step_index")))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    calls.unpersist()
    return seen


def classify(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """process_id, process_type: external if a step has no node or no cluster, else by its number of clusters."""
    own = nodes.select(F.col("uid").alias("symbol_uid"), F.coalesce("cluster_id", F.lit("")).alias("cluster"))
    joined = steps.select("process_id", "symbol_uid").join(own, "symbol_uid", "left").withColumn("cluster", F.coalesce("cluster", F.lit("")))
    seen = joined.groupBy("process_id").agg(F.max((F.col("cluster") == "").cast("int")).alias("outside"), (F.min("cluster") != F.max("cluster")).alias("several"))
    kind = F.when(F.col("outside") == 1, F.lit("external")).when(F.col("several"), F.lit("cross_community")).otherwise(F.lit("single_community"))
    return seen.select("process_id", kind.alias("process_type"))


def processes(steps: DataFrame) -> DataFrame:
    """Each process with its steps in order, as an array."""
    listed = F.array_sort(F.collect_list(F.struct("step_index", "symbol_uid", "depth"))).alias("steps")
    return steps.groupBy("process_id", "name", "entry_uid").agg(listed)
