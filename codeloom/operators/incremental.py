"""Change detection between snapshots and the patch that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (added, modified, deleted) between snapshots of (path, hash)."""
    joined = old.select("path", F.col("hash").alias("before")).join(new.select("path", F.col("hash").alias("after")), "path", "full")
    status = F.when(F.col("before").isNull(), F.lit("added")).when(F.col("after").isNull(), F.lit("deleted")).when(F.col("before") != F.col("after"), F.lit("modified"))
    return joined.select("path", status.alias("status")).filter("status IS NOT NULL")


def first_listing(snapshot: DataFrame) -> DataFrame:
    """All paths of a snapshot, as added."""
    return snapshot.select("path", F.lit("added").alias("status"))


def patch_plan(changes: DataFrame) -> DataFrame:
    """action (add, update, delete), path."""
    action = F.when(F.col("status") == "added", "add").when(F.col("status") == "deleted", "delete").otherwise("update")
    return changes.select(action.alias("action"), "path")


def plan_lists(changes: DataFrame) -> DataFrame:
    """action, paths (sorted)."""
    return patch_plan(changes).groupBy("action").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: is_stale, changed, reason, for snapshots of (path, hash); an empty indexed one was never indexed."""
    known = indexed.agg((F.count(F.lit(1)) > 0).alias("known"))
    changed = snapshot_diff(indexed, current).agg(F.count(F.lit(1))).scalar()
    reason = F.when(~F.col("known"), F.lit("not indexed yet")).when(F.col("changed") > 0, F.format_string("%d files changed", "changed")).otherwise(F.lit(""))
    return known.withColumn("changed", changed).select((~F.col("known") | (F.col("changed") > 0)).alias("is_stale"), "changed", reason.alias("reason"))


def mode(indexed: DataFrame, force: bool = False) -> str:
    """full if forced or never indexed, else incremental."""
    return "full" if force or indexed.isEmpty() else "incremental"
