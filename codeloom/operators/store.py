"""Upserts and deletes over immutable tables: each gives the new state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.runtime import cut


def _last(df: DataFrame, key: list[str], *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key new doesn't have. Keys are unique in each."""
    return old.join(new.select(*key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """By uid; of new rows with one uid the last in the file counts."""
    return upsert(old, _last(new, ["uid"], F.col("start_line").desc(), F.col("end_line").desc(), F.col("name")), ["uid"])


def named_edges(edges: DataFrame) -> DataFrame:
    """edges with their ids."""
    return edges.select(ids.edge_id("from_uid", "to_uid", "type").alias("id"), "from_uid", "to_uid", "type", "confidence")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """By edge id; a known edge takes the new confidence, of several new ones the highest."""
    return upsert(named_edges(old), _last(named_edges(new), ["id"], F.col("confidence").desc()), ["id"])


def insert_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key is new."""
    return old.unionByName(new.select(*old.columns).join(old.select(*key), key, "left_anti").dropDuplicates(key))


def replace_groups(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new, and those of old in groups (of key) that new doesn't touch."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_files(paths: DataFrame, nodes: DataFrame, edges: DataFrame, **others: DataFrame) -> dict[str, DataFrame]:
    """All tables without the nodes of the files in paths (file_path): their edges at either end go, and their rows in others.

    others are tables with a column uid or symbol_uid.
    """
    gone = cut(nodes.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("uid"))  # once for all tables
    out = {"nodes": nodes.join(gone, "uid", "left_anti").select(*nodes.columns)}
    left = edges.join(gone.withColumnRenamed("uid", "from_uid"), "from_uid", "left_anti").join(gone.withColumnRenamed("uid", "to_uid"), "to_uid", "left_anti")
    out["edges"] = left.select(*edges.columns)
    for name, table in others.items():
        key = "uid" if "uid" in table.columns else "symbol_uid"
        out[name] = table.join(gone.withColumnRenamed("uid", key), key, "left_anti").select(*table.columns)
    return out


def get_meta(meta: DataFrame, key: str) -> DataFrame:
    """One row: value, empty where the key is missing."""
    return meta.filter(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    return upsert(meta, meta.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


def cleared(tables: dict[str, DataFrame], keep: tuple = ("embed_cache",)) -> dict[str, DataFrame]:
    """All tables empty, but for those in keep and the repository's path in index_meta."""
    return {n: t if n in keep else t.filter("key = 'repo_path'") if n == "index_meta" else t.limit(0) for n, t in tables.items()}
