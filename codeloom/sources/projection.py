"""Graphs projected from relational tables, as SQL that Spark and other engines read alike.

nodes: uid, name, kind, file_path, start_line, end_line, exported, package_path, cluster_id.
edges: from_uid, to_uid, type, confidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def _node(table: str, uid: str, name: str, kind: str, folder: str, file: str, key: str, exported: str, cluster: str = "''") -> str:
    return f"""SELECT {uid} AS uid, {name} AS name, '{kind}' AS kind, concat({folder}, '/', {file}) AS file_path,
CAST({key} % 1000 + 1 AS INT) AS start_line, CAST({key} % 1000 + 8 AS INT) AS end_line, {exported} AS exported, {folder} AS package_path, {cluster} AS cluster_id FROM {table}"""


NODES = "\nUNION ALL ".join(
    (
        _node("{customer}", "concat('c', c_custkey)", "c_name", "Function", "concat('customers/', c_mktsegment)", "'handler.ts'", "c_custkey", "c_custkey % 2 = 0", "concat('cluster_', c_nationkey)"),
        _node("{orders}", "concat('o', o_orderkey)", "concat('order', o_orderkey)", "Method", "concat('orders/', o_orderpriority)", "concat(o_orderstatus, '.ts')", "o_orderkey", "o_orderkey % 2 = 0"),
        _node("{part}", "concat('p', p_partkey)", "p_name", "Class", "concat('parts/', p_brand)", "concat(p_type, '.ts')", "p_partkey", "p_partkey % 2 = 0"),
        _node("{supplier}", "concat('s', s_suppkey)", "s_name", "Interface", "concat('suppliers/', s_nationkey)", "'supplier.go'", "s_suppkey", "s_suppkey % 2 = 0", "concat('cluster_', s_nationkey)"),
        _node("{nation}", "concat('n', n_nationkey)", "n_name", "Type", "'geo'", "'nation.py'", "n_nationkey", "n_nationkey % 2 = 0", "concat('cluster_', n_nationkey)"),
        _node("{region}", "concat('r', r_regionkey)", "r_name", "Constant", "'geo'", "'region.py'", "r_regionkey", "r_regionkey % 2 = 0"),
    )
)

EDGES = """SELECT concat('c', o_custkey) AS from_uid, concat('o', o_orderkey) AS to_uid, 'CALLS' AS type, CAST(0.95 AS DOUBLE) AS confidence FROM {orders}
UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'CALLS', CAST(max(1 - l_discount) AS DOUBLE) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT concat('p', l_partkey), concat('s', l_suppkey), 'IMPORTS', CAST(max(1 - l_tax) AS DOUBLE) FROM {lineitem} GROUP BY l_partkey, l_suppkey
UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'CALLS', CAST(0.75 AS DOUBLE) FROM {supplier}
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'IMPORTS', CAST(0.85 AS DOUBLE) FROM {nation}
UNION ALL SELECT concat('o', o_orderkey), concat('c', o_custkey), 'MEMBER_OF', CAST(1.0 AS DOUBLE) FROM {orders}
UNION ALL SELECT DISTINCT concat('s', l_suppkey), concat('p', l_partkey), 'EXTENDS', CAST(0.6 AS DOUBLE) FROM {lineitem}
UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), 'IMPLEMENTS', CAST(0.95 AS DOUBLE) FROM {nation}"""

#: A cyclic graph: users who follow each other in an event type's log.
FLOW_EDGES = """SELECT from_uid, to_uid, 'CALLS' AS type, CAST(least(0.95, 0.4 + 0.1 * count(*)) AS DOUBLE) AS confidence FROM (
SELECT concat('u', lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS from_uid, concat('u', user_id) AS to_uid,
lag(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before, user_id AS after FROM {events}) x
WHERE before IS NOT NULL AND before <> after GROUP BY from_uid, to_uid"""

FLOW_NODES = """SELECT DISTINCT concat('u', user_id) AS uid, concat('user', user_id) AS name, 'Function' AS kind, concat('users/', user_id % 10, '/u.ts') AS file_path,
CAST(1 AS INT) AS start_line, CAST(9 AS INT) AS end_line, true AS exported, concat('users/', user_id % 10) AS package_path, '' AS cluster_id FROM {events}"""


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables that it names in braces."""
    named = {t: d for t, d in ((t, f"{sf_dir}/{t}.parquet") for t in TABLES) if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: spark.read.parquet(d) for t, d in named.items()})


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(project(spark, sf_dir, NODES), project(spark, sf_dir, EDGES))


def flow_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(project(spark, sf_dir, FLOW_NODES), project(spark, sf_dir, FLOW_EDGES))


def plain(sql: str) -> str:
    """sql for an engine in which the tables are views of their own names."""
    return sql.format(**{t: t for t in TABLES})
