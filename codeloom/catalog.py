"""Every operator as a named query over the driver's tables, with SQL for another engine wherever SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids, vectors
from .functions import text as T
from .operators import community, incremental, lookup, reports, resolve, search, stats, store, traverse
from .plans import cypher, raw_sql
from .plans.runtime import checkpoint_dir, cut
from .plans.tools import Session
from .session import attach
from .sources import extract, projection, scan
from .sources.projection import Graph, code_graph, flow_graph, plain, project
from .sources.registry import TABLES, Registry
from .streaming import incremental as streams

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}

CODE = f"nodes AS ({plain(projection.NODES)}), edges AS ({plain(projection.EDGES)})"
FLOW = f"nodes AS ({plain(projection.FLOW_NODES)}), edges AS ({plain(projection.FLOW_EDGES)})"
START, CALLEE = "c19", "s3"


def query(name: str, sql: str | None = None, graph: str = CODE) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        own = sql and (f"WITH RECURSIVE {graph}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH RECURSIVE {graph} {sql}")
        _FOUND[name] = (lambda spark, d: f(attach(spark), d), own)
        return f

    return keep


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _FOUND.items() if s}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


NODE = "uid, name, kind, file_path, start_line, end_line, exported, coalesce(package_path, '') AS package_path, coalesce(cluster_id, '') AS cluster_id"

# ---- lookups


@query("symbol_lookup", f"SELECT {NODE} FROM nodes WHERE name = 'hot plate'")
def _(spark, d):
    return lookup.by_name(code_graph(spark, d).nodes, "hot plate")


@query("nodes_by_file", f"SELECT {NODE} FROM nodes WHERE file_path = 'parts/Brand#5/ECONOMY.ts'")
def _(spark, d):
    return lookup.by_file(code_graph(spark, d).nodes, "parts/Brand#5/ECONOMY.ts")


@query("node_by_uid", f"SELECT {NODE} FROM nodes WHERE uid = '{START}'")
def _(spark, d):
    return lookup.by_uid(code_graph(spark, d).nodes, START)


@query("top_level_symbols", f"""SELECT {NODE} FROM nodes n WHERE (file_path = 'machinery/HANDLER.ts' OR file_path ILIKE '%/machinery/HANDLER.ts') AND kind <> 'Method'
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_uid = n.uid AND e.type = 'MEMBER_OF')""")
def _(spark, d):
    g = code_graph(spark, d)
    return lookup.top_level(g.nodes, g.edges, "machinery/HANDLER.ts")


@query("file_overview_public", f"""SELECT {NODE} FROM nodes n WHERE (file_path = 'suppliers/3/supplier.go' OR file_path ILIKE '%/suppliers/3/supplier.go') AND kind <> 'Method' AND exported
AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.from_uid = n.uid AND e.type = 'MEMBER_OF')""")
def _(spark, d):
    g = code_graph(spark, d)
    return lookup.overview(g.nodes, g.edges, "suppliers/3/supplier.go", include_private=False)


@query("edges_from", f"SELECT * FROM edges WHERE from_uid = '{START}'")
def _(spark, d):
    return lookup.edges_from(code_graph(spark, d).edges, START)


@query("edges_to", f"SELECT * FROM edges WHERE to_uid = '{CALLEE}'")
def _(spark, d):
    return lookup.edges_to(code_graph(spark, d).edges, CALLEE)


@query("symbol_coordinates", "SELECT uid, name, kind, file_path, start_line, end_line, exported FROM nodes WHERE name = 'red plate'")
def _(spark, d):
    return lookup.coordinates(code_graph(spark, d).nodes, "red plate")


_FIRST = "first AS (SELECT uid FROM nodes WHERE name = '{0}' ORDER BY file_path, start_line, uid LIMIT 1)"


@query("find_referencing", f"""WITH {_FIRST.format('hot plate')} SELECT e.from_uid, n.name, n.kind, n.file_path, n.start_line, n.end_line, e.type, e.confidence
FROM edges e JOIN first f ON e.to_uid = f.uid JOIN nodes n ON n.uid = e.from_uid WHERE e.type IN ('CALLS', 'EXTENDS') AND e.confidence >= 0.5""")
def _(spark, d):
    g = code_graph(spark, d)
    return lookup.references(g.nodes, g.edges, "hot plate", ["calls", "extends"], 0.5)


@query("context_symbol", f"""WITH {_FIRST.format('hot plate')} SELECT 'outgoing' AS direction, to_uid AS other_uid, type, confidence FROM edges JOIN first ON from_uid = uid
UNION ALL SELECT 'incoming', from_uid, type, confidence FROM edges JOIN first ON to_uid = uid""")
def _(spark, d):
    g = code_graph(spark, d)
    return lookup.context(g.nodes, g.edges, "hot plate")


@query("rename_plan", "SELECT file_path, start_line AS line, 'hot plate' AS old_name, 'warm plate' AS new_name, 'planned' AS status FROM nodes WHERE name = 'hot plate'")
def _(spark, d):
    return lookup.rename_plan(code_graph(spark, d).nodes, "hot plate", "warm plate")


@query("neighbourhood", """WITH hits AS (SELECT DISTINCT uid FROM nodes WHERE contains(lower(name), 'hot pl')),
near AS (SELECT to_uid AS uid FROM edges WHERE from_uid IN (SELECT uid FROM hits) UNION SELECT from_uid FROM edges WHERE to_uid IN (SELECT uid FROM hits))
SELECT uid, true AS hit FROM hits UNION ALL SELECT uid, false FROM near WHERE uid NOT IN (SELECT uid FROM hits)""")
def _(spark, d):
    g = code_graph(spark, d)
    return lookup.neighbourhood(g.nodes, g.edges, "HOT pl")


@query("edge_shades", "SELECT from_uid, to_uid, type, lower(lpad(to_hex(CAST(round(least(greatest(confidence, 0), 1) * 255) AS INT)), 2, '0')) AS alpha FROM edges WHERE type <> 'MEMBER_OF'")
def _(spark, d):
    return lookup.edge_shades(code_graph(spark, d).edges, ["MEMBER_OF"])


@query("symbol_bodies", """WITH doc AS (SELECT concat('d', doc_id) AS uid, text, string_split(text, chr(10)) AS lines FROM documents)
SELECT uid, array_to_string(lines[2:3], chr(10)) AS body FROM doc""", graph="one AS (SELECT 1)")
def _(spark, d):
    docs = _table(spark, d, "documents")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("uid"), T.line_range("text", F.lit(2), F.lit(3)).alias("body"))


@query("find_symbol_body", f"""WITH files AS (SELECT DISTINCT file_path AS path, 'a' || chr(10) || file_path || chr(10) || 'c' AS text FROM nodes WHERE kind = 'Class')
SELECT uid, name, kind, n.file_path, start_line, end_line, coalesce(array_to_string(string_split(text, chr(10))[start_line:end_line], chr(10)), '') AS body FROM nodes n LEFT JOIN files ON path = n.file_path WHERE name = 'hot plate'""")
def _(spark, d):
    g = code_graph(spark, d)
    files = g.nodes.filter("kind = 'Class'").select(F.col("file_path").alias("path"), F.concat(F.lit("a\n"), "file_path", F.lit("\nc")).alias("text")).distinct()
    return lookup.bodies(g.nodes, files, "hot plate")


# ---- counts


@query("graph_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def _(spark, d):
    g = code_graph(spark, d)
    return stats.counts(g.nodes, g.edges)


@query("counts_by_kind", "SELECT kind, count(*) AS n, count(*) FILTER (exported) AS exported FROM nodes GROUP BY kind")
def _(spark, d):
    return stats.by_kind(code_graph(spark, d).nodes)


@query("degree_stats", """WITH ends AS (SELECT from_uid AS uid FROM edges UNION ALL SELECT to_uid FROM edges), deg AS (SELECT uid, count(*) AS degree FROM ends GROUP BY uid),
every AS (SELECT n.uid, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON n.uid = deg.uid)
SELECT uid, degree, round(3.0::DOUBLE + 12.0::DOUBLE * degree / (SELECT max(degree) FROM every), 9) AS size FROM every""")
def _(spark, d):
    g = code_graph(spark, d)
    return stats.degrees(g.nodes, g.edges).withColumn("size", F.round("size", 9))


@query("cluster_count", "SELECT count(DISTINCT cluster_id) AS clusters FROM nodes WHERE cluster_id <> ''")
def _(spark, d):
    return stats.cluster_count(code_graph(spark, d).nodes)


@query("call_profile", """WITH x AS (SELECT from_uid AS uid, 1 AS o, 0 AS i FROM edges WHERE type = 'CALLS' UNION ALL SELECT to_uid, 0, 1 FROM edges WHERE type = 'CALLS')
SELECT uid, CAST(sum(o) AS BIGINT) AS calls_out, CAST(sum(i) AS BIGINT) AS calls_in FROM x GROUP BY uid""")
def _(spark, d):
    return stats.call_profile(code_graph(spark, d).edges)


@query("index_status", """WITH emb AS (SELECT concat('p', vec_id) AS uid FROM embeddings)
SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM nodes WHERE uid IN (SELECT uid FROM emb)) AS embedded,
printf('%.1f%%', 100.0 * (SELECT count(*) FROM nodes WHERE uid IN (SELECT uid FROM emb)) / (SELECT count(*) FROM nodes)) AS coverage""")
def _(spark, d):
    g = code_graph(spark, d)
    return stats.status(g.nodes, g.edges, _table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("uid")))


@query("node_edge_ids", """SELECT substr(sha256(concat_ws(':', file_path, name, kind)), 1, 16) AS id, uid AS of FROM nodes
UNION ALL SELECT substr(sha256(concat_ws('|', from_uid, to_uid, type)), 1, 16), concat(from_uid, '>', to_uid) FROM edges
UNION ALL SELECT concat('proc_', substr(sha256(concat('process:', uid)), 1, 16)), concat('process ', uid) FROM nodes WHERE kind = 'Function'""")
def _(spark, d):
    g = code_graph(spark, d)
    a = g.nodes.select(ids.node_uid("file_path", "name", "kind").alias("id"), F.col("uid").alias("of"))
    b = g.edges.select(ids.edge_id("from_uid", "to_uid", "type").alias("id"), F.concat("from_uid", F.lit(">"), "to_uid").alias("of"))
    c = g.nodes.filter("kind = 'Function'").select(ids.process_id("uid").alias("id"), F.concat(F.lit("process "), "uid").alias("of"))
    return a.unionByName(b).unionByName(c)


# ---- traversal


def _impact_sql(start: str, here: str, there: str, least: float, depth: int) -> str:
    return f"""WITH impact AS (SELECT {there} AS uid, 1 AS depth, confidence AS c FROM edges WHERE {here} = '{start}' AND type IN ('CALLS', 'IMPORTS') AND confidence >= {least}
UNION SELECT e.{there}, i.depth + 1, e.confidence * i.c FROM edges e JOIN impact i ON e.{here} = i.uid WHERE e.type IN ('CALLS', 'IMPORTS') AND e.confidence >= {least} AND i.depth < {depth})
SELECT n.uid, n.name, n.kind, n.file_path, i.depth, round(i.c, 9) AS confidence FROM impact i JOIN nodes n ON n.uid = i.uid"""


def _impact(g: Graph, start: str, direction: str, least: float, depth: int) -> DataFrame:
    return lookup_rounded(traverse.impact_nodes(g.nodes, g.edges, start, direction, least, depth))


def lookup_rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 9))


@query("impact_downstream", _impact_sql(START, "from_uid", "to_uid", 0.5, 5))
def _(spark, d):
    return _impact(code_graph(spark, d), START, "downstream", 0.5, 5)


@query("impact_upstream", _impact_sql(CALLEE, "to_uid", "from_uid", 0.95, 3))
def _(spark, d):
    return _impact(code_graph(spark, d), CALLEE, "upstream", 0.95, 3)


@query("impact_min_confidence", _impact_sql(START, "from_uid", "to_uid", 0.93, 5))
def _(spark, d):
    return _impact(code_graph(spark, d), START, "downstream", 0.93, 5)


@query("impact_cyclic", _impact_sql("u12", "from_uid", "to_uid", 0.5, 3), FLOW)
def _(spark, d):
    return _impact(flow_graph(spark, d), "u12", "downstream", 0.5, 3)


_ENTRY = """(kind IN ('Function', 'Method') AND ((exported AND (lower(name) = 'main' OR lower(name) LIKE 'handle%' OR lower(name) LIKE 'serve%' OR lower(name) LIKE 'route%' OR lower(name) LIKE 'controller%'
OR (uid NOT IN (SELECT to_uid FROM edges WHERE type = 'CALLS') AND uid IN (SELECT from_uid FROM edges WHERE type = 'CALLS'))))
OR regexp_extract(lower(file_path), '[^/]*$', 0) IN ('main.go', 'server.go', 'router.go') OR regexp_extract(lower(file_path), '[^/]*$', 0) LIKE 'handler%'))"""


@query("entry_points", f"SELECT uid, name, kind, file_path FROM nodes WHERE {_ENTRY}")
def _(spark, d):
    g = code_graph(spark, d)
    return traverse.entry_points(g.nodes, g.edges).select("uid", "name", "kind", "file_path")


_TRACE = """reached AS (SELECT uid AS entry, uid, 0 AS depth FROM nodes WHERE {0}
UNION SELECT r.entry, e.to_uid, r.depth + 1 FROM reached r JOIN edges e ON e.from_uid = r.uid WHERE e.type = 'CALLS' AND r.depth < {1}),
steps AS (SELECT concat('proc_', substr(sha256(concat('process:', entry)), 1, 16)) AS process_id, entry AS entry_uid, uid AS symbol_uid, min(depth) AS depth FROM reached GROUP BY entry, uid)"""


def _trace(g: Graph, depth: int = 10) -> DataFrame:
    """Traces from all entry points."""
    return traverse.trace(g.edges, traverse.entry_points(g.nodes, g.edges), depth)


@query("process_trace", f"WITH {_TRACE.format(_ENTRY, 10)} SELECT * FROM steps")
def _(spark, d):
    return _trace(code_graph(spark, d)).select("process_id", "entry_uid", "symbol_uid", "depth")


@query("process_trace_cyclic", f"WITH {_TRACE.format('true', 10)} SELECT * FROM steps", FLOW)
def _(spark, d):
    g = flow_graph(spark, d)
    return traverse.trace(g.edges, g.nodes, 10).select("process_id", "entry_uid", "symbol_uid", "depth")


@query("process_step_order")
def _(spark, d):
    g = flow_graph(spark, d)
    return traverse.trace(g.edges, g.nodes, 10)


@query("process_classify", f"""WITH {_TRACE.format(_ENTRY, 10)} SELECT process_id, CASE WHEN bool_or(coalesce(cluster_id, '') = '') THEN 'external' WHEN count(DISTINCT cluster_id) > 1 THEN 'cross_community' ELSE 'single_community' END AS process_type
FROM steps LEFT JOIN nodes ON symbol_uid = uid GROUP BY process_id""")
def _(spark, d):
    g = code_graph(spark, d)
    return traverse.classify(_trace(g), g.nodes)


@query("processes_with_steps", f"""WITH {_TRACE.format(_ENTRY, 10)} SELECT process_id, entry_uid, CAST(count(*) AS INT) AS n_steps, max(depth) AS depth FROM steps GROUP BY process_id, entry_uid""")
def _(spark, d):
    listed = traverse.processes(_trace(code_graph(spark, d)))
    return listed.select("process_id", "entry_uid", F.size("steps").alias("n_steps"), F.array_max(F.transform("steps", lambda s: s["depth"])).alias("depth"))


# ---- retrieval

_TOKENS = r"""list_transform(list_filter(string_split(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'), '(\p{{Lu}})', ' \1', 'g'), ' '), lambda x: strlen(x) >= 2), lambda x: lower(x))"""
_INDEX = f"""words AS (SELECT uid, unnest({_TOKENS.format("concat_ws(' ', name, kind, file_path)")}) AS term FROM nodes),
tf AS (SELECT uid, term, count(*) AS n FROM words GROUP BY uid, term), total AS (SELECT uid, count(*) AS total FROM words GROUP BY uid), freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
index AS (SELECT term, uid, n::DOUBLE / total * (ln(((SELECT count(DISTINCT uid) FROM nodes) + 1)::DOUBLE / (df + 1)) + 1) AS tfidf FROM tf JOIN total USING (uid) JOIN freq USING (term))"""


def _index(g: Graph) -> DataFrame:
    return search.build_index(g.nodes)


@query("tokenize_terms", f"SELECT uid, {_TOKENS.format('name')} AS terms FROM nodes")
def _(spark, d):
    return code_graph(spark, d).nodes.select("uid", T.tokens("name").alias("terms"))


@query("tfidf_index", f"WITH {_INDEX} SELECT term, uid, round(tfidf, 9) AS tfidf FROM index")
def _(spark, d):
    return _index(code_graph(spark, d)).withColumn("tfidf", F.round("tfidf", 9))


_LEX = "lex AS (SELECT uid, round(sum(tfidf), 9) AS score FROM index WHERE term IN ('hot', 'plate', 'economy') GROUP BY uid ORDER BY score DESC, uid LIMIT {0})"


@query("lexical_topk", f"WITH {_INDEX}, {_LEX.format(20)} SELECT * FROM lex")
def _(spark, d):
    return search.lexical(_index(code_graph(spark, d)), ["Hot", "plate", "economy"], 20)


@query("query_terms", """SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(trim(text, ' ')), '\\s+'), lambda x: trim(x, '.,;:!?"''()')), lambda x: strlen(x) >= 2) AS terms FROM documents""", graph="one AS (SELECT 1)")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.query_terms("text").alias("terms"))


_VEC = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), near AS (SELECT concat('p', vec_id) AS uid,
round(1 - list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) * sqrt(list_sum(list_transform(v, lambda x: x * x)))), 9) AS distance FROM embeddings, q ORDER BY distance, uid LIMIT {0})"""


def _embedded(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    e = _table(spark, d, "embeddings")
    return e.select(F.concat(F.lit("p"), "vec_id").alias("uid"), "embedding"), e.filter("vec_id = 7").first()["embedding"]


@query("vector_topk", f"WITH {_VEC.format(15)} SELECT * FROM near", graph="one AS (SELECT 1)")
def _(spark, d):
    e, q = _embedded(spark, d)
    return search.nearest(e, q, 15)


@query("hybrid_rrf", f"""WITH {_INDEX}, {_LEX.format(40)}, {_VEC.format(40)}, ranks AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS r FROM lex UNION ALL SELECT uid, row_number() OVER (ORDER BY distance, uid) FROM near),
fused AS (SELECT uid, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM ranks GROUP BY uid ORDER BY score DESC, uid LIMIT 20) SELECT {NODE.replace('uid', 'nodes.uid', 1)}, score FROM fused JOIN nodes ON nodes.uid = fused.uid""")
def _(spark, d):
    g = code_graph(spark, d)
    e, q = _embedded(spark, d)
    return search.hybrid(g.nodes, _index(g), e, ["hot", "plate", "economy"], q, 20)


@query("hydrate_results", f"""WITH s AS (SELECT concat('p', p_partkey) AS uid, p_retailprice AS score FROM part WHERE p_size = 7 UNION ALL SELECT 'nobody', 1.0) SELECT {NODE.replace('uid', 'nodes.uid', 1)}, score FROM s JOIN nodes ON nodes.uid = s.uid""")
def _(spark, d):
    g = code_graph(spark, d)
    scores = project(spark, d, "SELECT concat('p', p_partkey) AS uid, p_retailprice AS score FROM {part} WHERE p_size = 7 UNION ALL SELECT 'nobody', 1.0")
    return lookup.hydrate(scores, g.nodes)


@query("embed_cache_split", """WITH named AS (SELECT uid, concat_ws(' ', name, file_path, kind) AS text FROM nodes), hashed AS (SELECT uid, sha256(text) AS text_hash FROM named),
cache AS (SELECT DISTINCT text_hash FROM hashed WHERE CAST(substr(uid, 2) AS BIGINT) % 3 = 0) SELECT uid, text_hash, text_hash IN (SELECT text_hash FROM cache) AS hit FROM hashed""")
def _(spark, d):
    nodes = code_graph(spark, d).nodes
    seen = nodes.filter("CAST(substr(uid, 2) AS BIGINT) % 3 = 0")
    cache = seen.select(ids.text_hash(search.symbol_text(("name", "file_path", "kind"))).alias("text_hash")).distinct().withColumn("embedding", F.array(F.lit(0.0)))
    hits, misses = search.split_by_cache(nodes, cache)
    return hits.select("uid", "text_hash", F.lit(True).alias("hit")).unionByName(misses.select("uid", "text_hash", F.lit(False).alias("hit")))


@query("embed_misses", "SELECT uid, sha256(concat_ws(' ', name, file_path, kind)) AS text_hash, CAST(64 AS INT) AS size, CAST(NULL AS VARCHAR) AS error FROM nodes")
def _(spark, d):
    none = spark.createDataFrame([], "text_hash string, embedding array<float>")
    done = search.embed(search.split_by_cache(code_graph(spark, d).nodes, none)[1])
    return done.select("uid", "text_hash", F.size("embedding").alias("size"), "error")


@query("float_codec", "SELECT vec_id, embedding, CAST(256 AS BIGINT) AS n_bytes FROM embeddings", graph="one AS (SELECT 1)")
def _(spark, d):
    packed = _table(spark, d, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("b"))
    return packed.select("vec_id", vectors.from_bytes("b").alias("embedding"), F.octet_length("b").cast("long").alias("n_bytes"))


# ---- communities

_PAIRS = "pairs AS (SELECT least(from_uid, to_uid) AS a, greatest(from_uid, to_uid) AS b, sum(confidence) AS w FROM edges WHERE type IN ('CALLS', 'IMPORTS') AND from_uid IN (SELECT uid FROM nodes) AND to_uid IN (SELECT uid FROM nodes) GROUP BY 1, 2)"
_GIVEN = "members AS (SELECT uid, concat('k', CAST(substr(uid, 2) AS BIGINT) % 7) AS community FROM nodes)"


def _given(g: Graph) -> DataFrame:
    return g.nodes.select("uid", F.concat(F.lit("k"), F.substring("uid", 2, 20).cast("long") % 7).alias("community"))


def _on_both(name: str, sql: str | None, run: Callable[[Graph], DataFrame]) -> None:
    """A query over the cyclic graph and, under another name, over the code graph."""
    query(name, sql, FLOW)(lambda spark, d: run(flow_graph(spark, d)))
    query(f"{name}_code", sql, CODE)(lambda spark, d: run(code_graph(spark, d)))


_on_both(
    "cluster_graph_degree",
    f"WITH {_PAIRS}, ends AS (SELECT a AS uid, w FROM pairs UNION ALL SELECT b, w FROM pairs) SELECT uid, round(sum(w), 6) AS degree FROM ends GROUP BY uid",
    lambda g: community.weighted_degrees(community.cluster_graph(g.nodes, g.edges)).withColumn("degree", F.round("degree", 6)),
)

_COHESION = """placed AS (SELECT x.community AS ca, y.community AS cb, w FROM pairs JOIN members x ON a = x.uid JOIN members y ON b = y.uid),
ends AS (SELECT ca AS community, w, ca = cb AS same FROM placed UNION ALL SELECT cb, w, ca = cb FROM placed),
cohesive AS (SELECT m.community, coalesce(sum(CASE WHEN same THEN w ELSE 0 END) / sum(w), 0) AS cohesion FROM (SELECT DISTINCT community FROM members) m LEFT JOIN ends ON ends.community = m.community GROUP BY m.community)"""

_on_both(
    "cluster_cohesion",
    f"WITH {_PAIRS}, {_GIVEN}, {_COHESION} SELECT community, round(cohesion, 6) AS cohesion FROM cohesive",
    lambda g: community.cohesion(_given(g), community.cluster_graph(g.nodes, g.edges)).withColumn("cohesion", F.round("cohesion", 6)),
)


@query("cluster_label", """WITH named AS (SELECT cluster_id AS community, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE cluster_id <> ''),
each AS (SELECT community, CASE WHEN contains(dir, '/') THEN array_to_string(string_split(dir, '/')[-2:], '/') ELSE dir END AS label, count(*) AS n FROM named GROUP BY 1, 2)
SELECT community, label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, label) AS r FROM each) WHERE r = 1""")
def _(spark, d):
    nodes = code_graph(spark, d).nodes
    return community.labels(nodes.filter("cluster_id <> ''").select("uid", F.col("cluster_id").alias("community")), nodes)


_LABELS = """each AS (SELECT community, CASE WHEN contains(dir, '/') THEN array_to_string(string_split(dir, '/')[-2:], '/') ELSE dir END AS label, count(*) AS n FROM named GROUP BY 1, 2),
labelled AS (SELECT community, label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, label) AS r FROM each) WHERE r = 1)"""


@query("clusters_with_members", f"""WITH {_PAIRS}, {_GIVEN}, {_COHESION}, named AS (SELECT community, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM members JOIN nodes USING (uid)), {_LABELS}
SELECT community, any_value(label) AS label, round(any_value(cohesion), 6) AS cohesion, list_sort(list(uid)) AS members FROM members JOIN cohesive USING (community) JOIN labelled USING (community) GROUP BY community""", FLOW)
def _(spark, d):
    g = flow_graph(spark, d)
    return community.clusters(_given(g), g.nodes, community.cluster_graph(g.nodes, g.edges)).withColumn("cohesion", F.round("cohesion", 6))


_on_both("louvain", None, lambda g: community.louvain(g.nodes, g.edges))
#: What holds of every right partition, whatever it is.
_on_both("louvain_invariants", "SELECT count(*) AS nodes, count(*) AS placed, true AS least, CAST(0 AS BIGINT) AS improving, true AS above FROM nodes", lambda g: community.invariants(g.nodes, g.edges, cut(community.louvain(g.nodes, g.edges))))

_on_both(
    "modularity",
    f"""WITH {_PAIRS}, {_GIVEN}, ends AS (SELECT a AS uid, w FROM pairs UNION ALL SELECT b, w FROM pairs), deg AS (SELECT uid, sum(w) AS degree FROM ends GROUP BY uid), t AS (SELECT sum(degree) / 2 AS total FROM deg),
mass AS (SELECT community, sum(degree) AS mass FROM members JOIN deg USING (uid) GROUP BY community), inside AS (SELECT sum(w) AS w FROM pairs JOIN members x ON a = x.uid JOIN members y ON b = y.uid WHERE x.community = y.community)
SELECT round((SELECT w FROM inside) / total - (SELECT sum(mass * mass) FROM mass) / (4 * total * total), 9) AS modularity FROM t""",
    lambda g: community.modularity(community.cluster_graph(g.nodes, g.edges), _given(g)).withColumn("modularity", F.round("modularity", 9)),
)


# ---- the query language


@query("cypher_node_match", "SELECT name, file_path, start_line AS line FROM nodes WHERE kind = 'Class' AND starts_with(name, 'hot') AND start_line >= 20 ORDER BY uid LIMIT 30")
def _(spark, d):
    g = code_graph(spark, d)
    return cypher.run("MATCH (n:Class) WHERE n.name STARTS WITH 'hot' AND n.startLine >= 20 RETURN n.name, n.filePath, n.startLine AS line LIMIT 30", g.nodes, g.edges)


@query("cypher_inline_prop", "SELECT uid, name, kind, file_path FROM nodes WHERE kind = 'Class' AND name = 'red plate' ORDER BY uid LIMIT 100")
def _(spark, d):
    g = code_graph(spark, d)
    return cypher.run("MATCH (n:Class {name: 'red plate'})", g.nodes, g.edges)


@query("cypher_edge_match", """SELECT a.name AS from_name, b.name AS to_name, e.type, e.confidence FROM edges e JOIN nodes a ON a.uid = e.from_uid JOIN nodes b ON b.uid = e.to_uid
WHERE e.type = 'CALLS' AND e.confidence > 0.96 AND b.name IN ('hot plate', 'red plate') ORDER BY a.uid, b.uid, type LIMIT 50""")
def _(spark, d):
    g = code_graph(spark, d)
    return cypher.run("MATCH (a)-[r:CALLS]->(b) WHERE r.confidence > 0.96 AND b.name IN ['hot plate', 'red plate'] RETURN a.name, b.name LIMIT 50", g.nodes, g.edges)


@query("cypher_reverse_edge", """SELECT a.name AS from_name, b.name AS to_name, e.type, e.confidence FROM edges e JOIN nodes a ON a.uid = e.from_uid JOIN nodes b ON b.uid = e.to_uid
WHERE e.type = 'IMPORTS' AND b.kind = 'Interface' AND a.start_line < 50 ORDER BY a.uid, b.uid, type LIMIT 100""")
def _(spark, d):
    g = code_graph(spark, d)
    return cypher.run("MATCH (s:Interface)<-[r:IMPORTS]-(p) WHERE p.start_line < 50", g.nodes, g.edges)


def _raw(name: str, sql: str, other: str | None = None) -> None:
    @query(name, other or sql)
    def _(spark, d):
        g = code_graph(spark, d)
        return raw_sql.run(spark, sql, nodes=g.nodes, edges=g.edges)


_raw("raw_sql_aggregate", "SELECT type, count(*) AS n, round(avg(confidence), 6) AS mean, count(DISTINCT to_uid) AS targets FROM edges GROUP BY type HAVING count(*) > 10")
_raw("raw_sql_window", "SELECT uid, kind, row_number() OVER (PARTITION BY kind ORDER BY start_line DESC, uid) AS place, lag(uid) OVER (PARTITION BY kind ORDER BY start_line DESC, uid) AS before FROM nodes")
_raw("raw_sql_setops", "SELECT from_uid AS uid FROM edges WHERE type = 'CALLS' INTERSECT SELECT to_uid FROM edges WHERE type = 'MEMBER_OF' EXCEPT SELECT uid FROM nodes WHERE exported")
_raw("raw_sql_rollup", "SELECT kind, exported, count(*) AS n, grouping(exported) AS level FROM nodes GROUP BY ROLLUP (kind, exported)", "SELECT kind, exported, count(*) AS n, CAST(grouping(exported) AS TINYINT) AS level FROM nodes GROUP BY ROLLUP (kind, exported)")
_raw("raw_sql_joins", "WITH heavy AS (SELECT to_uid, count(*) AS n FROM edges GROUP BY to_uid) SELECT n.name, n.kind, h.n AS links FROM nodes n LEFT JOIN heavy h ON h.to_uid = n.uid WHERE n.kind IN ('Type', 'Constant', 'Interface')", "WITH heavy AS (SELECT to_uid, count(*) AS n FROM edges GROUP BY to_uid) SELECT n.name, n.kind, h.n AS links FROM nodes n LEFT JOIN heavy h ON h.to_uid = n.uid WHERE n.kind IN ('Type', 'Constant', 'Interface')")
_raw("raw_sql_dialect", "SELECT uid FROM nodes WHERE name LIKE 'HOT%' OR file_path GLOB 'suppliers/1*'", "SELECT uid FROM nodes WHERE name ILIKE 'HOT%' OR file_path GLOB 'suppliers/1*'")

_raw("raw_sql_concat", "SELECT type, group_concat(DISTINCT left(from_uid, 1)) AS firsts, group_concat(DISTINCT left(to_uid, 1), '+') AS ends FROM edges GROUP BY type", "SELECT type, string_agg(DISTINCT left(from_uid, 1), ',' ORDER BY left(from_uid, 1)) AS firsts, string_agg(DISTINCT left(to_uid, 1), '+' ORDER BY left(to_uid, 1)) AS ends FROM edges GROUP BY type")
_raw("raw_sql_division", "SELECT uid, end_line / 7 AS sevenths, end_line / 7.0 AS share, count(*) OVER (PARTITION BY kind) AS peers FROM nodes", "SELECT uid, end_line // 7 AS sevenths, CAST(end_line / 7.0 AS DOUBLE) AS share, count(*) OVER (PARTITION BY kind) AS peers FROM nodes")

# ---- ingestion

_SOURCE = """concat('export function make', p_partkey, '() {{', chr(10), '  return use', p_partkey, '(1);', chr(10), '}}', chr(10), 'function use', p_partkey, '(x) {{', chr(10), '  return x;', chr(10), '}}', chr(10))"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return project(spark, d, "SELECT concat('src/', p_partkey, '.ts') AS path, " + _SOURCE + " AS text FROM {part}")


@query("extract_symbols", """WITH each AS (SELECT p_partkey AS k, concat('src/', p_partkey, '.ts') AS path FROM part)
SELECT substr(sha256(concat(path, ':make', k, ':Function')), 1, 16) AS uid, concat('make', k) AS name, 'Function' AS kind, path AS file_path, 1::INT AS start_line, 3::INT AS end_line, true AS exported FROM each
UNION ALL SELECT substr(sha256(concat(path, ':use', k, ':Function')), 1, 16), concat('use', k), 'Function', path, 4::INT, 6::INT, false FROM each""", graph="one AS (SELECT 1)")
def _(spark, d):
    return extract.nodes_of(extract.records(_sources(spark, d))).select("uid", "name", "kind", "file_path", "start_line", "end_line", "exported")


@query("resolve_extracted", """WITH each AS (SELECT p_partkey AS k, concat('src/', p_partkey, '.ts') AS path FROM part)
SELECT substr(sha256(concat(path, ':make', k, ':Function')), 1, 16) AS from_uid, substr(sha256(concat(path, ':use', k, ':Function')), 1, 16) AS to_uid, 'CALLS' AS type, 0.95::DOUBLE AS confidence FROM each""", graph="one AS (SELECT 1)")
def _(spark, d):
    found = cut(extract.records(_sources(spark, d).repartition("path")))  # read five times; few bytes of part give many files
    return resolve.resolve(extract.calls_of(found), extract.nodes_of(found))


_REFS = """SELECT concat('p', a) AS from_uid, CASE WHEN b % 10 = 9 THEN concat('this.', n) WHEN b % 10 = 8 THEN concat(n, '_missing') WHEN b % 10 = 7 THEN concat('EXTENDS:', n) ELSE n END AS callee_name FROM (
SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS a, l_partkey AS b, p_name AS n FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) x WHERE a IS NOT NULL"""


@query("resolve_calls", f"""WITH refs AS ({plain(_REFS)}), defs AS (SELECT uid, name, file_path, start_line, package_path AS package FROM nodes),
asked AS (SELECT DISTINCT from_uid, CASE WHEN starts_with(callee_name, 'EXTENDS:') THEN 'EXTENDS' ELSE 'CALLS' END AS type, regexp_replace(regexp_replace(callee_name, '^EXTENDS:', ''), '^[^.]*\\.', '') AS name FROM refs),
placed AS (SELECT a.*, d.file_path, d.package FROM asked a JOIN defs d ON d.uid = a.from_uid),
f AS (SELECT file_path, name, first(uid ORDER BY file_path, start_line, uid) AS u, count(*) AS n FROM defs GROUP BY 1, 2),
p AS (SELECT package, name, first(uid ORDER BY file_path, start_line, uid) AS u, count(*) AS n FROM defs GROUP BY 1, 2),
g AS (SELECT name, first(uid ORDER BY file_path, start_line, uid) AS u, count(*) AS n FROM defs GROUP BY 1),
found AS (SELECT from_uid, coalesce(f.u, p.u, g.u) AS to_uid, type, CAST(CASE WHEN coalesce(f.n, p.n, g.n) > 1 THEN 0.6 WHEN coalesce(f.u, p.u) IS NOT NULL THEN 0.95 ELSE 0.75 END AS DOUBLE) AS c
FROM placed x LEFT JOIN f ON f.file_path = x.file_path AND f.name = x.name LEFT JOIN p ON p.package = x.package AND p.name = x.name LEFT JOIN g ON g.name = x.name)
SELECT from_uid, to_uid, type, max(c) AS confidence FROM found WHERE to_uid IS NOT NULL AND to_uid <> from_uid GROUP BY 1, 2, 3""")
def _(spark, d):
    return resolve.resolve(project(spark, d, _REFS), code_graph(spark, d).nodes)


@query("member_of_edges", "SELECT concat('o', o_orderkey) AS from_uid, concat('c', o_custkey) AS to_uid, 'MEMBER_OF' AS type, 1.0::DOUBLE AS confidence FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    owners = project(spark, d, "SELECT concat('o', o_orderkey) AS uid, concat('c', o_custkey) AS owner_uid FROM {orders}")
    return resolve.member_edges(code_graph(spark, d).nodes, owners)


_PATHS = "CASE page_id % 7 WHEN 0 THEN concat('src/app', page_id, '.ts') WHEN 1 THEN concat('node_modules/x/', page_id, '.js') WHEN 2 THEN concat('lib/', page_id, '.min.js') WHEN 3 THEN concat('a/vendor/', page_id, '.go') WHEN 4 THEN concat('cmd/', page_id, '.pb.go') WHEN 5 THEN concat('docs/', page_id, '.md') ELSE concat('pkg/secret', page_id, '.py') END"


@query("scan_filter", f"""WITH f AS (SELECT page_id, {_PATHS} AS path FROM pages) SELECT page_id, path, CASE page_id % 7 WHEN 0 THEN 'typescript' ELSE 'python' END AS language FROM f WHERE page_id % 7 IN (0, 6) AND NOT (page_id % 7 = 6 AND regexp_matches(path, 'secret1[^/]*\\.py$'))""", graph="one AS (SELECT 1)")
def _(spark, d):
    files = project(spark, d, "SELECT page_id, " + _PATHS + " AS path FROM {pages}")
    good = scan.wanted("path") & scan.supported("path") & ~scan.ignored("path", ["# private", "secret1*.py", "!other.py"])
    return files.filter(good).select("page_id", "path", scan.language("path").alias("language"))


@query("resolve_imports", """SELECT concat('a/b/', p_partkey, '.ts') AS file_path, '../x/./y' AS import_path, 'a/x/y' AS target, 0.95::DOUBLE AS confidence FROM part WHERE p_size < 25
UNION ALL SELECT concat('a/b/', p_partkey, '.ts'), 'react', 'react', 0.85 FROM part WHERE p_size >= 25""", graph="one AS (SELECT 1)")
def _(spark, d):
    return resolve.imports(project(spark, d, "SELECT concat('a/b/', p_partkey, '.ts') AS file_path, CASE WHEN p_size < 25 THEN '../x/./y' ELSE 'react' END AS import_path FROM {part}"))


# ---- change

_OLD = "SELECT concat('orders/', o_orderkey) AS path, sha2(concat(o_orderstatus, o_custkey), 256) AS hash FROM {orders} WHERE o_orderkey % 10 <> 3"
_NEW = "SELECT concat('orders/', o_orderkey) AS path, sha2(concat(CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END, o_custkey), 256) AS hash FROM {orders} WHERE o_orderkey % 10 <> 4"
_DIFF = f"""old AS ({plain(_OLD)}), new AS ({plain(_NEW)}), diff AS (SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
FROM old FULL JOIN new ON old.path = new.path WHERE old.hash IS DISTINCT FROM new.hash)""".replace("sha2(", "sha256(").replace(", 256)", ")")


def _diff(spark: SparkSession, d: str) -> DataFrame:
    return incremental.snapshot_diff(project(spark, d, _OLD), project(spark, d, _NEW))


@query("snapshot_diff", f"WITH {_DIFF} SELECT * FROM diff", graph="one AS (SELECT 1)")
def _(spark, d):
    return _diff(spark, d)


@query("patch_plan", f"WITH {_DIFF} SELECT CASE status WHEN 'added' THEN 'add' WHEN 'deleted' THEN 'delete' ELSE 'update' END AS action, list_sort(list(path)) AS paths FROM diff GROUP BY 1", graph="one AS (SELECT 1)")
def _(spark, d):
    return incremental.plan_lists(_diff(spark, d))


@query("staleness", f"WITH {_DIFF} SELECT true AS is_stale, count(*) AS changed, concat(count(*), ' files changed') AS reason FROM diff", graph="one AS (SELECT 1)")
def _(spark, d):
    return incremental.stale(project(spark, d, _OLD), project(spark, d, _NEW))


@query("first_listing", f"WITH {_DIFF} SELECT path, 'added' AS status FROM new", graph="one AS (SELECT 1)")
def _(spark, d):
    return incremental.first_listing(project(spark, d, _NEW))


_GONE = "uid IN (SELECT uid FROM nodes WHERE file_path IN ('customers/MACHINERY/handler.ts', 'suppliers/3/supplier.go'))"


def _deleted(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    g = code_graph(spark, d)
    paths = spark.createDataFrame([("customers/MACHINERY/handler.ts",), ("suppliers/3/supplier.go",)], "file_path string")
    return store.delete_files(paths, g.nodes, g.edges, postings=_index(g), members=g.nodes.select(F.col("uid").alias("symbol_uid"), "cluster_id"))


@query("delete_by_file", f"SELECT from_uid, to_uid, type, confidence FROM edges WHERE NOT (from_{_GONE}) AND NOT (to_{_GONE})")
def _(spark, d):
    return _deleted(spark, d)["edges"]


@query("delete_by_file_nodes", f"SELECT {NODE.replace('coalesce(package_path, ' + chr(39) * 2 + ') AS ', '').replace('coalesce(cluster_id, ' + chr(39) * 2 + ') AS ', '')} FROM nodes WHERE NOT ({_GONE})")
def _(spark, d):
    return _deleted(spark, d)["nodes"]


@query("delete_by_file_members", f"SELECT uid AS symbol_uid, cluster_id FROM nodes WHERE NOT ({_GONE})")
def _(spark, d):
    return _deleted(spark, d)["members"]


@query("upsert_nodes", "SELECT uid, CASE WHEN kind = 'Class' THEN upper(name) ELSE name END AS name, kind FROM nodes UNION ALL SELECT concat('new', c_custkey), 'fresh', 'Function' FROM customer")
def _(spark, d):
    nodes = code_graph(spark, d).nodes
    new = nodes.filter("kind = 'Class'").withColumn("name", F.upper("name"))
    extra = nodes.filter("kind = 'Function'").withColumns({"uid": F.concat(F.lit("new"), F.substring("uid", 2, 20)), "name": F.lit("fresh")})
    return store.upsert_nodes(nodes, new.unionByName(extra)).select("uid", "name", "kind")


@query("upsert_edges", "SELECT substr(sha256(concat_ws('|', from_uid, to_uid, type)), 1, 16) AS id, from_uid, to_uid, type, CASE WHEN type = 'EXTENDS' THEN 0.7::DOUBLE ELSE confidence END AS confidence FROM edges")
def _(spark, d):
    edges = code_graph(spark, d).edges
    return store.upsert_edges(edges, edges.filter("type = 'EXTENDS'").withColumn("confidence", F.lit(0.7)))


@query("replace_steps", "SELECT process_id, step, uid FROM (SELECT concat('p', o_custkey) AS process_id, o_orderkey AS step, 'old' AS uid FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT concat('p', c_custkey), 0, 'new' FROM customer WHERE c_custkey % 3 = 0)", graph="one AS (SELECT 1)")
def _(spark, d):
    old = project(spark, d, "SELECT concat('p', o_custkey) AS process_id, o_orderkey AS step, 'old' AS uid FROM {orders}")
    new = project(spark, d, "SELECT concat('p', c_custkey) AS process_id, CAST(0 AS BIGINT) AS step, 'new' AS uid FROM {customer} WHERE c_custkey % 3 = 0")
    return store.replace_groups(old, new, ["process_id"])


@query("insert_missing", "SELECT concat('k', n_nationkey) AS key, n_name AS value FROM nation UNION ALL SELECT concat('k', s_suppkey), s_name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)", graph="one AS (SELECT 1)")
def _(spark, d):
    old = project(spark, d, "SELECT concat('k', n_nationkey) AS key, n_name AS value FROM {nation}")
    return store.insert_missing(old, project(spark, d, "SELECT concat('k', s_suppkey) AS key, s_name AS value FROM {supplier}"), ["key"])


@query("index_meta", "SELECT 'def' AS value", graph="one AS (SELECT 1)")
def _(spark, d):
    meta = spark.createDataFrame([("last_commit", "abc"), ("repo_path", "/r")], "key string, value string")
    return store.get_meta(store.set_meta(meta, "last_commit", "def"), "last_commit")


# ---- reports

_CLUSTERED = "members AS (SELECT uid, cluster_id AS community, file_path FROM nodes WHERE cluster_id <> '')"


@query("wiki_rows", f"""WITH {_PAIRS}, {_CLUSTERED}, {_COHESION}, named AS (SELECT community, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM members), {_LABELS}
SELECT community, label, CAST((SELECT count(*) FROM members m WHERE m.community = l.community) AS INT) AS members, printf('%.2f', cohesion) AS cohesion FROM labelled l JOIN cohesive USING (community)""")
def _(spark, d):
    g = code_graph(spark, d)
    members = g.nodes.filter("cluster_id <> ''").select("uid", F.col("cluster_id").alias("community"))
    return reports.cluster_rows(community.clusters(members, g.nodes, community.cluster_graph(g.nodes, g.edges)))


@query("agent_context", """SELECT printf('# shop%s%s%s symbols, %s relations, %s communities.', chr(10), chr(10), format('{:,}', (SELECT count(*) FROM nodes)), format('{:,}', (SELECT count(*) FROM edges)), format('{:,}', (SELECT count(DISTINCT cluster_id) FROM nodes WHERE cluster_id <> ''))) AS text""")
def _(spark, d):
    g = code_graph(spark, d)
    return reports.agent_context(g.nodes, g.edges, g.nodes.filter("cluster_id <> ''").select("cluster_id").distinct(), "shop")


@query("summary_counts", f"""WITH {_TRACE.format(_ENTRY, 10)} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT cluster_id) FROM nodes WHERE cluster_id <> '') AS clusters, (SELECT count(DISTINCT process_id) FROM steps) AS processes""")
def _(spark, d):
    g = code_graph(spark, d)
    return stats.counts(g.nodes, g.edges, g.nodes.filter("cluster_id <> ''").select("cluster_id").distinct(), _trace(g))


@query("module_pages")
def _(spark, d):
    g = flow_graph(spark, d)
    return reports.module_pages(community.clusters(community.louvain(g.nodes, g.edges), g.nodes, community.cluster_graph(g.nodes, g.edges)))


@query("process_rows", f"WITH {_TRACE.format(_ENTRY, 10)} SELECT process_id, n.name, count(*) AS steps FROM steps JOIN nodes n ON n.uid = entry_uid GROUP BY 1, 2")
def _(spark, d):
    return reports.process_rows(_trace(code_graph(spark, d)))


@query("graph_export", """SELECT concat('{"record":"edge","from_uid":"', from_uid, '","to_uid":"', to_uid, '","type":"', type, '","percent":', CAST(round(100 * confidence) AS INT), '}') AS json FROM edges
UNION ALL SELECT concat('{"record":"node","uid":"', uid, '","name":"', name, '","kind":"', kind, '","file_path":"', file_path, '","start_line":', start_line, ',"end_line":', end_line, ',"exported":', exported, ',"package_path":"', package_path, '","cluster_id":"', cluster_id, '"}') FROM nodes""")
def _(spark, d):
    g = code_graph(spark, d)
    # As whole per cents, since engines write doubles in their own ways.
    return reports.graph_export(g.nodes, g.edges.withColumn("percent", F.round(F.col("confidence") * 100).cast("int")).drop("confidence"))


# ---- streams


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(_table(spark, d, name).schema).parquet(f"{d}/{name}.parquet*")


@query("stream_activity", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", graph="one AS (SELECT 1)")
def _(spark, d):
    at = f"{checkpoint_dir(spark)}/activity-{uuid.uuid4().hex}"
    counted = streams.activity(_stream(spark, d, "events"), late="3650 days")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query("stream_embeddings", "SELECT uid, sha256(concat_ws(' ', name, 'suppliers/x.go', kind)) AS text_hash, CAST(64 AS INT) AS size, true AS unit, CAST(NULL AS VARCHAR) AS error FROM nodes WHERE kind = 'Interface'")
def _(spark, d):
    at = f"{checkpoint_dir(spark)}/embed-{uuid.uuid4().hex}"
    suppliers = _stream(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uid"), F.col("s_name").alias("name"), F.lit("Interface").alias("kind"), F.lit("suppliers/x.go").alias("file_path"))
    none = spark.createDataFrame([], "text_hash string, embedding array<float>")
    streams.embeddings(suppliers, lambda: none, f"{at}/rows", f"{at}/offsets").awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.select("uid", "text_hash", F.size("embedding").alias("size"), (F.abs(vectors.norm(F.col("embedding")) - 1) < 1e-5).alias("unit"), "error")


@query("stream_patches", """SELECT concat('make', p_partkey) AS name, concat('src/', p_partkey, '.ts') AS file_path FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT concat('use', p_partkey), concat('src/', p_partkey, '.ts') FROM part WHERE p_partkey % 5 <> 0""", graph="one AS (SELECT 1)")
def _(spark, d):
    at = f"{checkpoint_dir(spark)}/patches-{uuid.uuid4().hex}"
    state = streams.GraphState(spark, f"{at}/state", TABLES["nodes"], "from_uid string, to_uid string, type string, confidence double")
    files = _sources(spark, d)
    files.withColumn("status", F.lit("added")).coalesce(1).write.parquet(f"{at}/feed/one")
    feed = lambda: spark.readStream.schema("path string, text string, status string").parquet(f"{at}/feed/*")
    streams.patches(feed(), state, f"{at}/offsets").awaitTermination()
    gone = files.join(project(spark, d, "SELECT concat('src/', p_partkey, '.ts') AS path FROM {part} WHERE p_partkey % 5 = 0"), "path")
    gone.withColumn("status", F.lit("deleted")).coalesce(1).write.parquet(f"{at}/feed/two")
    streams.patches(feed(), state, f"{at}/offsets").awaitTermination()
    return state.read("nodes").select("name", "file_path")


_CALLER = "concat('export function make', p_partkey, '() {{', chr(10), '  return make', p_partkey + {0}, '(1);', chr(10), '}}', chr(10))"


@query("incremental_equals_full", """WITH k AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 1 THEN p_partkey + 2 ELSE p_partkey + 1 END AS t FROM part WHERE p_partkey % 5 <> 0)
SELECT substr(sha256(concat('src/', x.k, '.ts:make', x.k, ':Function')), 1, 16) AS from_uid, substr(sha256(concat('src/', x.t, '.ts:make', x.t, ':Function')), 1, 16) AS to_uid, 'CALLS' AS type, 0.95::DOUBLE AS confidence
FROM k x JOIN k y ON y.k = x.t""", graph="one AS (SELECT 1)")
def _(spark, d):
    """File k calls what file k + 1 defines. Then every fifth file goes, and the next ones call what file k + 2 defines."""
    at = f"{checkpoint_dir(spark)}/incremental-{uuid.uuid4().hex}"
    state = streams.GraphState(spark, f"{at}/state", TABLES["nodes"], "from_uid string, to_uid string, type string, confidence double")
    files = lambda step, where, status: project(spark, d, f"SELECT concat('src/', p_partkey, '.ts') AS path, {_CALLER.replace('{0}', str(step))} AS text, '{status}' AS status FROM {{part}} WHERE {where}")
    feed = lambda: spark.readStream.schema("path string, text string, status string").parquet(f"{at}/feed/*")
    for name, batch in (("one", files(1, "true", "added")), ("two", files(2, "p_partkey % 5 = 1", "modified").unionByName(files(1, "p_partkey % 5 = 0", "deleted")))):
        batch.coalesce(1).write.parquet(f"{at}/feed/{name}")
        streams.patches(feed(), state, f"{at}/offsets").awaitTermination()
    return state.read("edges")


#: A file of each language: extension, text, and its symbols (name, kind, lines, exported); @ is the key.
_FILES = (
    ("go", "package a\n\ntype Box@ struct {\n  n int\n}\n\nfunc (b *Box@) Open() {\n}\n\nfunc make@(n int) {\n  use(n)\n}\n", (("Box@", "Class", 3, 5, True), ("Open", "Method", 7, 8, True), ("make@", "Function", 10, 12, False))),
    ("py", "import os\n\ndef make@(x):\n    return use(x)\n\nclass _Box@:\n    def open(self):\n        pass\n", (("make@", "Function", 3, 4, True), ("_Box@", "Class", 6, 8, False), ("open", "Function", 7, 8, True))),
    ("java", "import a.b.C;\n\npublic class Box@ {\n  public int open(int n) {\n    return n;\n  }\n}\n", (("Box@", "Class", 3, 7, True), ("open", "Method", 4, 6, True))),
    ("rs", "use a::b;\n\npub fn make@(n: i32) -> i32 {\n  use_it(n)\n}\n\nstruct Box@ {\n  n: i32,\n}\n", (("make@", "Function", 3, 5, True), ("Box@", "Class", 7, 9, False))),
    ("cpp", "#include <a>\n\nclass Box@ {\n};\n\nint make@(int n) {\n  return use(n);\n}\n", (("Box@", "Class", 3, 4, False), ("make@", "Function", 6, 8, False))),
    ("ts", "export interface Shape@ {\n}\nexport class Box@ extends Base {\n  open(n) {\n    return use(n);\n  }\n}\nexport const make@ = (n) => {\n  return n;\n};\n", (("Shape@", "Interface", 1, 2, True), ("Box@", "Class", 3, 7, True), ("open", "Method", 4, 6, True), ("make@", "Function", 8, 10, True))),
)


def _languages_sql() -> str:
    rows = [f"SELECT replace('{n}', '@', k) AS name, '{kind}' AS kind, concat('src/f', k, '.{ext}') AS file_path, {a}::INT AS start_line, {b}::INT AS end_line, {str(x).lower()} AS exported FROM p" for ext, _, found in _FILES for n, kind, a, b, x in found]
    return "WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part) " + " UNION ALL ".join(rows)


@query("extract_languages", _languages_sql(), graph="one AS (SELECT 1)")
def _(spark, d):
    files = spark.createDataFrame([(ext, text) for ext, text, _ in _FILES], "ext string, text string")
    keys = _table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"))
    each = keys.crossJoin(F.broadcast(files)).select(F.concat(F.lit("src/f"), "k", F.lit("."), "ext").alias("path"), F.expr("replace(text, '@', k)").alias("text"))  # six files a key
    return extract.nodes_of(extract.records(each)).select("name", "kind", "file_path", "start_line", "end_line", "exported")


# ---- sessions over a registry


def _indexed(spark: SparkSession, d: str) -> Session:
    """A registry with the driver's graph under two names."""
    registry = Registry(spark, f"{checkpoint_dir(spark)}/registry-{uuid.uuid4().hex}")
    g = code_graph(spark, d)
    links = g.edges.select(ids.edge_id("from_uid", "to_uid", "type").alias("id"), *g.edges.columns)
    registry.write("shop", "nodes", g.nodes)
    registry.write("shop", "edges", links)
    registry.write("shop", "postings", search.build_index(g.nodes))
    registry.write("other", "nodes", g.nodes.filter("kind = 'Type'"))
    for name in ("shop", "other"):
        registry.register(name, f"/src/{name}")
    return Session(registry, "shop")


@query("tool_list_repos", "SELECT 'other' AS name, '/src/other' AS path UNION ALL SELECT 'shop', '/src/shop'", graph="one AS (SELECT 1)")
def _(spark, d):
    return _indexed(spark, d).call("list_repos").select("name", "path")


@query("tool_query_repo", "SELECT uid, name, kind, file_path, start_line, end_line, exported, 'other' AS target_repo, 'shop' AS current_repo, 'symbol_coordinates' AS tool FROM nodes WHERE kind = 'Type' AND name = (SELECT n_name FROM nation WHERE n_nationkey = 3)")
def _(spark, d):
    name = _table(spark, d, "nation").filter("n_nationkey = 3").first()["n_name"]
    return _indexed(spark, d).call("query_repo", tool="symbol_coordinates", target="other", name=name)


@query("tool_query", f"WITH {_INDEX}, {_LEX.format(40)}, ranks AS (SELECT uid, row_number() OVER (ORDER BY score DESC, uid) AS r FROM lex) SELECT {NODE.replace('uid', 'nodes.uid', 1)}, round(1.0::DOUBLE / (60 + r), 9) AS score FROM ranks JOIN nodes ON nodes.uid = ranks.uid WHERE r <= 20")
def _(spark, d):
    return _indexed(spark, d).call("query", query="Hot (plate), economy!", limit=20)


@query("tool_impact", _impact_sql(START, "from_uid", "to_uid", 0.5, 3))
def _(spark, d):
    return lookup_rounded(_indexed(spark, d).call("impact", target="Customer#000000019", max_depth=3))


@query("tool_sql", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(spark, d):
    return _indexed(spark, d).sql("SELECT kind, count(*) AS n FROM nodes GROUP BY kind")


@query("resource_context", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, CAST(0 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS processes")
def _(spark, d):
    return _indexed(spark, d).resource("context")
