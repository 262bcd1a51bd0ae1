import pytest
from pyspark.sql import functions as F

from codeloom.functions import ids, vectors
from codeloom.functions import text as T
from codeloom.operators import community, incremental, lookup, resolve, search, stats, store, traverse

NODES = "uid string, name string, kind string, file_path string, start_line int, end_line int, exported boolean, package_path string, cluster_id string"
EDGES = "from_uid string, to_uid string, type string, confidence double"


def nodes(spark, *rows):
    """rows: uid, name, kind, file, first, last, exported and, if not empty, package and cluster."""
    return spark.createDataFrame([(*r, *(["", ""][len(r) - 7 :])) for r in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, t, float(c)) for a, b, t, c in rows], EDGES)


def f(uid, name, file="a.ts", kind="Function", first=1, exported=True, cluster=""):
    return (uid, name, kind, file, first, first + 4, exported, "", cluster)


def col(df, name):
    return [r[name] for r in df.collect()]


def test_upsert_and_lookup(spark):
    first = nodes(spark, ("n1", "foo", "Function", "a.ts", 1, 5, True), ("n2", "bar", "Class", "b.ts", 10, 20, False), ("n3", "baz", "Method", "b.ts", 12, 15, False))
    assert first.count() == 3
    assert col(lookup.by_name(first, "foo"), "uid") == ["n1"]
    assert lookup.by_file(first, "b.ts").count() == 2
    again = store.upsert_nodes(first, nodes(spark, ("n1", "foo2", "Function", "a.ts", 1, 5, True), ("n1", "foo3", "Function", "a.ts", 9, 9, True)))
    assert again.count() == 3 and col(lookup.by_uid(again, "n1"), "name") == ["foo3"]
    assert lookup.by_uid(first, "nobody").count() == 0


def test_edges(spark):
    e = edges(spark, ("n1", "n2", "CALLS", 0.95))
    assert col(lookup.edges_from(e, "n1"), "to_uid") == ["n2"] and col(lookup.edges_to(e, "n2"), "from_uid") == ["n1"]
    new = store.upsert_edges(e, edges(spark, ("n1", "n2", "CALLS", 0.5), ("n2", "n1", "CALLS", 0.6), ("n2", "n1", "CALLS", 0.7)))
    assert {(r.from_uid, r.confidence) for r in new.collect()} == {("n1", 0.5), ("n2", 0.7)}


def test_delete_file_takes_edges_both_ways(spark):
    n = nodes(spark, f("n1", "a", "x.ts"), f("n2", "b", "x.ts"), f("n3", "c", "y.ts"))
    paths = spark.createDataFrame([("x.ts",)], "file_path string")
    left = store.delete_files(paths, n, edges(spark, ("n1", "n3", "CALLS", 1), ("n3", "n2", "CALLS", 1)), postings=spark.createDataFrame([("t", "n1"), ("t", "n3")], "term string, uid string"))
    assert left["nodes"].count() == 1 and left["edges"].count() == 0 and col(left["postings"], "uid") == ["n3"]


def test_impact_of_a_chain(spark):
    n = nodes(spark, f("n1", "handler"), f("n2", "service"), f("n3", "repo"))
    e = edges(spark, ("n1", "n2", "CALLS", 0.95), ("n2", "n3", "CALLS", 0.9))
    down = {(r.uid, r.depth, round(r.confidence, 6)) for r in traverse.impact_nodes(n, e, "n1").collect()}
    assert down == {("n2", 1, 0.95), ("n3", 2, 0.855)}
    assert {r.uid for r in traverse.impact_nodes(n, e, "n3", "upstream").collect()} == {"n1", "n2"}
    assert {r.uid for r in traverse.impact_nodes(n, e, "n1", depth=0).collect()} == {"n2"}
    assert traverse.impact_nodes(n, e, "n1", least=0.96).count() == 0
    with pytest.raises(ValueError):
        traverse.impact(e, n, "sideways")


def test_impact_of_a_cycle_returns_to_the_start(spark):
    e = edges(spark, ("a", "b", "CALLS", 1), ("b", "a", "CALLS", 1), ("a", "b", "IMPORTS", 1), ("a", "c", "EXTENDS", 1))
    start = spark.createDataFrame([("a",)], "uid string")
    got = sorted((r.depth, r.uid) for r in traverse.impact(e, start, depth=3).collect())
    assert got == [(1, "b"), (2, "a"), (3, "b")]


def test_entry_points_and_traces(spark):
    n = nodes(spark, f("n1", "handleRequest", "handler.ts", cluster="c1"), f("n2", "processData", cluster="c1"), f("n3", "saveToDb", cluster="c2"), f("n4", "helperInternal", exported=False), f("n5", "Server", kind="Class"), f("n6", "x", "cmd/Main.go", exported=False))
    e = edges(spark, ("n1", "n2", "CALLS", 0.9), ("n2", "n3", "CALLS", 0.9), ("n3", "n1", "CALLS", 0.9), ("n1", "n4", "EXTENDS", 1))
    entries = traverse.entry_points(n, e)
    assert set(col(entries, "uid")) == {"n1", "n6"}
    steps = traverse.trace(e, entries.filter("uid = 'n1'"))
    assert [(r.step_index, r.symbol_uid, r.depth) for r in steps.orderBy("step_index").collect()] == [(0, "n1", 0), (1, "n2", 1), (2, "n3", 2)]
    assert col(traverse.classify(steps, n), "process_type") == ["cross_community"]
    assert col(traverse.classify(steps.filter("depth < 2"), n), "process_type") == ["single_community"]
    assert col(traverse.classify(steps, n.filter("uid <> 'n2'")), "process_type") == ["external"]
    listed = traverse.processes(steps).first()
    assert [s.symbol_uid for s in listed.steps] == ["n1", "n2", "n3"]


def test_trace_visits_in_order_of_parents(spark):
    e = edges(spark, ("r", "b", "CALLS", 1), ("r", "a", "CALLS", 1), ("b", "c", "CALLS", 1), ("a", "d", "CALLS", 1), ("a", "c", "CALLS", 1), ("d", "r", "CALLS", 1))
    steps = traverse.trace(e, nodes(spark, f("r", "root")), 10).orderBy("step_index").collect()
    assert [(r.symbol_uid, r.depth) for r in steps] == [("r", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2)]


def test_lexical_search(spark):
    n = nodes(spark, f("n1", "handleUserRequest"), f("n2", "getUserData"), f("n3", "parseConfig"))
    index = search.build_index(n)
    assert set(col(search.lexical(index, ["User", "user"]), "uid")) == {"n1", "n2"}
    assert search.lexical(index, []).count() == 0
    assert index.filter("tfidf <= 0").count() == 0
    fused = search.hybrid(n, index, None, ["user"], limit=1)
    assert fused.count() == 1 and fused.first()["score"] <= 2 / 61


def test_vector_search(spark):
    e = spark.createDataFrame([("n1", [0.1, 0.2, 0.3, 0.4]), ("n2", [0.9, 0.8, 0.7, 0.6]), ("n3", [1.0]), ("n4", [0.0] * 4)], "uid string, embedding array<float>")
    assert col(search.nearest(e, [0.1, 0.2, 0.3, 0.4], 2), "uid") == ["n1", "n2"]
    assert {r.uid: r.distance for r in search.nearest(e, [0.1, 0.2, 0.3, 0.4], 4).collect()}["n3"] == 1.0
    assert search.nearest(e, [0.0] * 4).count() == 0
    both = search.hybrid(nodes(spark, f("n1", "alpha"), f("n2", "beta")), search.build_index(nodes(spark, f("n1", "alpha"), f("n2", "beta"))), e, ["beta"], [0.1, 0.2, 0.3, 0.4])
    assert col(both, "uid")[0] == "n2"


def test_float_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    got = df.select(vectors.to_bytes("v").alias("b")).select("b", vectors.from_bytes("b").alias("v")).collect()
    assert bytes(got[0].b).hex() == "0000c03f000000c0" and got[0].v == [1.5, -2.0] and got[1].v is None


def test_embedding_cache(spark):
    n = nodes(spark, f("n1", "alpha"), f("n2", "beta"))
    none = spark.createDataFrame([], "text_hash string, embedding array<float>")
    hits, misses = search.split_by_cache(n, none)
    done = search.embed(misses, search.hashed)
    assert hits.count() == 0 and done.count() == 2
    hits, misses = search.split_by_cache(n, search.embedded(done).filter("uid = 'n1'").select("text_hash", "embedding"))
    assert col(hits, "uid") == ["n1"] and col(misses, "uid") == ["n2"]

    def broken(texts):
        raise RuntimeError("down")

    failed = search.embed(misses, broken).collect()
    assert [(r.uid, r.embedding, r.error) for r in failed] == [("n2", None, "RuntimeError: down")] and search.embedded(search.embed(misses, broken)).count() == 0
    assert len(search.embed(misses, search.zeros).first()["embedding"]) == 384


BRIDGE = [("a1", "a2", 0.95), ("a2", "a3", 0.95), ("a1", "a3", 0.9), ("b1", "b2", 0.95), ("b2", "b3", 0.95), ("b1", "b3", 0.9), ("a3", "b1", 0.3)]


def test_two_communities(spark):
    n = nodes(spark, *(f(u, u, f"/src/{u[0]}/x.ts") for u in ("a1", "a2", "a3", "b1", "b2", "b3", "z")))
    e = edges(spark, *((a, b, "CALLS", c) for a, b, c in BRIDGE))
    found = {r.uid: r.community for r in community.louvain(n, e).collect()}
    assert found == {"a1": "a1", "a2": "a1", "a3": "a1", "b1": "b1", "b2": "b1", "b3": "b1", "z": "z"}
    pairs = community.cluster_graph(n, e)
    members = spark.createDataFrame(list(found.items()), "uid string, community string")
    inside = {r.community: r.cohesion for r in community.cohesion(members, pairs).collect()}
    assert inside["a1"] == pytest.approx(2 * 2.8 / (2 * 2.8 + 0.3)) and inside["z"] == 0
    assert {r.community: r.label for r in community.labels(members, n).collect()}["a1"] == "src/a"
    alone = members.withColumn("community", F.col("uid"))
    assert community.modularity(pairs, members).first()[0] > community.modularity(pairs, alone).first()[0]
    assert set(col(community.assigned(n, members), "cluster_id")) == {"a1", "b1", "z"}


def test_communities_leave_no_move_that_gains(spark):
    """Rings of cliques, a star, and random links; alike at any partitioning."""
    import random

    r = random.Random(2)
    e = [(f"q{k}{i}", f"q{k}{j}", "CALLS", 0.9) for k in range(6) for i in range(5) for j in range(i)] + [(f"q{k}0", f"q{(k + 1) % 6}1", "IMPORTS", 0.5) for k in range(6)]
    e += [("hub", f"leaf{k}", "CALLS", 0.7) for k in range(40)] + [(f"x{r.randrange(30)}", f"x{r.randrange(30)}", "CALLS", r.random()) for _ in range(120)]
    e = list({(a, b, t): (a, b, t, c) for a, b, t, c in e}.values())
    n = nodes(spark, *(f(u, u) for u in sorted({x for a, b, _, _ in e for x in (a, b)})))
    found = [community.louvain(n, edges(spark, *e).repartition(k)) for k in (1, 5)]
    assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect()))
    one = community.invariants(n, edges(spark, *e), found[0]).first()
    assert (one.nodes, one.placed, one.least, one.improving, one.above) == (n.count(), n.count(), True, 0, True)
    members = {x.uid: x.community for x in found[0].collect()}
    assert all(members[f"q{k}{i}"] == members[f"q{k}0"] for k in range(6) for i in range(5)) and {members[f"leaf{k}"] for k in range(40)} == {"hub"}


def test_communities_are_the_same_by_joins(spark):
    e = edges(spark, *((a, b, "CALLS", c) for a, b, c in BRIDGE))
    n = nodes(spark, *(f(u, u) for u in ("a1", "a2", "a3", "b1", "b2", "b3")))
    one, joins = (sorted(map(tuple, community.louvain(n, e, one_task=k).collect())) for k in (1000, 0))
    assert one == joins


def test_degenerate_communities(spark):
    none = spark.createDataFrame([], NODES)
    nothing = spark.createDataFrame([], EDGES)
    assert community.louvain(none, nothing).count() == 0
    one = nodes(spark, f("n1", "a"))
    assert col(community.louvain(one, nothing), "community") == ["n1"]
    assert community.cluster_graph(one, edges(spark, ("n1", "n1", "EXTENDS", 1))).count() == 0
    assert col(community.louvain(one, edges(spark, ("n1", "n1", "CALLS", 1))), "community") == ["n1"]


def test_resolution_tiers(spark):
    n = nodes(spark, f("u1", "add", "/src/math.ts"), f("u2", "multiply", "/src/math.ts"), f("u3", "main", "/src/index.ts"), f("u4", "far", "/lib/far.ts"), f("u5", "dup", "/lib/a.ts"), f("u6", "dup", "/lib/b.ts"), f("u7", "Base", "/src/base.ts", "Class"))
    refs = spark.createDataFrame([("u2", "add", 1), ("u3", "add", 2), ("u3", "far", 3), ("u3", "dup", 4), ("u3", "this.add", 5), ("u3", "a.b.add", 6), ("u3", "nothing", 7), ("u3", "main", 8), ("u3", "EXTENDS:Base", 9)], "from_uid string, callee_name string, line int")
    got = {(r.from_uid, r.to_uid, r.type): r.confidence for r in resolve.resolve(refs, n).collect()}
    assert got == {("u2", "u1", "CALLS"): 0.95, ("u3", "u1", "CALLS"): 0.95, ("u3", "u4", "CALLS"): 0.75, ("u3", "u5", "CALLS"): 0.6, ("u3", "u7", "EXTENDS"): 0.95}


def test_overview(spark):
    n = nodes(spark, f("c", "MyClass", "/repo/src/foo.go", "Class", 1), f("m", "doWork", "/repo/src/foo.go", "Method", 2), f("h", "HelperFunc", "/repo/src/foo.go", first=20), f("p", "internalFn", "/repo/src/foo.go", first=30, exported=False))
    e = edges(spark, ("m", "c", "MEMBER_OF", 1))
    assert col(lookup.overview(n, e, "src/foo.go"), "uid") == ["c", "h", "p"]
    assert col(lookup.overview(n, e, "SRC/foo.go", include_private=False), "uid") == ["c", "h"]
    assert lookup.overview(n, e, "other.go").count() == 0
    assert lookup.overview(n, e, "src/foo.go", root="/repo").count() == 3


def test_references_and_context(spark):
    n = nodes(spark, f("a", "callMe"), f("b", "target", "b.ts"))
    e = edges(spark, ("a", "b", "CALLS", 0.9), ("ghost", "b", "CALLS", 0.9))
    assert lookup.references(n, e, "target").count() == 1
    assert lookup.references(n, e, "target", ["calls"]).count() == 1
    assert lookup.references(n, e, "target", ["IMPORTS"]).count() == 0
    assert lookup.references(n, e, "target", least=0.95).count() == 0
    assert lookup.references(n, e, "nobody").count() == 0
    assert {(r.direction, r.other_uid) for r in lookup.context(n, e, "target").collect()} == {("incoming", "a"), ("incoming", "ghost")}
    assert col(lookup.rename_plan(n, "target", "goal"), "new_name") == ["goal"]


def test_bodies(spark):
    files = spark.createDataFrame([("a.ts", "one\ntwo\nfunction ProcessOrder() {\n}\n")], "path string, text string")
    n = nodes(spark, ("x", "ProcessOrder", "Function", "a.ts", 3, 4, True), ("y", "ProcessOrder", "Function", "gone.ts", 1, 2, True))
    assert {r.uid: r.body for r in lookup.bodies(n, files, "ProcessOrder").collect()} == {"x": "function ProcessOrder() {\n}", "y": ""}


def test_changes(spark):
    old = spark.createDataFrame([("b", "1"), ("c", "1"), ("d", "1"), ("same", "1")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("same", "1")], "path string, hash string")
    plan = {r.action: r.paths for r in incremental.plan_lists(incremental.snapshot_diff(old, new)).collect()}
    assert plan == {"add": ["a"], "update": ["b", "c"], "delete": ["d"]}
    assert incremental.stale(old, new).first().asDict() == {"is_stale": True, "changed": 4, "reason": "4 files changed"}
    assert incremental.stale(old, old).first()["is_stale"] is False
    assert incremental.stale(old.limit(0), new).first()["reason"] == "not indexed yet"
    assert incremental.mode(old.limit(0)) == "full" and incremental.mode(old) == "incremental" and incremental.mode(old, True) == "full"


def test_meta_and_clearing(spark):
    meta = spark.createDataFrame([("last_commit", "a"), ("repo_path", "/r")], "key string, value string")
    assert store.get_meta(meta, "nothing").first()[0] == ""
    left = store.cleared({"index_meta": meta, "nodes": nodes(spark, f("n", "a")), "embed_cache": meta})
    assert left["nodes"].count() == 0 and col(left["index_meta"], "key") == ["repo_path"] and left["embed_cache"].count() == 2


def test_functions(spark):
    row = spark.createDataFrame([("HTTPServer getUser_id2 é", "/a/b/c.min.js", "this.service.getUser")], "n string, p string, q string")
    got = row.select(T.tokens("n").alias("t"), T.dirname("p").alias("d"), T.basename("p").alias("b"), T.extension("p").alias("e"), T.area_label("p").alias("l"), T.unqualified("q").alias("u"), T.file_name("n").alias("f"), T.query_terms(F.lit(' "Foo," barBaz a ')).alias("q"), T.alpha_hex(F.lit(0.5)).alias("x")).first()
    assert got.t == ["server", "get", "user", "id2", "é"]
    assert (got.d, got.b, got.e, got.l, got.u) == ("/a/b", "c.min.js", ".js", "a/b", "service.getUser")
    assert got.f == "httpserver-getuser_id2--" and got.q == ["foo", "barbaz"] and got.x == "80"
    import hashlib

    uid = row.select(ids.node_uid(F.lit("a.ts"), F.lit("foo"), F.lit("Function"))).first()[0]
    assert uid == hashlib.sha256(b"a.ts:foo:Function").hexdigest()[:16]


def test_degrees_of_unconnected(spark):
    got = {r.uid: (r.degree, r.size) for r in stats.degrees(nodes(spark, f("a", "a"), f("b", "b")), edges(spark, ("a", "a", "CALLS", 1))).collect()}
    assert got == {"a": (2, 15.0), "b": (0, 3.0)}
    assert stats.degrees(nodes(spark, f("a", "a")), spark.createDataFrame([], EDGES)).first()["size"] == 3.0


def test_other_dialect(spark):
    from codeloom.plans import raw_sql

    n = nodes(spark, f("a", "x"), f("b", "y"), f("c", "z", kind="Class"))
    ask = lambda sql: sorted(map(tuple, raw_sql.run(spark, sql, nodes=n).collect()))
    assert ask("SELECT kind, group_concat(uid), count(*) / 2 FROM nodes GROUP BY kind") == [("Class", "c", 0), ("Function", "a,b", 1)]
    assert ask("WITH t AS (SELECT 3/2 AS h, 3/2.0 AS s, 'a/b' AS t FROM nodes LIMIT 1) SELECT h, CAST(s AS DOUBLE), t FROM t") == [(1, 1.5, "a/b")]
    assert ask("SELECT group_concat(uid, ';') FROM nodes WHERE uid IN (SELECT uid FROM nodes WHERE name = 'x')") == [("a",)]
    spark.range(1).createOrReplaceTempView("foreign_rows")
    for bad in ("SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM foreign_rows", "SELECT * FROM nodes WHERE uid IN (SELECT CAST(id AS STRING) FROM foreign_rows)", "SELECT * FROM range(3)"):
        with pytest.raises(raw_sql.NotReading):
            raw_sql.run(spark, bad, nodes=n)
    spark.range(7).createOrReplaceTempView("nodes")
    assert len(ask("SELECT * FROM nodes")) == 3 and spark.table("nodes").count() == 7
    spark.catalog.dropTempView("nodes")
