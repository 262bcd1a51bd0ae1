"""Resolution over more symbols than Spark expects, and how often its query extracts them."""

import pandas as pd

from codeloom import catalog
from codeloom.operators import resolve

NODE = "uid string, name string, file_path string, start_line int, package_path string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unexpectedly_many_symbols_are_not_broadcast(spark):
    n = 4_000

    def symbols(frames):
        for frame in frames:
            for k in frame["id"]:
                ids = range(k * n // 4, (k + 1) * n // 4)
                yield pd.DataFrame([(f"u{i}", f"name{i}", f"a{i % 7}/f{i // 2}.ts", 1, "") for i in ids], columns=[c.split()[0] for c in NODE.split(", ")])

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        nodes = spark.range(4).mapInPandas(symbols, NODE)
        assert int(nodes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 64 * 1024  # what Spark expects
        refs = nodes.selectExpr("uid AS from_uid", f"concat('name', (CAST(substr(uid, 2) AS INT) + 1) % {n}) AS callee_name")
        edges = resolve.resolve(refs, nodes)
        found = edges.toPandas()
        assert "Broadcast" not in _plan(edges)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    place = {f"u{i}": (f"a{i % 7}/f{i // 2}.ts", f"a{i % 7}") for i in range(n)}
    want = {(f"u{i}", f"u{(i + 1) % n}", 0.95 if place[f"u{i}"][1] == place[f"u{(i + 1) % n}"][1] else 0.75) for i in range(n)}
    assert len(found) == n and set(zip(found["from_uid"], found["to_uid"], found["confidence"], strict=True)) == want


def test_resolve_extracted_extracts_once(spark, tiny):
    assert _plan(catalog.queries()["resolve_extracted"](spark, tiny)).count("MapInPandas") <= 1
