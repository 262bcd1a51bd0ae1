import pytest

from codeloom import catalog

from .sql import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, tiny, con, name):
    same(QUERIES[name](spark, tiny), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.count() > 0 and df.columns


def test_impact_reads_few_columns(spark, tiny):
    g = catalog.code_graph(spark, tiny)
    from codeloom.operators import lookup

    plan = lookup.edges_from(g.edges, "c19")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "Cartesian" not in plan and "Python" not in plan


def test_entry(spark, tiny):
    import __spark_entry__ as entry

    assert entry.queries()["impact_downstream"](spark, tiny).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
