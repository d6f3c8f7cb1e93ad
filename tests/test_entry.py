import os

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")
SOME = ("edges_consolidated_gm", "by_group_gn", "avnn_degree_und_out_ge", "fitness_exp_degree_ge", "multi_fitness_projected_degree_ge", "cond_degree_ge", "sample_binary_ge")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_queries_equal_sql(spark, name):
    import duckdb

    from maxentnet import queries

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[cols].itertuples(index=False)))
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    from maxentnet import queries

    assert set(queries.queries()) == set(queries.oracle_sql())


def test_a_missing_library_leaves_the_network_queries(monkeypatch):
    import sys

    import __spark_entry__
    from maxentnet import queries

    for name in [n for n in sys.modules if n.startswith("maxentnet.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)  # an import of it fails
    assert set(__spark_entry__.queries()) == set(queries.queries()) and set(__spark_entry__.oracle_sql()) == set(queries.oracle_sql())


def test_graphs_are_shared_while_their_tables_last(spark):
    from maxentnet import queries
    from maxentnet.plans import scratch

    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are not here")
    g = queries._ge(spark, DATA)
    assert queries._ge(spark, DATA) is g and queries._ge(spark, DATA, True) is not g
    scratch.forget(g.vertices)
    assert queries._ge(spark, DATA) is not g
