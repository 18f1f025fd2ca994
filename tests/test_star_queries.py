"""Every query of the graph and of the load path against its SQL on the smallest tables."""

import duckdb
import pytest

from graphmill.plans import load_queries, star_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


SQL = star_queries.SQL | load_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = (star_queries.queries() | load_queries.QUERIES)[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = sorted(got.columns)
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    order = lambda rows: sorted((tuple(str(x) for x in r) for r in rows))
    assert order(got.select(*columns).collect()) == order([tuple(r[k] for k in place) for r in want.fetchall()])


def test_queries_without_sql(spark):
    found = star_queries.queries()
    for name in sorted(set(found) - set(star_queries.SQL)):
        assert found[name](spark, SF).count() > 0, name


def test_center_piece_runs_all_rounds(spark, monkeypatch):
    seen = []

    def walks(step, queries, **given):
        seen.append(given["rounds"])
        return queries.selectExpr("node as query", "node", "1.0D as score")

    monkeypatch.setattr(star_queries.weights, "random_walks", walks)
    star_queries.queries()["center_piece_subgraph"](spark, SF)
    assert seen == [star_queries.weights.ROUNDS] == [80]


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 234 and [r["depth"] for r in rows] == sorted(r["depth"] for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
