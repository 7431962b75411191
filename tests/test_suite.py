"""Every query of the suite against DuckDB."""

import duckdb
import pytest
from oracle import connect, difference

from docpipe.suite import queries as suite


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(suite.queries()))
def test_against_sql(name, spark, small, con):
    df = suite.queries()[name](spark, small)
    sql = suite.oracle_sql().get(name)
    if sql is None:
        df.count()
    else:
        assert difference(df, con, sql) is None


def test_arith_beside_halves(spark, tmp_path):
    """Orders whose roots come within a bit of a half in the seventh place."""
    spark.sql("SELECT o_orderkey, o_orderkey % 1000 AS o_custkey, 10.25D AS o_totalprice FROM VALUES (5075052L), (4101826L), (9L), (NULL) AS t(o_orderkey)").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert difference(suite.queries()["q_arith"](spark, str(tmp_path)), con, suite.oracle_sql()["q_arith"]) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
