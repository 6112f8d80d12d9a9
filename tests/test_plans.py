"""Every registered query with SQL gives the same rows as the second engine on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from normspark import plans

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in SF.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, engine, name):
    df = plans.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = engine.execute(plans.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_parsing_queries_is_spread(spark, tmp_path):
    """A table of short rows is one task's, however long a query takes to parse."""
    spark.range(50).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert plans.queries()["e2_parse_query"](spark, str(tmp_path)).rdd.getNumPartitions() == 4
