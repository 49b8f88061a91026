"""Every registered query with SQL against DuckDB."""

import duckdb
import pytest

from docquarry.queries import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_rows(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple(map(str, r)))
    result = duck.sql(registry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=lambda r: tuple(map(str, r)))


def test_caps_over_more_rows_than_the_older_engine_sorts(spark, tmp_path):
    path = f"{tmp_path}/lineitem.parquet"
    # One file that is read as one split, the smallest keys last.
    spark.range(0, 1_200_000, 1, 1).selectExpr("(1200000 - id) div 300 AS l_orderkey", "CAST(id % 5 AS INT) AS l_linenumber").write.parquet(path)
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{path}/*.parquet'")
    got = registry.queries()["o_caps"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(registry.oracle_sql()["o_caps"]).fetchall())


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(registry.queries()) - set(WITH_SQL)):
        assert registry.queries()[name](spark, sf).count() > 0, name


def test_flagship(spark, sf):
    assert registry.flagship(spark, sf).count() > 0
