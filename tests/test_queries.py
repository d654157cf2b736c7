"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from larkspur import catalog_queries

SF = "/root/testdata/sf0.001"
ORACLE = catalog_queries.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in catalog_queries.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog_queries.queries()))
def test_query(spark, db, name):
    df = catalog_queries.queries()[name](spark, SF)
    got = df.collect()
    assert got or name == "ident_collisions"
    if name in ORACLE:
        rel = db.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = rel.fetchall()
        order = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(key, got)) == sorted(key([r[i] for i in order]) for r in want)
