"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from marlstone.plans import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _key(row):
    return tuple((v is None, repr(round(v, 6)) if isinstance(v, float) else repr(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if sql is None:
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    want = [tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (name, a, b)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
