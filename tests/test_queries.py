"""Each raster query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from rasterlake.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    want = con.sql(queries.SQL[name]).df()
    keys = [k for k in ("y", "x", "zone_id", "bin") if k in got.columns]
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (d[cols].sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] - b[c]).abs().fillna(0) <= 1e-4 * (1 + b[c].abs().fillna(0))).all() and (a[c].isna() == b[c].isna()).all(), c


def many_parts(path, rows):
    """A folder with a full raster of ``rows`` rows of parts, and a connection that sees it."""
    c = duckdb.connect()
    c.sql(f"COPY (SELECT i AS p_partkey, 900.0 + i * 7919 % 100003 / 100 AS p_retailprice, (i * 31 % 50)::INT AS p_size FROM range({20 * rows}) t(i)) TO '{path}/part.parquet'")
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{path}/part.parquet'")
    return str(path), c


def differing(spark, folder, con, name):
    """Rows of a query, and how many are in its result or its SQL's alone."""
    queries.QUERIES[name](spark, folder).write.parquet(f"{folder}/{name}")
    con.sql(f"CREATE VIEW got AS SELECT * FROM '{folder}/{name}/*.parquet'")
    con.sql(f"CREATE TABLE want AS SELECT * FROM ({queries.SQL[name]})")
    rows = con.sql("SELECT count(*) FROM got").fetchall()[0][0]
    apart = con.sql("SELECT count(*) FROM want FULL JOIN got USING (y, x) WHERE want.b1 IS NULL OR got.b1 IS NULL OR abs(want.b1 - got.b1) > 1e-4 * (1 + abs(want.b1))").fetchall()[0][0]
    return rows, apart


def test_chain_beyond_a_pole(spark, tmp_path):
    """So many rows that latitudes go on beyond the south pole, to -248 degrees, where the tangent comes round."""
    folder, con = many_parts(tmp_path, 30000)
    assert differing(spark, folder, con, "chain_reproject_algebra_clip") == (600000, 0)


@pytest.mark.parametrize("rows", [15000, 30000])
def test_bilinear_beyond_a_pole(spark, tmp_path, rows):
    """To -98 degrees, where the box runs north from its first row, and to -248."""
    folder, con = many_parts(tmp_path, rows)
    assert differing(spark, folder, con, "reproject_bilinear") == (20 * rows, 0)
    filled = con.sql("SELECT count(*) FROM got WHERE b1 <> -9999").fetchall()[0][0]
    assert filled == (20 if rows == 15000 else 20 * rows)


@pytest.mark.parametrize("rows", [15000, 30000])
def test_nearest_beyond_a_pole(spark, tmp_path, rows):
    folder, con = many_parts(tmp_path, rows)
    assert differing(spark, folder, con, "reproject_nearest") == (20 * rows, 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
