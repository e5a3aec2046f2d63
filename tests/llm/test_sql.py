"""Queries that SQL can express, against that SQL over whole tables."""

import os

import duckdb
import pytest

from rasterlake.llm import registry


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_sql(spark, name, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want = con.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    key = got.columns[0]
    a, b = (d[got.columns].sort_values(key).reset_index(drop=True) for d in (got, want))
    for c in got.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
