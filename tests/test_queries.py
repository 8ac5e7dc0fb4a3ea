"""Every query with SQL against DuckDB on the smallest tables, and once more on shuffled input."""

import glob
import math
import os

import duckdb
import pytest

from orbisight import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(names, rows):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())
