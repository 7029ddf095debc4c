"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from frameloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(v), 7) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name in catalogue.SQL:
        listed = ",".join(f'"{c}"' for c in columns)
        assert plain(got) == plain(oracle.sql(f"SELECT {listed} FROM ({catalogue.SQL[name]})").fetchall())
    else:
        assert df.schema.fields
