"""Every query of the library that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from strataq.corpus import RAW
from strataq.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in RAW:
        path = f"{data}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    found = catalog.queries()[name](spark, data)
    wanted = duck.sql(SQL[name])
    assert canonical([tuple(r) for r in found.collect()], found.columns) == canonical(wanted.fetchall(), wanted.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data, name):
    catalog.queries()[name](spark, data).collect()
