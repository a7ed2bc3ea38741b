"""Every registered query of the engine against its SQL, over the smallest tables."""

import duckdb
import pytest

from folioforge.plans import catalogue

TABLES = "documents pages conversations benchmark labels embeddings".split()
KIND = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(repr, r)) for r in df.select(columns).collect())
    assert rows
    if name in catalogue.SQL:
        found = db.sql(catalogue.SQL[name])
        assert sorted(found.columns) == columns
        kinds = dict(zip(found.columns, map(str, found.types), strict=True))
        assert {f.name: KIND[f.dataType.simpleString()] for f in df.schema} == kinds
        order = [found.columns.index(c) for c in columns]
        assert rows == sorted(tuple(repr(r[i]) for i in order) for r in found.fetchall())


def test_sql_names_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
