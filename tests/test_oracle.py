"""Every query with SQL against DuckDB over the smallest tables; every other one must run and give rows of its schema."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

from faintline.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that compares equal whichever engine made it."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(DATA).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    found = df.collect()
    if name not in catalog.oracle_sql():
        assert len(df.columns) == len(set(df.columns))
        return
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_sql_has_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
