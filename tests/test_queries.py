"""Every registered query of the library proper against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from kelpgrid.plans import catalog, details, enrichment, more, reports, wording  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, db, small, name):
    df = catalog.QUERIES[name](spark, small)
    result = db.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_every_query_has_sql():
    """All but the greedy choice, which tests/test_wording.py holds against brute force."""
    assert set(catalog.QUERIES) == set(catalog.SQL) | wording.NO_SQL
