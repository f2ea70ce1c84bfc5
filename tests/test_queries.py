"""Every registered query of the library's own operators against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from meristem import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if isinstance(x, float) else 0.0, str(x)) for x in r))


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(x)))


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.collect(), got.columns), rows_of(want.fetchall(), want.columns)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs_and_repeats(spark, name):
    """What SQL can't express gives rows, and the same ones again; tests/test_library.py has plain versions of some."""
    q = catalog.queries()[name]
    first, again = (q(spark, SF) for _ in range(2))
    a, b = rows_of(first.collect(), first.columns), rows_of(again.collect(), again.columns)
    assert len(a) == len(b) > 0
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
