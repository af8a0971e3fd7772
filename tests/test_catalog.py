"""Every registered query against its SQL on the tables, and how queries are registered."""

from collections import Counter

import duckdb
import pytest

from gridlake.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == sorted(df.columns)
    assert Counter(repr(tuple(r[c] for c in cols)) for r in rows) == Counter(repr(tuple(x)) for x in cursor.fetchall())


def test_rates_solve_their_equation(spark, sf):
    for name in ("fn_irr", "fn_xirr"):
        rows = catalog.QUERIES[name](spark, sf).collect()
        assert all(r.rate is None or abs(r.left) < 1 for r in rows) and any(r.rate is not None for r in rows)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
