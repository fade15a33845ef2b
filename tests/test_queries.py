"""Every query that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillspark.plans import catalog

DATA = os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
