"""Every registered catalogue query against its SQL twin in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from framelake.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple((x is None, x if isinstance(x, (int, float)) else 0, str(x)) for x in row)


def same(x, y):
    return x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=key)
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_entry_names_are_registered():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
