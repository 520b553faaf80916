"""Every query against its SQL in another engine."""

import duckdb
import pytest

from quern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
