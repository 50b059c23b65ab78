"""Every registered query of the library's own against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from tracelake.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLES:
        return
    made = tables.execute(catalogue.ORACLES[name])
    names = [c[0] for c in made.description]
    want = [tuple(r[names.index(c)] for c in df.columns) for r in made.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
