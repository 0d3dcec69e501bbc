"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module

ROOT = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, name):
    folder = f"{ROOT}/sf0.001"
    df = entry_module.queries()[name](spark, folder)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
