"""Every query with SQL agrees with DuckDB on the small tables; the others return rows."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    if v is None or v != v:
        return "~"
    if isinstance(v, (float, decimal.Decimal)) or type(v) is int and abs(v) < 1 << 50:
        return f"{float(v):.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in entry.oracle_sql():
        out = duck.execute(entry.oracle_sql()[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == sorted(tuple(plain(r[i]) for i in order) for r in out.fetchall())
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
