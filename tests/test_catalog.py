"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

from lumenry import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert rows
        return
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in df.columns) for r in got.fetchall())
    assert Counter(tuple(plain(r[c]) for c in df.columns) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["company", "selected"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
