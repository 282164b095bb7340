"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from sessionweave.plans import catalog

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(WHERE):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{WHERE}/{t}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, str):
        return v
    return f"{float(v):.7g}"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, WHERE)
    sql = con.sql(catalog.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    want = sorted(tuple(plain(r[sql.columns.index(c)]) for c in cols) for r in sql.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
