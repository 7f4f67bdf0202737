"""Every registered query on the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import verify

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(("p4", "p6", "p7", "p8", "p9"))])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = verify.rows(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql:
        c = con.execute(sql)
        assert got == verify.rows([x[0] for x in c.description], c.fetchall())


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
