"""Every query of the text problems on the smallest tables, against its SQL where it has one."""

from pathlib import Path

import duckdb
import pytest

import verify
from tracewell.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = verify.rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] and (got[1] or name == "p6_realigned")
    if name in queries.ORACLES:
        c = con.execute(queries.ORACLES[name])
        assert got == verify.rows([x[0] for x in c.description], c.fetchall())


def test_shares_add_up(spark):
    rows = queries.p8_shares(spark, DATA).collect()
    for column in [c for c in rows[0].asDict() if c.startswith(("reached", "share", "actual"))]:
        assert sum(r[column] or 0 for r in rows) == pytest.approx(1.0, abs=1e-6)


def test_pack_and_fill_agree(spark):
    packed = queries.p7_pack(spark, DATA).collect()
    assert packed and queries.p7_fill(spark, DATA).count() > 0


def test_clock_errors_are_undone(spark):
    rows = [r for r in queries.p6_realigned(spark, DATA).collect()]
    assert all(r["restored"] for r in rows)


def test_reply_links_change_nothing_where_times_stand(spark, tmp_path):
    """p6_found against its SQL on messages that all declare to answer their session's last one."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ["oc_message", "oc_part", "oc_session", "agent_clocks"]:
        p = Path(DATA, f"{t}.parquet")
        linked = r"""* REPLACE (regexp_replace(data, '^\s*\{\s*"', '{"parentID":"' || max_by(id, time_created) OVER (PARTITION BY session_id) || '","') AS data)"""
        c.execute(f"COPY (SELECT {linked if t == 'oc_message' else '*'} FROM '{p}') TO '{tmp_path}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    assert c.execute("SELECT count(*) > 100 FROM oc_message WHERE data LIKE '%parentID%' AND json_valid(data)").fetchone()[0]
    df = queries.p6_found(spark, str(tmp_path))
    got = verify.rows(df.columns, [tuple(r) for r in df.collect()])
    q = c.execute(queries.ORACLES["p6_found"])
    assert got[1] and got == verify.rows([x[0] for x in q.description], q.fetchall())
    # where clocks are aligned the same links do count
    assert queries.conversation_turns(spark, str(tmp_path), texts=False).count() < len(got[1])
