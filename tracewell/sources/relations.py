"""The engine's relations over the stored tables, and the same as SQL CTEs.

``files``     index_files: one standing row per path
``symbols``   index_symbols: the live standing row per uid
``edges``     resolved edges between symbols: src, dst (symbol ids), kind, tier
``turns``     search_hits as conversation turns
``commits``   orders as a commit log; ``file_changes`` lineitem as its changes
``errors``    error events
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import timeline
from tracewell.session import standing, table
from tracewell.sources.times_sql import moments


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    cols = columns or ("id", "path", "hash", "lang")
    t = table(spark, d, "index_files").select("path", "indexed_at", *[c for c in ("id", "hash", "lang", "facts", "stat_len", "head") if c in cols])
    return standing(t, "path", ["indexed_at", *(["id"] if "id" in cols else [])]).select("path", *[c for c in cols if c != "path"])


def symbols(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "index_symbols").select("id", "uid", "file", "kind", "name", "leaf", "signature", "line", "end_line", "indexed_at", "dropped_at")
    return standing(t, "uid", ["indexed_at", "id"]).where("dropped_at IS NULL").drop("indexed_at", "dropped_at")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, kind, tier``: both ends live; an edge marked resolved is exact, any
    other probable.  Repeated rows count once, parallel edges stay."""
    s = symbols(spark, d).select("id", "uid")
    e = table(spark, d, "index_edges").select("id", "src", "dst", "kind", "line", "resolved").dropDuplicates(["id"])
    return (
        e.alias("e")
        .join(s.select(F.col("id").alias("dst_id"), F.col("uid").alias("_u")), F.col("e.dst") == F.col("_u"))
        .join(s.select(F.col("id").alias("_s")), F.col("e.src") == F.col("_s"))
        .select("e.id", "e.src", F.col("dst_id").alias("dst"), "e.kind", "e.line", F.when(F.col("resolved") == 1, "exact").otherwise("probable").alias("tier"))
    )


def turns(spark: SparkSession, d: str, timed: bool = False) -> DataFrame:
    """``turn_id, session_id, seq, agent, cwd, role, text`` and, where ``timed``, ``ts``:
    the moment the hit's time text denotes on its agent's clock, null where none."""
    t = table(spark, d, "search_hits").dropDuplicates(["turn_id"])
    if not timed:
        return t.select("turn_id", "session_id", "seq", "agent", "cwd", "role", F.col("snippet").alias("text"))
    t = t.select("turn_id", "session_id", "seq", "agent", "cwd", "role", F.col("ts").alias("_ts"), F.col("snippet").alias("text"))
    read = timeline.read_times(t, "_ts", "agent", "session_id", ["seq", "turn_id"], timeline.clocks(table(spark, d, "agent_clocks")), tag="ts")
    return read.select("turn_id", "session_id", "seq", "agent", "cwd", "role", "ts", "text")


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed_at"), F.col("o_custkey").alias("author"), F.col("o_orderstatus").alias("state")
    )


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path_id"), F.col("l_returnflag").alias("status"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("size")
    )


CTES = {
    "files": "files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, id DESC) AS rn FROM index_files) WHERE rn = 1)",
    "symbols": """symbols AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY uid ORDER BY indexed_at DESC, id DESC) AS rn FROM index_symbols) WHERE rn = 1 AND dropped_at IS NULL)""",
    "edges": """edges AS (SELECT e.id, e.src, t.id AS dst, e.kind, e.line, CASE WHEN e.resolved = 1 THEN 'exact' ELSE 'probable' END AS tier
      FROM (SELECT DISTINCT id, src, dst, kind, line, resolved FROM index_edges) e JOIN symbols t ON t.uid = e.dst JOIN symbols s ON s.id = e.src)""",
    "turns": f"""hr AS (SELECT turn_id AS key, agent, ts AS t FROM search_hits), {moments("hr", "hm")},
      turns AS (SELECT turn_id, session_id, seq, agent, cwd, role, hm.ms AS ts, snippet AS text
      FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY seq) AS rn FROM search_hits) LEFT JOIN hm ON key = turn_id WHERE rn = 1)""",
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_orderdate AS committed_at, o_custkey AS author, o_orderstatus AS state FROM orders)",
    "file_changes": "file_changes AS (SELECT l_orderkey AS commit_id, l_partkey AS path_id, l_returnflag AS status, l_linenumber AS n, l_quantity AS size FROM lineitem)",
}
