"""Joins and set operations (JOIN, SET) over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import joins as J
from tracewell.plans.registry import Registry
from tracewell.session import standing, table
from tracewell.sources import relations as R

reg = Registry(R.CTES)
QUERIES, ORACLES = reg.queries, reg.oracles
MS = "(epoch_us(ts) // 1000)"


def _events(spark, d):
    from tracewell.operators.changes import epoch_us

    return table(spark, d, "events").withColumn("ms", F.floor(epoch_us(F.col("ts")) / 1000))


@reg(
    "SELECT t.file AS dst_file, s.file AS src_file, e.kind, count(*) AS n FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.dst JOIN files f ON f.path = t.file GROUP BY ALL",
    "files symbols edges",
)
def edges_by_file(spark, d):
    s = R.symbols(spark, d).select("id", "file")
    e = R.edges(spark, d).join(s.withColumnsRenamed({"id": "src", "file": "src_file"}), "src").join(s.withColumnsRenamed({"id": "dst", "file": "dst_file"}), "dst")
    known = R.files(spark, d, "id").select(F.col("path").alias("dst_file"))
    return e.join(known, "dst_file", "left_semi").groupBy("dst_file", "src_file", "kind").agg(F.count("*").alias("n"))


@reg("SELECT o.o_orderkey AS commit_id, l.l_partkey AS path_id, coalesce(l.l_returnflag, 'M') AS status FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = 4")
def hunk_status(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.lit(4).alias("n"))
    return o.join(R.file_changes(spark, d), ["commit_id", "n"], "left").select("commit_id", "path_id", F.coalesce("status", F.lit("M")).alias("status"))


@reg("SELECT uid FROM symbols WHERE starts_with(lower(name), 'scan_') UNION SELECT uid FROM symbols WHERE starts_with(lower(leaf), 'scan_')", "symbols")
def named_probe(spark, d):
    s = R.symbols(spark, d)
    return s.where(F.lower("name").startswith("scan_")).select("uid").union(s.where(F.lower("leaf").startswith("scan_")).select("uid")).distinct()


@reg("SELECT 'message' AS facet, doc_id AS ref FROM documents WHERE contains(lower(text), 'daemon') UNION ALL SELECT 'path', id FROM files WHERE contains(lower(path), 'daemon') OR contains(path, 'lib/') UNION ALL SELECT 'symbol', id FROM symbols WHERE contains(lower(name), 'batch')", "files symbols")
def facet_union(spark, d):
    docs = table(spark, d, "documents").where(F.lower("text").contains("daemon")).select(F.lit("message").alias("facet"), F.col("doc_id").alias("ref"))
    f = R.files(spark, d, "id").where(F.lower("path").contains("daemon") | F.col("path").contains("lib/")).select(F.lit("path").alias("facet"), F.col("id").alias("ref"))
    s = R.symbols(spark, d).where(F.lower("name").contains("batch")).select(F.lit("symbol").alias("facet"), F.col("id").alias("ref"))
    return docs.unionByName(f).unionByName(s)


@reg("SELECT f.path, count(s.id) AS symbols, min(s.line) AS first_line FROM files f LEFT JOIN symbols s ON s.file = f.path GROUP BY f.path", "files symbols")
def file_outline(spark, d):
    return R.files(spark, d, "id").join(R.symbols(spark, d).select("id", "line", F.col("file").alias("path")).withColumnRenamed("id", "sid"), "path", "left").groupBy("path").agg(F.count("sid").alias("symbols"), F.min("line").alias("first_line"))


@reg("SELECT s.id FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id)", "symbols edges")
def no_incoming(spark, d):
    return R.symbols(spark, d).select("id").join(R.edges(spark, d).select(F.col("dst").alias("id")), "id", "left_anti")


@reg("SELECT s.id FROM symbols s WHERE s.id IN (SELECT dst FROM edges WHERE kind = 'route')", "symbols edges")
def routed_symbols(spark, d):
    return R.symbols(spark, d).select("id").join(R.edges(spark, d).where("kind = 'route'").select(F.col("dst").alias("id")), "id", "left_semi")


@reg(
    f"""WITH e AS (SELECT event_id, user_id, event_type, {MS} AS ms FROM events)
      SELECT a.event_id AS error_id, b.event_id, b.ms - a.ms AS delta_ms FROM e a JOIN e b ON b.ms BETWEEN a.ms - 30000 AND a.ms + 30000 WHERE a.event_type = 'error' AND b.event_type <> 'error'"""
)
def correlated_events_30s(spark, d):
    e = _events(spark, d)
    a = e.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ms").alias("a_ms"))
    b = e.where("event_type <> 'error'").select("event_id", F.col("ms").alias("b_ms"))
    return J.within(a, b, "a_ms", "b_ms", 30_000).select("error_id", "event_id", (F.col("b_ms") - F.col("a_ms")).alias("delta_ms"))


HUNKS = "hunks AS (SELECT id AS hunk, file, line - 3 AS lo, line + 12 AS hi FROM symbols)"


def _hunks(spark, d):
    return R.symbols(spark, d).select(F.col("id").alias("hunk"), "file", (F.col("line") - 3).alias("lo"), (F.col("line") + 12).alias("hi"))


@reg(f"WITH {HUNKS} SELECT h.hunk, s.id FROM hunks h JOIN symbols s ON s.file = h.file AND h.lo <= s.end_line AND s.line <= h.hi", "symbols")
def hunk_symbols(spark, d):
    s = R.symbols(spark, d).select("id", "file", "line", "end_line")
    return J.overlapping(_hunks(spark, d), s, ["file"], ("lo", "hi"), ("line", "end_line")).select("hunk", "id")


@reg(
    """SELECT p.id AS point, arg_min(s.id, (s.end_line - s.line, -s.line, s.id)) AS id FROM (SELECT id, file, line + 2 AS at FROM symbols) p LEFT JOIN symbols s ON s.file = p.file AND p.at BETWEEN s.line AND s.end_line GROUP BY p.id""",
    "symbols",
)
def innermost_interval(spark, d):
    s = R.symbols(spark, d).select("id", "file", "line", "end_line")
    points = s.select(F.col("id").alias("point"), "file", (F.col("line") + 2).alias("at"))
    return J.innermost(points, s, ["file"], "at", "line", "end_line", "id", ["point"])


@reg(
    f"""WITH {HUNKS}, spans AS (SELECT DISTINCT file, lo AS span_start, hi AS span_end FROM hunks), pts AS (SELECT file, span_start, span_end, unnest(range(span_start, span_end + 1)) AS x FROM spans),
      free AS (SELECT p.* FROM pts p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file = p.file AND p.x BETWEEN s.line AND s.end_line)),
      g AS (SELECT *, x - row_number() OVER (PARTITION BY file, span_start, span_end ORDER BY x) AS g FROM free)
      SELECT file, span_start, span_end, min(x) AS start, max(x) AS "end" FROM g GROUP BY file, span_start, span_end, g""",
    "symbols",
)
def interval_residues(spark, d):
    spans = _hunks(spark, d).select("file", F.col("lo").alias("line"), F.col("hi").alias("end_line"))
    return J.residues(spans, R.symbols(spark, d).select("file", "line", "end_line"), ["file"], "line", "end_line")


REGIONS = """regions AS (SELECT uid, file, leaf AS name, id FROM symbols WHERE kind IN ('function', 'method')),
  calls AS (SELECT DISTINCT s.uid AS caller, t.uid AS callee FROM edges e JOIN regions s ON s.id = e.src JOIN regions t ON t.id = e.dst WHERE e.kind = 'call'),
  imports AS (SELECT DISTINCT s.file AS importer, t.file AS imported FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.dst WHERE e.kind = 'import')"""


def _regions(spark, d):
    s = R.symbols(spark, d)
    e = R.edges(spark, d)
    regions = s.where("kind IN ('function', 'method')").select("uid", "file", F.col("leaf").alias("name"), "id")
    x = lambda df, end, names: df.select(*[F.col(k).alias(v) for k, v in names.items()])
    calls = e.where("kind = 'call'").join(x(regions, "src", {"id": "src", "uid": "caller"}), "src").join(x(regions, "dst", {"id": "dst", "uid": "callee"}), "dst").select("caller", "callee").distinct()
    imports = e.where("kind = 'import'").join(x(s, "src", {"id": "src", "file": "importer"}), "src").join(x(s, "dst", {"id": "dst", "file": "imported"}), "dst").select("importer", "imported").distinct()
    return regions.drop("id"), calls, imports


@reg(
    f"""WITH {REGIONS}, pair AS (SELECT caller AS x, callee AS y FROM calls UNION SELECT callee, caller FROM calls), near AS (SELECT importer AS x, imported AS y FROM imports UNION SELECT imported, importer FROM imports)
      SELECT uid, 'same-file' AS reason, file AS "with", n - 1 AS others FROM (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM regions) WHERE n > 1
      UNION ALL SELECT uid, 'same-name', name, n - 1 FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM regions) WHERE n > 1
      UNION ALL SELECT x, 'call-edge', y, 1 FROM pair WHERE x <> y
      UNION ALL SELECT r.uid, 'import-adjacency', y, (SELECT count(*) FROM regions o WHERE o.file = y) FROM near JOIN regions r ON r.file = x WHERE x <> y AND y IN (SELECT file FROM regions)""",
    "symbols edges",
)
def region_conflicts(spark, d):
    return J.conflicts(*_regions(spark, d))


@reg(f"WITH {REGIONS} SELECT imported AS file, count(DISTINCT importer) AS importers FROM imports GROUP BY imported HAVING count(DISTINCT importer) > 1", "symbols edges")
def shared_files(spark, d):
    imports = _regions(spark, d)[2]
    return imports.groupBy(F.col("imported").alias("file")).agg(F.count_distinct("importer").alias("importers")).where("importers > 1")


@reg("SELECT event_id, CASE WHEN contains(props, '\"k\": 1') THEN 'a' ELSE 'b' END AS hit FROM events WHERE event_type = 'error' AND (contains(props, '\"k\": 1') OR contains(props, '\"k\": 7'))")
def error_sink(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    held = J.sink_matches(e, ['"k": 1', '"k": 7'], "props")
    return e.where(F.size(held) > 0).select("event_id", F.when(F.array_contains(held, '"k": 1'), "a").otherwise("b").alias("hit"))


@reg(
    """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, parent_id DESC) AS rn FROM oc_session) WHERE rn = 1)
      SELECT c.id, p.id AS parent FROM s c LEFT JOIN s p ON p.id = c.parent_id AND p.agent = c.agent"""
)
def parent_sessions(spark, d):
    s = standing(table(spark, d, "oc_session").select("id", "parent_id", "agent", "time_updated"), "id", ["time_updated"])
    rows = s.select("id", "parent_id", "agent", F.col("id").alias("sid"))
    return J.link_parents(rows, ["agent"], "id", "parent_id", "sid").select("id", "parent")


@reg(
    """WITH specs AS (SELECT path AS importer, regexp_extract(path, '([^/]*)/[^/]*$', 1) || '/' || regexp_replace(regexp_extract(path, '[^/]*$'), '[.].*$', '') AS spec FROM files),
      hit AS (SELECT importer, spec, path, (SELECT coalesce(min(i) - 1, least(len(a), len(b))) FROM (SELECT unnest(range(1, least(len(a), len(b)) + 1)) AS i) WHERE a[i] <> b[i]) AS shared
        FROM (SELECT s.importer, s.spec, f.path, string_split(s.importer, '/') AS a, string_split(f.path, '/') AS b FROM specs s JOIN files f ON regexp_replace(f.path, '[.][^./]*$', '') = regexp_replace(s.spec, '[.][^./]*$', '') OR ends_with(regexp_replace(f.path, '[.][^./]*$', ''), '/' || regexp_replace(s.spec, '[.][^./]*$', ''))))
      SELECT importer, spec, arg_min(path, (-shared, path)) AS target FROM hit GROUP BY importer, spec""",
    "files",
)
def resolved_imports(spark, d):
    f = R.files(spark, d, "id")
    stem = F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), "[.].*$", "")
    specs = f.select(F.col("path").alias("importer"), F.concat(F.regexp_extract("path", "([^/]*)/[^/]*$", 1), F.lit("/"), stem).alias("spec"))
    return J.resolve_suffix(specs, f, "spec", "importer", "path")


@reg(
    f"""WITH {REGIONS}, sites AS (SELECT e.id, s.file, regexp_replace(e.target, '^.*(::|#|[.])', '') AS name FROM (SELECT DISTINCT id, src, target FROM index_edges WHERE kind = 'call') e JOIN symbols s ON s.id = e.src),
      pf AS (SELECT file, leaf AS name, min(id) AS sid, count(*) AS n FROM symbols GROUP BY ALL),
      t0 AS (SELECT s.id, p.sid FROM sites s JOIN pf p ON p.file = s.file AND p.name = s.name),
      t1 AS (SELECT s.id, min(p.sid) AS sid FROM sites s JOIN imports i ON i.importer = s.file JOIN pf p ON p.file = i.imported AND p.name = s.name GROUP BY s.id HAVING count(*) = 1),
      t2 AS (SELECT name, min(sid) AS sid FROM pf GROUP BY name HAVING sum(n) = 1)
      SELECT s.id, coalesce(t0.sid, t1.sid, t2.sid) AS dst, CASE WHEN coalesce(t0.sid, t1.sid) IS NOT NULL THEN 'exact' ELSE 'probable' END AS tier
      FROM sites s LEFT JOIN t0 ON t0.id = s.id LEFT JOIN t1 ON t1.id = s.id LEFT JOIN t2 ON t2.name = s.name WHERE coalesce(t0.sid, t1.sid, t2.sid) IS NOT NULL""",
    "symbols edges",
)
def resolved_calls(spark, d):
    from tracewell.operators.orphans import leaf

    s = R.symbols(spark, d)
    e = table(spark, d, "index_edges").where("kind = 'call'").select("id", "src", "target").distinct()
    sites = e.join(s.select(F.col("id").alias("src"), "file"), "src").select("id", "file", leaf(F.col("target")).alias("name"))
    return J.resolve_calls(sites, s.select(F.col("id").alias("sid"), "file", F.col("leaf").alias("name")), _regions(spark, d)[2])


@reg("SELECT split_part(file, '/', 1) AS repo, kind, count(*) AS n FROM symbols WHERE contains(file, '/') GROUP BY ALL", "symbols")
def workspace_fan_out(spark, d):
    """Every repository of the tables: the first folder of the paths."""
    s = R.symbols(spark, d).where(F.col("file").contains("/")).withColumn("repo", F.substring_index("file", "/", 1))
    return s.groupBy("repo", "kind").agg(F.count("*").alias("n"))
