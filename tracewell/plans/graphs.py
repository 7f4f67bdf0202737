"""Graph operators (GRF) over symbols and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import graph as G
from tracewell.plans.registry import Registry
from tracewell.session import cut, table
from tracewell.sources import relations as R

reg = Registry(R.CTES | {"calls": "calls AS (SELECT DISTINCT src, dst, CASE WHEN min(tier) OVER (PARTITION BY src, dst) = 'exact' THEN 0 ELSE 1 END AS t FROM edges WHERE kind = 'call')"})
QUERIES, ORACLES = reg.queries, reg.oracles


def _calls(spark, d):
    return R.edges(spark, d).where("kind = 'call'")


@reg("SELECT e.dst AS id, 'caller' AS side, e.src AS other, e.kind, count(*) AS n FROM edges e GROUP BY ALL UNION ALL SELECT e.src, 'callee', e.dst, e.kind, count(*) FROM edges e GROUP BY ALL", "symbols edges")
def direct_neighbours(spark, d):
    e = R.edges(spark, d)
    up = e.groupBy(F.col("dst").alias("id"), F.lit("caller").alias("side"), F.col("src").alias("other"), "kind").agg(F.count("*").alias("n"))
    down = e.groupBy(F.col("src").alias("id"), F.lit("callee").alias("side"), F.col("dst").alias("other"), "kind").agg(F.count("*").alias("n"))
    return up.unionByName(down)


IMPACT = """s0 AS (SELECT id AS seed FROM symbols WHERE id % 20 = 0),
  r1 AS (SELECT seed, c.src AS id, min(c.t) AS t FROM s0 JOIN calls c ON c.dst = seed WHERE c.src <> seed GROUP BY ALL),
  r2 AS (SELECT r.seed, c.src AS id, min(greatest(r.t, c.t)) AS t FROM r1 r JOIN calls c ON c.dst = r.id WHERE c.src <> r.seed AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.seed = r.seed AND x.id = c.src) GROUP BY ALL),
  r3 AS (SELECT r.seed, c.src AS id, min(greatest(r.t, c.t)) AS t FROM r2 r JOIN calls c ON c.dst = r.id WHERE c.src <> r.seed AND NOT EXISTS (SELECT 1 FROM r1 x WHERE x.seed = r.seed AND x.id = c.src) AND NOT EXISTS (SELECT 1 FROM r2 x WHERE x.seed = r.seed AND x.id = c.src) GROUP BY ALL),
  im AS (SELECT *, 1 AS depth FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)"""


def _impact(spark, d):
    return G.hops(_calls(spark, d), R.symbols(spark, d).where("id % 20 = 0"), 3)


@reg(f"WITH {IMPACT} SELECT seed, id, depth, CASE WHEN t = 0 THEN 'exact' ELSE 'probable' END AS tier FROM im", "symbols edges calls")
def impact_3hop(spark, d):
    return _impact(spark, d)


@reg(
    f"""WITH {IMPACT}, u AS (SELECT DISTINCT regexp_replace(trim(name), '^.*(::|#|[.])', '') AS leaf FROM ruby_hybrid_unresolved WHERE op = 'added'), g AS (SELECT seed, count_if(depth = 1) AS direct, count(*) AS reached FROM im GROUP BY seed)
      SELECT seed, direct, reached, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][least(CASE WHEN direct > 50 THEN 3 WHEN direct > 15 THEN 2 WHEN direct > 3 THEN 1 ELSE 0 END + CASE WHEN leaf IN (SELECT leaf FROM u) THEN 1 ELSE 0 END, 3) + 1] AS risk FROM g JOIN symbols s ON s.id = g.seed""",
    "symbols edges calls",
    whole="direct",
)
def impact_risk(spark, d):
    from tracewell.operators.orphans import leaf
    from tracewell.session import blank_to_null

    u = table(spark, d, "ruby_hybrid_unresolved").where("op = 'added'").select(leaf(blank_to_null("name")).alias("leaf")).distinct().withColumn("open", F.lit(True))
    g = _impact(spark, d).groupBy("seed").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count("*").alias("reached"))
    s = R.symbols(spark, d).select(F.col("id").alias("seed"), "leaf").join(u, "leaf", "left")
    return g.join(s, "seed").select("seed", "direct", "reached", G.risk(F.col("direct"), F.lit(0), F.coalesce("open", F.lit(False))).alias("risk"))


@reg("SELECT dst AS id, count(DISTINCT src) AS referrers FROM edges WHERE kind = 'reference' GROUP BY dst", "symbols edges")
def referenced_by(spark, d):
    return R.edges(spark, d).where("kind = 'reference'").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("referrers"))


_REACH = """WITH RECURSIVE reach(id, depth) AS (SELECT min(src), 0 FROM calls UNION SELECT c.dst, r.depth + 1 FROM reach r JOIN calls c ON c.src = r.id WHERE r.depth < 12)
  SELECT id, min(depth) AS depth FROM reach GROUP BY id"""


@reg(_REACH, "symbols edges calls", recursive=True)
def reachable(spark, d):
    e = _calls(spark, d)
    first = e.agg(F.min("src").alias("id"))
    return G.reach(e, first, first.where("false"), 12)[1]


_TRACE = """WITH RECURSIVE hop AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('call', 'has_method')), reach(id, depth) AS (SELECT min(src), 0 FROM calls UNION SELECT c.dst, r.depth + 1 FROM reach r JOIN hop c ON c.src = r.id WHERE r.depth < 12),
  lvl AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id), far AS (SELECT id, depth FROM lvl ORDER BY depth DESC, id LIMIT 1),
  back(step, id) AS (SELECT depth, id FROM far UNION ALL SELECT b.step - 1, (SELECT min(c.src) FROM hop c JOIN lvl l ON l.id = c.src WHERE c.dst = b.id AND l.depth = b.step - 1) FROM back b WHERE b.step > 0)
  SELECT step::INT AS step, id FROM back"""


@reg(_TRACE, "symbols edges calls", recursive=True)
def shortest_path(spark, d):
    """From the least caller over calls and methods to a symbol out of reach: the path to
    the furthest one reached."""
    e = cut(R.edges(spark, d).where("kind IN ('call', 'has_method')"))
    first = _calls(spark, d).agg(F.min("src")).first()[0]
    return G.trace(e, first, -1, 12, furthest=True)


SCC = """sub AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('call', 'import', 'association')), path(a, b) AS (SELECT src, dst FROM sub UNION SELECT p.a, s.dst FROM path p JOIN sub s ON s.src = p.b)"""


def _sub(spark, d):
    return R.edges(spark, d).where("kind IN ('call', 'import', 'association')")


@reg(f"WITH RECURSIVE {SCC} SELECT p.a AS id, min(least(p.a, p.b)) AS component FROM path p JOIN path q ON q.a = p.b AND q.b = p.a GROUP BY p.a", "symbols edges", recursive=True)
def scc_cycles(spark, d):
    return G.components(_sub(spark, d))


@reg()
def cycle_witnesses(spark, d):
    """A shortest closed walk through the least member of each cycle (checked in the tests)."""
    e = cut(_sub(spark, d))
    return G.witness(e, G.components(e))


@reg()
def label_clusters(spark, d):
    e = cut(_calls(spark, d))
    return G.clusters(e, G.label_propagation(e), R.symbols(spark, d))


def _ilike(c, patterns):
    return " OR ".join(f"{c} ILIKE '{p}'" for p in patterns)


@reg(f"SELECT s.id, count(*) AS out FROM symbols s JOIN edges e ON e.src = s.id AND e.kind = 'call' WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.dst = s.id AND x.kind = 'call') AND NOT ({_ilike('s.name', G.TEST_NAMES)}) AND NOT ({_ilike('s.file', G.TEST_PATHS)}) GROUP BY s.id", "symbols edges")
def entry_points(spark, d):
    return G.entry_points(_calls(spark, d), R.symbols(spark, d))


@reg()
def flows_from_entries(spark, d):
    e = cut(_calls(spark, d))
    f = G.flows(e, G.entry_points(e, R.symbols(spark, d)), 4, 3)
    return f.select("entry", F.size("members").alias("steps"), F.xxhash64("members").alias("members_hash"))


@reg(
    """SELECT s.id, s.uid, s.file, s.line FROM symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id AND e.kind IN ('call', 'reference')) AND leaf <> 'main'
      AND NOT (leaf = 'init' AND ends_with(file, '.go')) AND NOT regexp_matches(file, '(^|/)(test|tests|__tests__|spec)/') AND NOT regexp_matches(regexp_extract(file, '[^/]*$'), '_test\\.(go|py)$|^test_.*\\.py$|\\.test\\.|\\.spec\\.')
      AND leaf NOT IN (SELECT regexp_replace(trim(name), '^.*(::|#|[.])', '') FROM ruby_hybrid_unresolved WHERE op = 'added' AND name IS NOT NULL)""",
    "symbols edges",
)
def dead_nodes(spark, d):
    from tracewell.operators.orphans import leaf
    from tracewell.session import blank_to_null

    u = table(spark, d, "ruby_hybrid_unresolved").where("op = 'added'").select(leaf(blank_to_null("name")).alias("leaf"))
    return G.dead_code(R.edges(spark, d), R.symbols(spark, d), u)


@reg("SELECT id, name FROM symbols WHERE kind = 'class' AND regexp_matches(name, '^(Badge|Panel|Anchor|Link)') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = symbols.id AND e.kind IN ('route', 'call'))", "symbols edges")
def dead_interactive(spark, d):
    s = R.symbols(spark, d).where("kind = 'class'").where(F.col("name").rlike("^(?:Badge|Panel|Anchor|Link)"))
    return s.join(R.edges(spark, d).where("kind IN ('route', 'call')").select(F.col("src").alias("id")), "id", "left_anti").select("id", "name")


@reg(
    """WITH f AS (SELECT t.file AS path, count(DISTINCT s.file) AS fan_in FROM edges e JOIN symbols t ON t.id = e.dst JOIN symbols s ON s.id = e.src WHERE e.kind = 'call' AND s.file <> t.file GROUP BY 1), h AS (SELECT * FROM f ORDER BY fan_in DESC, path LIMIT 10),
      x AS (SELECT path AS file, 1 AS line, 'hotspot' AS label, 'HIGH' AS severity, fan_in, 0 AS q FROM h UNION ALL SELECT path, 1, 'hotspot', 'LOW', fan_in, 1 FROM f WHERE fan_in >= 3 UNION ALL SELECT file, line, 'uncalled', 'LOW', 0, 2 FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id))
      SELECT file, line, label, arg_min(severity, (q, severity, fan_in)) AS severity, arg_min(fan_in, (q, severity, fan_in)) AS fan_in FROM x GROUP BY ALL""",
    "symbols edges",
)
def plan_merge(spark, d):
    s, e = R.symbols(spark, d), R.edges(spark, d)
    f = G.fan_in_files(e.where("kind = 'call'"), s)
    row = lambda df, sev: df.select(F.col("path").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("hotspot").alias("label"), F.lit(sev).alias("severity"), "fan_in")
    dead = s.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("file", "line", F.lit("uncalled").alias("label"), F.lit("LOW").alias("severity"), F.lit(0).cast("long").alias("fan_in"))
    return G.merge_findings(row(f.orderBy(F.desc("fan_in"), "path").limit(10), "HIGH"), row(f.where("fan_in >= 3"), "LOW"), dead)


KW = ["anchor", "batch", "clerk"]


@reg(
    """SELECT id, file FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY exact DESC, id) AS n FROM (SELECT id, file, leaf IN ('anchor', 'batch') AS exact FROM symbols
      WHERE len(list_intersect(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(name, '(\\p{Ll})(\\p{Lu})', '\\1_\\2', 'g'), '([^_\\-.:#])(\\p{Lu}\\p{Ll})', '\\1_\\2', 'g'), '[_\\-.:#]+'), lambda x: lower(x)), ['anchor', 'batch', 'clerk'])) > 0)) WHERE n <= 5""",
    "symbols",
)
def seed_symbols(spark, d):
    from pyspark.sql import Window

    from tracewell.functions.text import split_ident_words

    s = R.symbols(spark, d).where(F.arrays_overlap(split_ident_words(F.col("name")), F.array(*[F.lit(k) for k in KW])))
    w = Window.partitionBy("file").orderBy(F.col("leaf").isin("anchor", "batch").desc(), "id")
    return s.withColumn("n", F.row_number().over(w)).where("n <= 5").select("id", "file")


@reg(
    """WITH c AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'call'), x AS (SELECT s.file, 0 AS k, c.dst AS rank, s.name || ' calls ' || t.name AS reason FROM c JOIN symbols s ON s.id = c.src JOIN symbols t ON t.id = c.dst
      UNION ALL SELECT t.file, 1, c.src, t.name || ' called-by ' || s.name FROM c JOIN symbols s ON s.id = c.src JOIN symbols t ON t.id = c.dst)
      SELECT file AS path, arg_min(reason, (k, rank, reason)) AS reason FROM x GROUP BY file""",
    "symbols edges",
)
def neighbour_files(spark, d):
    s = R.symbols(spark, d)
    return G.neighbor_files(R.edges(spark, d), s, s.select("id", F.col("id").alias("rank")))


@reg(
    """WITH i AS (SELECT DISTINCT s.file AS a, t.file AS b FROM edges e JOIN symbols s ON s.id = e.src JOIN symbols t ON t.id = e.dst WHERE e.kind = 'import'), seed AS (SELECT DISTINCT file FROM symbols)
      SELECT b AS path, 'imported' AS reason FROM i WHERE a IN (SELECT file FROM seed) UNION SELECT a, 'imports' FROM i WHERE b IN (SELECT file FROM seed)""",
    "symbols edges",
)
def import_adjacent(spark, d):
    s = R.symbols(spark, d)
    e = R.edges(spark, d).where("kind = 'import'").join(s.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").select("a", "b").distinct()
    seed = s.select("file").distinct()
    out = e.join(seed.withColumnRenamed("file", "a"), "a", "left_semi").select(F.col("b").alias("path"), F.lit("imported").alias("reason"))
    return out.unionByName(e.join(seed.withColumnRenamed("file", "b"), "b", "left_semi").select(F.col("a").alias("path"), F.lit("imports").alias("reason"))).distinct()


@reg()
def cluster_co_files(spark, d):
    e = cut(_calls(spark, d))
    s = R.symbols(spark, d)
    named = G.label_propagation(e).withColumnRenamed("label", "cluster")
    return G.co_members(named, s, s)


@reg()
def layers_longest_path(spark, d):
    """All call edges, cycles condensed (brute force in the tests)."""
    return G.layers(_calls(spark, d))


@reg(
    """WITH h AS (SELECT id AS hunk, file, line - 3 AS lo, line + 12 AS hi FROM symbols), c AS (SELECT DISTINCT s.id FROM h JOIN symbols s ON s.file = h.file AND h.lo <= s.end_line AND s.line <= h.hi)
      SELECT DISTINCT e.dst AS changed, e.src AS consumer FROM edges e WHERE e.kind = 'call' AND e.dst IN (SELECT id FROM c)""",
    "symbols edges",
)
def changed_consumers(spark, d):
    from tracewell.operators.joins import overlapping

    s = R.symbols(spark, d).select("id", "file", "line", "end_line")
    h = s.select("file", (F.col("line") - 3).alias("lo"), (F.col("line") + 12).alias("hi"))
    c = overlapping(h, s, ["file"], ("lo", "hi"), ("line", "end_line")).select(F.col("id").alias("dst")).distinct()
    return _calls(spark, d).join(c, "dst", "left_semi").select(F.col("dst").alias("changed"), F.col("src").alias("consumer")).distinct()


@reg(f"WITH {IMPACT} SELECT seed, file, min(depth) AS depth FROM im JOIN symbols s USING (id) WHERE regexp_matches(lower(file), '(^|/)(test|tests|__tests__)(/|$)') GROUP BY ALL", "symbols edges calls")
def suggested_tests(spark, d):
    from tracewell.functions.paths import is_test_path

    s = R.symbols(spark, d).where(is_test_path(F.col("file"))).select("id", "file")
    return _impact(spark, d).join(s, "id").groupBy("seed", "file").agg(F.min("depth").alias("depth"))


@reg(
    """SELECT 'secret-path' AS rule, path AS file, 'CRITICAL' AS severity FROM files WHERE contains(lower(path), 'secret') UNION ALL SELECT 'large-file', path, 'LOW' FROM files WHERE stat_len > 3500 UNION ALL SELECT 'uncalled', file, 'MEDIUM' FROM (SELECT DISTINCT file FROM symbols s WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id))""",
    "files symbols edges",
)
def review_gate(spark, d):
    from tracewell.functions.paths import credential_path

    f = R.files(spark, d, "stat_len")
    row = lambda df, rule, sev, c="path": df.select(F.lit(rule).alias("rule"), F.col(c).alias("file"), F.lit(sev).alias("severity"))
    un = R.symbols(spark, d).where("kind = 'function'").join(R.edges(spark, d).select(F.col("dst").alias("id")), "id", "left_anti").select("file").distinct()
    return row(f.where(credential_path(F.col("path"))), "secret-path", "CRITICAL").unionByName(row(f.where("stat_len > 3500"), "large-file", "LOW")).unionByName(row(un, "uncalled", "MEDIUM", "file"))


@reg(
    """WITH one AS (SELECT dst FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), s AS (SELECT * FROM symbols WHERE id = (SELECT dst FROM one))
      SELECT file, line, 'definition' AS role, leaf AS old, 'renamed' AS new FROM s UNION SELECT t.file, e.line, e.kind, s.leaf, 'renamed' FROM edges e JOIN symbols t ON t.id = e.src JOIN s ON s.id = e.dst""",
    "symbols edges",
)
def rename_sites(spark, d):
    e = R.edges(spark, d)
    ident = e.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"]
    return G.rename_plan(R.symbols(spark, d), e, ident, "renamed")


@reg("SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber IN (2, 4)")
def edge_multiset_diff(spark, d):
    l = table(spark, d, "lineitem")
    return l.where("l_linenumber <= 3").select("l_suppkey", "l_partkey").exceptAll(l.where("l_linenumber IN (2, 4)").select("l_suppkey", "l_partkey"))


@reg("SELECT DISTINCT path FROM file_scan WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM files)", "files")
def paths_out_of_scope(spark, d):
    return table(spark, d, "file_scan").where("path IS NOT NULL").select("path").distinct().join(R.files(spark, d, "id").select("path"), "path", "left_anti")


@reg(
    """WITH n AS (SELECT path, arg_max(lower(hash), (seen_at, scan_id)) AS h, max(seen_at) AS t FROM (SELECT path, coalesce(hash, '') AS hash, seen_at, scan_id FROM file_scan) GROUP BY path)
      SELECT coalesce(n.path, f.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM n FULL JOIN files f ON f.path = n.path WHERE n.h IS DISTINCT FROM lower(f.hash)""",
    "files",
)
def delta_full_outer(spark, d):
    n = table(spark, d, "file_scan").groupBy("path").agg(F.max(F.struct("seen_at", "scan_id", F.lower(F.coalesce("hash", F.lit(""))).alias("h"))).alias("m")).select("path", F.col("m.h").alias("hash"))
    return G.tree_delta(n, R.files(spark, d, "hash").select("path", F.lower("hash").alias("hash")), "path", "hash")


@reg()
def freshness_signature(spark, d):
    sig = G.signature(R.files(spark, d, "hash"), "path", "hash")
    return spark.createDataFrame([(sig,)], "signature string")
