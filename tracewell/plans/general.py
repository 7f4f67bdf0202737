"""Queries of the general data problems over the transcript and generation stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import changes, hierarchy, orphans, timeline
from tracewell.session import blank_to_null, cut, scratch_folder, standing, table
from tracewell.sources.times_sql import moments
from tracewell.streaming.feed import ChangeFeed, DeltaSink


def hit_times(spark: SparkSession, d: str, costs: timeline.Costs = timeline.Costs()) -> DataFrame:
    """search_hits with ``utc_ms``; repeated rows stay and read alike."""
    hits = table(spark, d, "search_hits").select("turn_id", "session_id", "seq", "agent", "ts", "ts_source")
    return timeline.read_times(hits, "ts", "agent", "session_id", ["seq", "turn_id"], timeline.clocks(table(spark, d, "agent_clocks")), costs)


def message_times(spark: SparkSession, d: str, costs: timeline.Costs = timeline.Costs()) -> DataFrame:
    """oc_message with its session's agent and ``utc_ms``; repeated rows stay and read alike."""
    return time_messages(spark, d, table(spark, d, "oc_message").select("id", "session_id", "time_created"), costs)


def time_messages(spark: SparkSession, d: str, messages: DataFrame, costs: timeline.Costs = timeline.Costs()) -> DataFrame:
    sessions = standing(table(spark, d, "oc_session"), "id", ["time_updated"]).select(F.col("id").alias("session_id"), "agent")
    known = messages.join(sessions, "session_id", "left")
    return timeline.read_times(known, "time_created", "agent", "session_id", ["id"], timeline.clocks(table(spark, d, "agent_clocks")), costs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    def part(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
        return df.where(F.col("utc_ms").isNotNull() & ~F.col(text).rlike(r"\A[0-9]{13}\z")).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), "utc_ms"
        )

    hits = part(hit_times(spark, d), "search_hits", "turn_id", "ts")
    messages = part(message_times(spark, d), "oc_message", "id", "time_created")
    return hits.unionByName(messages).dropDuplicates()


def p1_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """Slash dates of search_hits read without the declared date order: the path over each
    session's records decides.  ``utc_ms`` by the path, ``declared_ms`` by the clock."""
    hits = table(spark, d, "search_hits").select("turn_id", "session_id", "seq", "agent", "ts").dropDuplicates(["turn_id"])
    clock_rows = timeline.clocks(table(spark, d, "agent_clocks"))
    free = timeline.read_times(hits, "ts", "agent", "session_id", ["seq", "turn_id"], clock_rows.withColumn("date_order", F.lit("dmy")), timeline.Costs(off_rule=0.0, strict=False))
    true = timeline.read_times(hits, "ts", "agent", "session_id", ["seq", "turn_id"], clock_rows).select("turn_id", F.col("utc_ms").alias("declared_ms"))
    slash = free.where(F.col("utc_ms_format").startswith("slash"))
    return slash.join(true, "turn_id").select("turn_id", "utc_ms", "declared_ms")


def session_tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    nodes = standing(table(spark, d, "oc_session").select("id", "parent_id", "time_updated"), "id", ["time_updated"])
    return hierarchy.hierarchy(nodes, "id", "parent_id", paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = cut(standing(table(spark, d, "oc_session").select("id", "parent_id", "time_updated"), "id", ["time_updated"]))
    tree = hierarchy.hierarchy(nodes, "id", "parent_id", paths=False)
    # a child of a missing parent is a root of depth 0, yet has a parent_id
    linked = nodes.where("parent_id <> ''").select("id")
    return tree.join(linked, "id", "left_semi").select("id", "root_id", "depth")


def _whole_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The session tree and all its ancestor pairs, those through circles included."""
    nodes = cut(standing(table(spark, d, "oc_session").select("id", "parent_id", "time_updated"), "id", ["time_updated"]))
    tree = cut(hierarchy.hierarchy(nodes, "id", "parent_id"))
    return tree, hierarchy.descendants(tree).unionByName(hierarchy.caught_descendants(tree, nodes, "id", "parent_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each session with its path, depth, root and number of descendants, those through circles included."""
    tree, pairs = _whole_tree(spark, d)
    below = pairs.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("n_descendants"))
    return tree.join(below, "id", "left").select(
        "id", "root_id", "depth", F.concat_ws("/", "path").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants")
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every ancestor pair, those of sessions caught in circles included."""
    return _whole_tree(spark, d)[1]


LOG_PARTITIONS = 32


def scan_log(spark: SparkSession, d: str) -> DataFrame:
    """file_scan as an append log: part, offset (landing time, scan id), path, version, value."""
    rows = table(spark, d, "file_scan").select("scan_id", "path", "hash", "seen_at", "landed_at").where("path IS NOT NULL AND landed_at IS NOT NULL")
    return rows.select(
        changes.log_partition(["path", "scan_id"], LOG_PARTITIONS).alias("part"),
        "landed_at",
        "scan_id",
        F.struct("landed_at", "scan_id").alias("offset"),
        "path",
        F.struct(changes.epoch_us(F.col("seen_at")).alias("seen"), F.lit(1).alias("scan"), F.col("scan_id")).alias("version"),
        F.lower("hash").alias("value"),
    )


def scan_runs(spark: SparkSession, d: str) -> list[tuple]:
    """``(run_id, started_at, status)`` in order of their start; the runs are configuration."""
    runs = table(spark, d, "index_runs").where("started_at IS NOT NULL").select("run_id", "started_at", "status").dropDuplicates(["run_id"]).collect()
    return sorted((tuple(r) for r in runs), key=lambda r: (r[1], r[0]))


def run_plan(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
    return changes.batch_plan(log, [(i, at, status == "ok") for i, at, status in scan_runs(spark, d)], "part", "offset", "landed_at", LOG_PARTITIONS)


class RunLost(Exception):
    """A run of the tables' past that did not reach its commit."""


def replay_runs(spark: SparkSession, d: str, root: str) -> tuple[ChangeFeed, DeltaSink]:
    """The runs of index_runs, one after the other, through the feed into the sink at ``root``.

    A failed run is lost after the sink took its batch, any other that is not ok
    before; either way its plan stays open and the next run replays it.
    """
    log = scan_log(spark, d)
    feed = ChangeFeed(spark, f"{root}/feed", "part", ("landed_at", "scan_id"))
    sink = DeltaSink(spark, f"{root}/sink", "path", ["version"])
    ends: dict[int, dict] = {}
    for r in run_plan(spark, d, log).where("to_offset IS NOT NULL").select("run_id", "part", "to_offset").collect():  # runs x partitions
        ends.setdefault(r["run_id"], {})[str(r["part"])] = [str(v) for v in r["to_offset"]]
    for run_id, _, status in scan_runs(spark, d):

        def apply(batch: DataFrame, number: int) -> None:
            if status not in ("ok", "failed"):
                raise RunLost(run_id)
            sink.append(batch.select("path", "version", "value"), number)
            if status == "failed":
                raise RunLost(run_id)

        try:
            feed.run(log, apply, str(run_id), ends.get(run_id, {}))
        except RunLost:
            pass
    return feed, sink


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    feed, sink = replay_runs(spark, d, scratch_folder(spark))
    files = standing(table(spark, d, "index_files").select("path", "hash", "indexed_at"), "path", ["indexed_at"])
    base = files.select(
        "path",
        F.struct((F.col("indexed_at") * 1_000_000).alias("seen"), F.lit(0).alias("scan"), F.lit(None).cast("long").alias("scan_id")).alias("version"),
        F.lower("hash").alias("value"),
    )
    order = {str(r[0]): k for k, r in enumerate(scan_runs(spark, d), 1)}
    done = feed.commits()
    deltas = sink.deltas([c["batch"] for c in done])
    if deltas is None:
        return spark.createDataFrame([], "run_id int, path string")
    of = spark.createDataFrame([(c["batch"], int(c["label"]), order[c["label"]]) for c in done], "batch int, run_id int, seq int")  # a row per batch
    return changes.changed(deltas.join(F.broadcast(of), "batch").drop("batch"), base, "path", "version", "value")


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    """Records each run has to read, those of lost runs before it included."""
    plan = run_plan(spark, d, scan_log(spark, d))
    return plan.groupBy("run_id", "committed").agg(F.sum("records").alias("records"))


def _month(at: str) -> Column:
    """The UTC month of epoch seconds, whatever the session's zone."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(at) / 86_400).cast("int")), "yyyy-MM")


def symbol_refs(spark: SparkSession, d: str) -> DataFrame:
    """Every reference with the key it needs: ``u:`` a uid, ``l:`` a leaf."""
    edges = table(spark, d, "index_edges").select("id", "dst", "resolved", "target", "indexed_at")
    dst = F.regexp_replace(blank_to_null("dst"), r"^\./", "")
    edge_key = F.when(dst.isNotNull(), F.concat(F.lit("u:"), dst)).when(
        F.col("resolved") == 1, F.concat(F.lit("l:"), orphans.leaf(F.regexp_replace("target", r"^\s+|\s+$", "")))
    )
    names = table(spark, d, "ruby_hybrid_unresolved").where("op = 'added'")
    period = _month("indexed_at").alias("period")
    return (
        edges.select(F.lit("index_edges").alias("table_name"), F.col("id").alias("ref_id"), period, edge_key.alias("key"))
        .unionByName(
            names.select(
                F.lit("ruby_hybrid_unresolved").alias("table_name"),
                F.col("id").alias("ref_id"),
                period,
                F.concat(F.lit("l:"), orphans.leaf(blank_to_null("name"))).alias("key"),
            )
        )
        .where("key IS NOT NULL")
        .dropDuplicates()
    )


def symbol_events(spark: SparkSession, d: str) -> DataFrame:
    """``key, period, delta`` of every parent row: +1 in the month it is indexed, -1 in
    the month it is dropped if that is a later one (else it never was there); symbols
    of the standard libraries are there from the start (null period)."""
    rows = table(spark, d, "index_symbols").select("uid", "name", "id", _month("indexed_at").alias("came"), _month("dropped_at").alias("went")).distinct()
    core = table(spark, d, "core_symbols").select("uid", "name", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("came"), F.lit(None).cast("string").alias("went")).distinct()
    there = rows.unionByName(core).where("went IS NULL OR came < went")
    keys = F.array(F.concat(F.lit("u:"), "uid"), F.concat(F.lit("l:"), orphans.leaf(F.col("name"))))
    moves = F.array(F.struct(F.col("came").alias("period"), F.lit(1).alias("delta")), F.struct(F.col("went").alias("period"), F.lit(-1).alias("delta")))
    moves = F.filter(moves, lambda m: (m["delta"] > 0) | m["period"].isNotNull())
    return there.select(F.explode(keys).alias("key"), moves.alias("moves")).where("key IS NOT NULL").select("key", F.inline("moves"))


BATCH_MONTHS = 12  # months a batch of the orphan replay brings; every month is a step of its own


def orphan_replay(spark: SparkSession, d: str) -> orphans.OrphanReplay:
    """References, arrivals and drops replayed month by month, a year a batch."""
    refs, events = symbol_refs(spark, d), symbol_events(spark, d).withColumnRenamed("period", "step")
    replay = orphans.OrphanReplay(refs.withColumn("step", F.col("period")), events, ["table_name", "ref_id", "period"])
    months = replay.steps()
    return replay.run([months[i : i + BATCH_MONTHS] for i in range(0, len(months), BATCH_MONTHS)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_replay(spark, d).pending()


def p5_orphans_per_period(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("table_name", "period").agg(F.count("*").alias("orphans"))


def p5_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Waiting references per table and month of the reference, as of the end of each month."""
    return orphan_replay(spark, d).snapshots("table_name", "period").where(F.col("step") != orphans.FIRST).withColumnRenamed("step", "as_of")


QUERIES = {
    "p1_found": p1_found,
    "p1_undeclared": p1_undeclared,
    "p2_found": p2_found,
    "p2_hierarchy": p2_hierarchy,
    "p2_descendants": p2_descendants,
    "p3_found": p3_found,
    "p3_plan": p3_plan,
    "p5_found": p5_found,
    "p5_orphans_per_period": p5_orphans_per_period,
    "p5_snapshots": p5_snapshots,
}

_STANDING = """
  st AS (SELECT id, nullif(parent_id, '') AS parent_id FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY time_updated DESC, parent_id DESC) AS rn FROM oc_session WHERE id IS NOT NULL) WHERE rn = 1),
  walk(id, cur, depth, seen) AS (
    SELECT id, id, 0, [id] FROM st
    UNION ALL
    SELECT w.id, p.id, w.depth + 1, list_append(w.seen, p.id) FROM walk w JOIN st s ON s.id = w.cur JOIN st p ON p.id = s.parent_id
    WHERE NOT list_contains(w.seen, p.id)),
  last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth DESC) AS rn FROM walk) WHERE rn = 1),
  tree AS (
    SELECT l.id, l.cur, l.depth, l.seen, s.parent_id AS up, p.id IS NOT NULL AS caught
    FROM last l JOIN st s ON s.id = l.cur LEFT JOIN st p ON p.id = s.parent_id),
  named AS (
    SELECT id, CASE WHEN caught THEN list_min(seen[list_position(seen, up):]) ELSE cur END AS root_id,
      CASE WHEN caught THEN -1 ELSE depth END AS depth, CASE WHEN caught THEN '' ELSE array_to_string(list_reverse(seen), '/') END AS path, seen, caught
    FROM tree)
"""
_STATES = """
  r AS (SELECT DISTINCT run_id, started_at FROM index_runs WHERE status = 'ok'),
  f AS (SELECT path, lower(hash) AS hash, indexed_at FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) AS rn FROM index_files) WHERE rn = 1),
  v AS (
    SELECT path, lower(hash) AS hash, seen_at AS seen, 1 AS scan, scan_id, landed_at FROM file_scan
    UNION ALL SELECT path, hash, make_timestamp(indexed_at * 1000000), 0, -1, NULL FROM f),
  s AS (
    SELECT run_id, started_at, path, hash FROM (
      SELECT r.run_id, r.started_at, v.*, row_number() OVER (PARTITION BY r.run_id, path ORDER BY seen DESC, scan DESC, scan_id DESC) AS rn
      FROM r JOIN v ON v.landed_at IS NULL OR v.landed_at <= r.started_at) WHERE rn = 1
    UNION ALL SELECT 0, TIMESTAMP '1970-01-01', path, hash FROM f),
  g AS (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY started_at) AS was FROM s)
"""
_REFS = """
  a AS (SELECT uid, name FROM index_symbols WHERE dropped_at IS NULL UNION ALL SELECT uid, name FROM core_symbols),
  u AS (SELECT DISTINCT uid FROM a),
  l AS (SELECT DISTINCT regexp_replace(name, '^.*(::|#|[.])', '') AS leaf FROM a),
  e AS (SELECT DISTINCT id, nullif(regexp_replace(trim(coalesce(dst, ''), ' ' || chr(9) || chr(10) || chr(13)), '^[.]/', ''), '') AS dst, resolved, target, indexed_at FROM index_edges),
  o AS (
    SELECT 'index_edges' AS table_name, id AS ref_id, indexed_at FROM e
    WHERE (dst IS NOT NULL AND dst NOT IN (SELECT uid FROM u))
       OR (dst IS NULL AND resolved = 1 AND regexp_replace(trim(target), '^.*(::|#|[.])', '') NOT IN (SELECT leaf FROM l))
    UNION ALL
    SELECT DISTINCT 'ruby_hybrid_unresolved', id, indexed_at FROM ruby_hybrid_unresolved
    WHERE op = 'added' AND regexp_replace(trim(name, ' ' || chr(9) || chr(10) || chr(13)), '^.*(::|#|[.])', '') NOT IN (SELECT leaf FROM l)),
  p AS (SELECT table_name, ref_id, strftime(make_timestamp(indexed_at * 1000000), '%Y-%m') AS period FROM o)
"""
_HISTORY = """
  s AS (SELECT DISTINCT uid, name, id, strftime(make_timestamp(indexed_at * 1000000), '%Y-%m') AS came, strftime(make_timestamp(dropped_at * 1000000), '%Y-%m') AS went FROM index_symbols
    UNION ALL SELECT DISTINCT uid, name, NULL, '', NULL FROM core_symbols),
  k AS (SELECT DISTINCT unnest(['u:' || uid, 'l:' || regexp_replace(name, '^.*(::|#|[.])', '')]) AS key, came, went FROM s WHERE went IS NULL OR came < went),
  e AS (SELECT DISTINCT id, nullif(regexp_replace(trim(coalesce(dst, ''), ' ' || chr(9) || chr(10) || chr(13)), '^[.]/', ''), '') AS dst, resolved, target, indexed_at FROM index_edges),
  r AS (
    SELECT 'index_edges' AS table_name, id, indexed_at, CASE WHEN dst IS NOT NULL THEN 'u:' || dst WHEN resolved = 1 THEN 'l:' || regexp_replace(trim(target), '^.*(::|#|[.])', '') END AS key FROM e
    UNION ALL
    SELECT DISTINCT 'ruby_hybrid_unresolved', id, indexed_at, 'l:' || regexp_replace(nullif(trim(name, ' ' || chr(9) || chr(10) || chr(13)), ''), '^.*(::|#|[.])', '') FROM ruby_hybrid_unresolved WHERE op = 'added'),
  q AS (SELECT DISTINCT table_name, id, strftime(make_timestamp(indexed_at * 1000000), '%Y-%m') AS period, key FROM r WHERE key IS NOT NULL),
  months AS (SELECT DISTINCT m FROM (SELECT period AS m FROM q UNION SELECT came FROM k UNION SELECT went FROM k) WHERE m > ''),
  alive AS (SELECT DISTINCT m, key FROM months JOIN k ON came <= m AND (went IS NULL OR went > m))
"""
#: every moment of search_hits (hm) and oc_message (mm)
TIMES = f"""hr AS (SELECT turn_id AS key, agent, ts AS t FROM search_hits), {moments("hr", "hm")},
  sa AS (SELECT id, arg_max(agent, (time_updated, parent_id)) AS agent FROM oc_session GROUP BY id),
  mr AS (SELECT m.id AS key, sa.agent, m.time_created AS t FROM oc_message m LEFT JOIN sa ON sa.id = m.session_id), {moments("mr", "mm")}"""
ORACLES = {
    "p1_found": f"""WITH {TIMES} SELECT DISTINCT 'search_hits' AS table_name, turn_id::VARCHAR AS row_key, ms AS utc_ms FROM search_hits JOIN hm ON key = turn_id WHERE NOT regexp_full_match(ts, '[0-9]{{13}}')
      UNION ALL SELECT DISTINCT 'oc_message', id, ms FROM oc_message JOIN mm ON key = id WHERE NOT regexp_full_match(time_created, '[0-9]{{13}}')""",
    "p2_found": f"WITH RECURSIVE {_STANDING} SELECT n.id, n.root_id, n.depth FROM named n JOIN st USING (id) WHERE st.parent_id IS NOT NULL",
    "p2_hierarchy": f"""WITH RECURSIVE {_STANDING}, below AS (
      SELECT a AS id, count(*) AS n FROM (SELECT unnest(seen[2:]) AS a FROM named) GROUP BY a)
      SELECT n.id, n.root_id, n.depth, n.path, coalesce(b.n, 0) AS n_descendants FROM named n LEFT JOIN below b USING (id)""",
    "p2_descendants": f"""WITH RECURSIVE {_STANDING} SELECT seen[i] AS ancestor, id AS descendant, i - 1 AS distance
      FROM (SELECT id, seen, unnest(range(2, len(seen) + 1)) AS i FROM named)""",
    "p3_found": f"WITH {_STATES} SELECT run_id, path FROM g WHERE run_id > 0 AND hash IS NOT NULL AND hash IS DISTINCT FROM was",
    "p3_plan": """WITH r AS (SELECT DISTINCT run_id, started_at, coalesce(status = 'ok', false) AS committed FROM index_runs),
      n AS (SELECT r.*, (SELECT count(*) FROM file_scan f WHERE f.path IS NOT NULL AND f.landed_at <= r.started_at) AS total FROM r)
      SELECT run_id, committed, total - coalesce((SELECT max(b.total) FROM n b WHERE b.committed AND b.started_at < n.started_at), 0) AS records FROM n""",
    "p5_found": f"WITH {_REFS} SELECT table_name, ref_id, period FROM p",
    "p5_orphans_per_period": f"WITH {_REFS} SELECT table_name, period, count(*) AS orphans FROM p GROUP BY ALL",
    "p5_snapshots": f"WITH {_HISTORY} SELECT m AS as_of, table_name, period, count(*) AS orphans FROM months JOIN q ON period <= m ANTI JOIN alive USING (m, key) GROUP BY ALL",
}
