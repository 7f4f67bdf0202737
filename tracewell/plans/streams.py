"""Streams, sources and extraction (STR, SRC) over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import tasks
from tracewell.operators import activity as A
from tracewell.operators.changes import epoch_us
from tracewell.plans.registry import Registry
from tracewell.session import cut, scratch_folder, table
from tracewell.sources import extract as E
from tracewell.sources import relations as R
from tracewell.streaming import events as S

reg = Registry(R.CTES)
QUERIES, ORACLES = reg.queries, reg.oracles


TICKS = 4
_ARRIVED: dict[tuple[str, str], str] = {}


def _stream(spark, d):
    """The events as a stream of ``TICKS`` files in order of arrival, one a tick, so state,
    cursors and watermarks carry over from one to the next."""
    at = (spark.sparkContext.applicationId, d)
    e = table(spark, d, "events")
    if at not in _ARRIVED:
        _ARRIVED[at] = scratch_folder(spark)
        lo, hi = e.agg(F.min("event_id"), F.max("event_id")).first()
        for k in range(TICKS):
            tick = F.floor((F.col("event_id") - lo) * TICKS / max(1, (hi or 0) - (lo or 0) + 1)) == k
            e.where(tick).coalesce(1).write.mode("append").parquet(_ARRIVED[at])
    return S.source(spark, _ARRIVED[at], e.schema)


def _drain(spark, df, apply=None, mode="append"):
    """Run a stream over what is there and read back what it wrote."""
    out = scratch_folder(spark)
    write = apply or (lambda b, n: b.write.mode("append").parquet(f"{out}/data"))
    S.run_available(df, f"{out}/checkpoint", write, mode)
    return out


@reg("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error'")
def stream_errors(spark, d):
    out = _drain(spark, _stream(spark, d).where("event_type = 'error'").select("event_id", "user_id", "event_type"))
    return spark.read.parquet(f"{out}/data")


@reg("SELECT user_id || ':' || event_type AS identity, count(*) AS count, min(epoch_us(ts) // 1000) AS first_ts, max(epoch_us(ts) // 1000) AS last_ts FROM events GROUP BY 1")
def stream_dedup_state(spark, d):
    e = _stream(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("identity"), F.floor(epoch_us(F.col("ts")) / 1000).alias("ms"))
    out = _drain(spark, S.dedup_state(e, "identity", "ms"), mode="update")
    states = spark.read.parquet(f"{out}/data")
    return states.groupBy("identity").agg(F.max("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


LATEST = "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id"


def _merged(spark, out):
    last = spark.read.parquet(f"{out}/data").groupBy("user_id").agg(F.max(F.struct("at", "event_type")).alias("m"))
    return last.select("user_id", F.col("m.at.ts").alias("ts"), F.col("m.event_type").alias("event_type"))


@reg(LATEST)
def stream_debounced(spark, d):
    """The last change per path of each tick, merged over ticks."""
    out = f"{scratch_folder(spark)}"

    def apply(batch, n):
        S.latest_per_path(batch.select("user_id", F.struct("ts", "event_id").alias("at"), "event_type"), "user_id", "at")[0].write.mode("append").parquet(f"{out}/data")

    S.run_available(_stream(spark, d), f"{out}/checkpoint", apply)
    return _merged(spark, out)


@reg(LATEST)
def stream_overflowed(spark, d):
    """The same where every tick overflows: what was pending gives way to a rescan."""
    out = f"{scratch_folder(spark)}"
    pick = lambda df: df.select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")

    def apply(batch, n):
        S.reconciled(pick(batch), "user_id", "at", lambda: pick(table(spark, d, "events")), cap=5)[0].write.mode("overwrite").parquet(f"{out}/data")

    S.run_available(_stream(spark, d), f"{out}/checkpoint", apply)
    return _merged(spark, out)


@reg("SELECT count(*) AS events, max(event_id) AS cursor FROM events WHERE event_id > 2000")
def stream_cursor(spark, d):
    """Events after a cursor, tick by tick, with the cursor carried on."""
    out = f"{scratch_folder(spark)}"
    cursor = S.Cursor(spark, f"{out}/cursor", 2000)

    def apply(batch, n):
        page = cut(cursor.page(batch.select("event_id"), "event_id"))
        page.write.mode("append").parquet(f"{out}/data")
        cursor.advance(page.agg(F.max("event_id")).first()[0])

    S.run_available(_stream(spark, d), f"{out}/checkpoint", apply)
    return spark.read.parquet(f"{out}/data").agg(F.count("*").alias("events"), F.max("event_id").alias("cursor"))


@reg("SELECT user_id, count(*) AS windows, sum(n) AS n FROM (SELECT user_id, w, count(*) AS n FROM (SELECT user_id, unnest([epoch_us(ts) // 1800000000, epoch_us(ts) // 1800000000 - 1]) AS w FROM events) GROUP BY ALL) GROUP BY user_id", whole="n")
def windowed_activity(spark, d):
    """Sliding-window counts as ticks update them; the last count of a window stands."""
    w = S.windowed_activity(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    out = _drain(spark, w, mode="update")
    w = spark.read.parquet(f"{out}/data").groupBy("window", "user_id").agg(F.max("n").alias("n"))
    return w.groupBy("user_id").agg(F.count("*").alias("windows"), F.sum("n").alias("n"))


@reg(
    "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS s FROM events) WHERE s = 1 GROUP BY user_id"
)
def activity_sessions(spark, d):
    s = S.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@reg("SELECT a.event_id AS error_id, b.event_id FROM events a JOIN events b ON b.event_type <> 'error' AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 30000000 AND epoch_us(a.ts) + 30000000 WHERE a.event_type = 'error'")
def correlated_stream(spark, d):
    """The interval join of two streams: pairs meet across ticks, watermarks bound the state."""
    e = lambda: _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    a = e().where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    b = e().where("event_type <> 'error'").select("event_id", F.col("ts").alias("event_ts"))
    out = _drain(spark, S.correlated(a, b, "error_ts", "event_ts").select("error_id", "event_id"))
    return spark.read.parquet(f"{out}/data")


@reg("SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL")
def first_sightings(spark, d):
    e = table(spark, d, "events")
    return A.first_record(e.select(F.struct("user_id", "event_type").alias("k"), "ts", "event_id"), "k", ["ts", "event_id"]).select("k.user_id", "k.event_type", "ts")


@reg("SELECT agent, max(ts) AS last_ingest_at FROM turns GROUP BY agent", "turns")
def resume_points(spark, d):
    return S.resume_point(R.turns(spark, d, timed=True), "agent", "ts")


@reg(
    """WITH n AS (SELECT path AS unit, arg_max(stat_len, (seen_at, scan_id)) AS size, arg_max(stat_mtime, (seen_at, scan_id)) AS mtime, arg_max(hash, (seen_at, scan_id)) AS prefix FROM file_scan WHERE stat_len IS NOT NULL AND stat_mtime IS NOT NULL AND hash IS NOT NULL GROUP BY path)
      SELECT unit, CASE WHEN f.path IS NULL OR f.stat_len IS NULL THEN 'new' WHEN size = f.stat_len AND mtime = f.stat_mtime THEN 'unchanged' WHEN size > f.stat_len AND prefix IS NOT DISTINCT FROM f.hash THEN 'appended' ELSE 'rewritten' END AS change FROM n LEFT JOIN files f ON f.path = n.unit""",
    "files",
)
def ingest_changes(spark, d):
    from tracewell.session import standing
    from tracewell.sources.transcripts import classify_units

    scan = table(spark, d, "file_scan").where("stat_len IS NOT NULL AND stat_mtime IS NOT NULL AND hash IS NOT NULL")
    now = scan.groupBy(F.col("path").alias("unit")).agg(F.max(F.struct("seen_at", "scan_id", "stat_len", "stat_mtime", "hash")).alias("m")).select("unit", F.col("m.stat_len").alias("size"), F.col("m.stat_mtime").alias("mtime"), F.col("m.hash").alias("prefix"))
    f = standing(table(spark, d, "index_files").select("path", "indexed_at", "id", "stat_len", "stat_mtime", "hash"), "path", ["indexed_at", "id"])
    state = f.select(F.col("path").alias("unit"), F.col("stat_len").alias("size"), F.when(F.col("stat_mtime").isNotNull(), F.col("stat_mtime")).otherwise(F.lit(-1)).alias("mtime"), F.col("stat_len").alias("bytes"), F.col("hash").alias("prefix"))
    return classify_units(now, state).select("unit", "change")


@reg("SELECT path FROM files WHERE stat_mtime // 1000000 >= 1780000000000 - 8640000000", "files")
def recent_units(spark, d):
    from tracewell.session import standing
    from tracewell.sources.transcripts import recent

    f = standing(table(spark, d, "index_files").select("path", "indexed_at", "id", "stat_mtime"), "path", ["indexed_at", "id"])
    return recent(f.select("path", F.floor(F.col("stat_mtime") / 1_000_000).alias("mtime")), 1_780_000_000_000, 8_640_000_000).select("path")


@reg()
def extracted_symbols(spark, d):
    """Symbols read from the file heads (golden cases in the tests)."""
    s = E.extract_symbols(R.files(spark, d, "id", "head"), "path", "head")
    return s.groupBy("kind").agg(F.count("*").alias("symbols"), F.sum(F.size("calls")).alias("calls"))


@reg()
def extracted_concepts(spark, d):
    c = E.extract_concepts(R.files(spark, d, "id", "head"), "path", "head")
    return c.groupBy("kind").agg(F.count("*").alias("concepts"), F.count_distinct("norm").alias("distinct"))


@reg()
def extracted_relations(spark, d):
    """Calls, imports, mixins, references and components of the file heads (golden cases in the tests)."""
    r = E.extract_relations(R.files(spark, d, "id", "head"), "path", "head")
    return r.groupBy("kind").agg(F.count("*").alias("relations"), F.count_distinct("target").alias("targets"), F.count("owner").alias("owned"))


@reg()
def concept_owners(spark, d):
    """Concepts of the file heads with the symbol around them (golden cases in the tests)."""
    f = R.files(spark, d, "id", "head").select("path", F.col("head").alias("text"))
    owned = E.own_concepts(E.extract_concepts(f), E.extract_symbols(f), f)
    return owned.groupBy("kind").agg(F.count("*").alias("concepts"), F.count("owner").alias("owned"))


@reg()
def code_chunk_sizes(spark, d):
    """Symbol-aligned chunks of the file heads (coverage checked in the tests)."""
    import pandas as pd

    def run(batches):
        for p in batches:
            rows = [(f, i, a, b, n) for f, t in zip(p["path"], p["head"]) for i, (a, b, n) in enumerate(E.code_chunks(f, t or ""))]
            yield pd.DataFrame(rows, columns=["path", "n", "start", "end", "symbol"])

    return R.files(spark, d, "id", "head").select("path", "head").mapInPandas(run, "path string, n int, start int, end int, symbol string")


@reg("SELECT title, n FROM (SELECT trim(title) AS title, count(*) AS n FROM oc_session WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1) WHERE n >= 2")
def repeated_titles(spark, d):
    return table(spark, d, "oc_session").where("title IS NOT NULL").groupBy(F.trim("title").alias("title")).agg(F.count("*").alias("n")).where("n >= 2 AND title <> ''")


@reg()
def task_relevance(spark, d):
    """Files relevant to a task: keywords weighed by their document frequency, structure
    and weight quotas (brute force in the tests)."""
    from tracewell.operators import rank as K

    task = tasks.read_task("Fix the stale session cursor in the ledger adapter")
    f = R.files(spark, d, "id", "head")
    names = cut(K.filename_scores(f, "path", task.keywords))
    body = cut(K.bm25(f, "path", "head", task.keywords))
    strong = names.orderBy(F.desc("score"), "path").limit(4).select("path", F.lit("structure").alias("why"), F.round("score", 6).alias("score"))
    rest = body.join(strong.select("path"), "path", "left_anti").orderBy(F.desc("score"), "path").limit(8).select("path", F.lit("content").alias("why"), F.round("score", 6).alias("score"))
    return strong.unionByName(rest)


BUDGET = 1200


@reg(
    f"""WITH c AS (SELECT * FROM edges WHERE kind = 'call'), t AS (SELECT dst FROM c GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
      near AS (SELECT dst AS id, 0 AS side FROM t UNION SELECT c.src, 1 FROM c JOIN t USING (dst) UNION SELECT c.dst, 2 FROM c JOIN t ON c.src = t.dst),
      one AS (SELECT id, min(side) AS side FROM near GROUP BY id),
      item AS (SELECT o.id, o.side, strlen(s.name) AS l0, strlen(s.name) + strlen(coalesce(s.signature, '')) AS l1, strlen(array_to_string(string_split(f.head, chr(10))[s.line:s.end_line], chr(10))) AS body
        FROM one o JOIN symbols s USING (id) LEFT JOIN files f ON f.path = s.file),
      step AS (SELECT id, side, 0 AS k, l0 AS grow FROM item UNION ALL SELECT id, side, 1, l1 - l0 FROM item UNION ALL SELECT id, side, 2, coalesce(body, 0) FROM item),
      used AS (SELECT *, ceil(sum(grow) OVER (ORDER BY k, side, id) / 4.0) AS u FROM step), ok AS (SELECT *, max(u) OVER (ORDER BY k, side, id) <= {tasks.split_budget(BUDGET, 1)[0]} AS fits FROM used)
      SELECT id, coalesce(max(k) FILTER (fits), -1)::INT AS level FROM ok GROUP BY id HAVING level >= 0""",
    "files symbols edges",
)
def packed_context(spark, d):
    """The most called symbol, its callers and its callees as names, signatures and
    bodies, as far as a token budget goes; symbols it has no room for are left out."""
    from tracewell.operators import rank as K

    e = cut(R.edges(spark, d).where("kind = 'call'"))
    target = e.groupBy("dst").count().orderBy(F.desc("count"), "dst").first()["dst"]
    near = e.where(F.col("dst") == target).select(F.col("src").alias("id"), F.lit(1).alias("side")).union(e.where(F.col("src") == target).select("dst", F.lit(2))).distinct()
    budget = tasks.split_budget(BUDGET, 1)[0]
    every = spark.range(target, target + 1).select("id", F.lit(0).alias("side")).union(near).groupBy("id").agg(F.min("side").alias("side"))
    # a name takes a byte at least, so nothing past four times the budget has room
    items = every.orderBy("side", "id").limit(4 * budget + 1)
    s = R.symbols(spark, d).select("id", "file", "name", "signature", "line", "end_line")
    f = R.files(spark, d, "head").select(F.col("path").alias("file"), "head")
    lines = F.slice(F.split("head", "\n"), F.col("line").cast("int"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0)).cast("int"))
    sized = items.join(s, "id").join(f, "file", "left").select(
        F.lit(0).alias("g"), F.struct("side", "id").alias("n"), F.octet_length("name").alias("l0"),
        (F.octet_length("name") + F.octet_length(F.coalesce("signature", F.lit("")))).alias("l1"), F.coalesce(F.octet_length(F.array_join(lines, "\n")), F.lit(0)).alias("body"),
    )
    fitted = K.fit_budget(sized.withColumn("l2", F.col("l1") + F.col("body")), "g", "n", budget, ["l0", "l1", "l2"])
    return fitted.where("level >= 0").select("n.id", "level")
