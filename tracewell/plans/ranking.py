"""Aggregations and ranking (AGG, RNK) over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import activity as A
from tracewell.operators import quality as Q
from tracewell.operators import rank as K
from tracewell.operators.changes import epoch_us
from tracewell.plans.registry import Registry
from tracewell.session import cut, table
from tracewell.sources import relations as R

reg = Registry(R.CTES)
QUERIES, ORACLES = reg.queries, reg.oracles

TERMS = ["daemon", "cursor", "postings"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_SCORE = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * (len / avgdl))) ELSE 0 END" for i in range(3))
BM25 = f"""tf AS (SELECT doc_id, len(w) AS len, {_TF} FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM documents)),
  st AS (SELECT count(*)::DOUBLE AS n, sum(len) / count(*) AS avgdl, {", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(3))} FROM tf),
  bm25 AS (SELECT doc_id, {_SCORE} AS score FROM tf, st)"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@reg(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY trunc(score * 1000000) DESC, doc_id) AS rank FROM bm25 WHERE score > 0) WHERE rank <= 25")
def bm25_top_docs(spark, d):
    best = K.top(K.bm25(_docs(spark, d), "doc_id", "text", TERMS), "score", "doc_id", 25)
    return best.select("doc_id", F.round("score", 6).alias("score"), "rank")


@reg(
    f"""WITH {BM25}, a AS (SELECT doc_id, row_number() OVER (ORDER BY trunc(score * 1000000) DESC, doc_id) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= 50),
      b AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE n_chars IS NOT NULL QUALIFY rank <= 50)
      SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT doc_id, rank, 2.0 AS w FROM a UNION ALL SELECT doc_id, rank, 1.0 FROM b) GROUP BY doc_id"""
)
def rrf_hybrid_docs(spark, d):
    a = K.top(K.bm25(_docs(spark, d), "doc_id", "text", TERMS), "score", "doc_id", 50)
    b = K.top(table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", F.col("n_chars").cast("double").alias("score")), "score", "doc_id", 50)
    return K.rrf([(a, 2.0), (b, 1.0)], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@reg("SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal) DESC NULLS LAST) AS rank FROM customer")
def competition_rank_customers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal").alias("bal"))
    return K.competition_ranks(c, "bal", ["c_mktsegment"]).select("c_custkey", "rank")


@reg(
    """WITH k AS (SELECT unnest(['harbor', 'session', 'model', 'kern']) AS kw), c AS (SELECT path, string_split(path, '/') AS p FROM files),
      w AS (SELECT path, kw, CASE WHEN i = len(p) THEN 2 ELSE 1 END AS wt, w FROM (SELECT path, p, kw, i, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(p[i], '(\\p{Ll})(\\p{Lu})', '\\1_\\2', 'g'), '([^_\\-.:#])(\\p{Lu}\\p{Ll})', '\\1_\\2', 'g'), '[_\\-.:#]+'), lambda x: lower(x)), lambda x: x <> '')) AS w
        FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM c), k)
        WHERE w = kw OR (least(length(w), length(kw)) >= 4 AND starts_with(CASE WHEN length(w) <= length(kw) THEN kw ELSE w END, CASE WHEN length(w) <= length(kw) THEN w ELSE kw END) AND 2 * least(length(w), length(kw)) >= greatest(length(w), length(kw)))),
      m AS (SELECT path, kw, max(wt) AS wt FROM w GROUP BY ALL), df AS (SELECT kw, count(*) AS df FROM m GROUP BY kw)
      SELECT path, count(*) AS words, round(sum(wt * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM m JOIN df USING (kw), (SELECT count(*)::DOUBLE AS n FROM c) GROUP BY path""",
    "files",
)
def filename_rank(spark, d):
    return K.filename_scores(R.files(spark, d, "id"), "path", ["harbor", "session", "model", "kern"]).select("path", F.col("words").cast("long").alias("words"), F.round("score", 6).alias("score"))


@reg("SELECT path, CASE WHEN lower(path) IN ('min.rb', 'harbor.rb', 'runner.go') THEN 0 ELSE 1 END AS class FROM files WHERE regexp_matches(lower(path), '(^|/)(min\\.rb|harbor\\.rb|runner\\.go)$')", "files")
def path_rank(spark, d):
    return K.path_matches(R.files(spark, d, "id"), "path", ["./min.rb", "Harbor.rb", "runner.go"])


@reg(
    """WITH h AS (SELECT path_id, status, least(count(*), 50) AS n FROM file_changes GROUP BY ALL), f AS (SELECT status, count(*) AS df FROM h GROUP BY status)
      SELECT path_id, CAST(floor(round(sum(1 + ln(m / df)) * 1000, 6)) AS BIGINT) AS score, sum(n) AS total FROM h JOIN f USING (status), (SELECT max(df) AS m FROM f) GROUP BY path_id""",
    "file_changes",
    whole="total",
)
def content_rank(spark, d):
    return K.content_scores(R.file_changes(spark, d).withColumn("one", F.lit(1)), "path_id", "status", "one")


@reg(
    """SELECT p_brand, p_partkey, score, rank FROM (SELECT p_brand, p_partkey, round(score, 6) AS score, row_number() OVER (ORDER BY tier, score DESC, p_partkey) AS rank FROM (
      SELECT p_brand, p_partkey, p_size % 3 AS tier, p_retailprice * (1 + 0.15 * (p_size / 50.0) + 0.35 * (p_partkey % 7 / 7.0) + 0.20 * 0) * CASE WHEN p_size > 40 THEN 0.5 ELSE 1 END AS score FROM part)) WHERE rank <= 60"""
)
def reranked_candidates(spark, d):
    p = table(spark, d, "part").select(
        "p_brand", "p_partkey", (F.col("p_size") % 3).alias("tier"), F.col("p_retailprice").alias("score"), (F.col("p_size") / 50).alias("activity"),
        (F.col("p_partkey") % 7 / 7).alias("session"), F.lit(0.0).alias("fan_in"), "p_size",
    )
    r = K.rerank(p, penalty=F.when(F.col("p_size") > 40, 0.5).otherwise(1.0))
    best = r.orderBy("tier", F.desc("score"), "p_partkey").limit(60)
    return best.select("p_brand", "p_partkey", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy("tier", F.desc("score"), "p_partkey")).alias("rank"))


TASK = ["harbor", "session", "ledger"]


def _targets(spark, d):
    """Files of a task by name (3), symbols (2.5), content (1.5) and graph (1): the files of
    its symbols' callers and callees and those their files import or are imported by."""
    from tracewell.operators import graph as G
    from tracewell.operators.cascade import by_symbol

    f, s, e = R.files(spark, d, "id", "head"), R.symbols(spark, d), cut(R.edges(spark, d))
    names = cut(K.filename_scores(f, "path", TASK).select("path", "score"))
    hits = cut(by_symbol(s, TASK).select("id", "file", "share"))
    symbols = hits.groupBy(F.col("file").alias("path")).agg(F.sum("share").alias("score"))
    body = cut(K.bm25(f, "path", "head", TASK))
    near = G.neighbor_files(e, s, hits.select("id", F.col("id").alias("rank"))).select("path")
    ends = e.where("kind = 'import'").join(s.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").select("a", "b").distinct()
    seeds = hits.select(F.col("file").alias("a")).distinct()
    side = ends.join(seeds, "a", "left_semi").select(F.col("b").alias("path")).unionByName(ends.join(seeds.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("a").alias("path")))
    graph = cut(near.unionByName(side).groupBy("path").agg(F.count("*").cast("double").alias("score")))
    fused = K.rrf([(K.top(names, "score", "path", 200), 3.0), (K.top(symbols, "score", "path", 200), 2.5), (K.top(body, "score", "path", 200), 1.5), (K.top(graph, "score", "path", 200), 1.0)], "path")
    flag = lambda df, c: df.select("path", F.lit(1).alias(c))
    every = fused.join(flag(names, "n"), "path", "left").join(flag(symbols, "s"), "path", "left").join(flag(body, "b"), "path", "left").join(flag(graph, "graph"), "path", "left").na.fill(0, ["n", "s", "b", "graph"])
    exact = F.col("path").rlike(r"(?:^|/)(?:" + "|".join(TASK) + r")\.[a-z]+$")
    return every.select("path", "score", exact.alias("exact"), (F.col("n") + F.col("s") + F.col("b")).alias("lexical"), "graph")


@reg()
def targets_tiers(spark, d):
    """Files tiered for a task from names, symbols, content and graph (tiers by brute force in the tests)."""
    return K.tiered(_targets(spark, d), 40).select("path", "tier", "position", F.round("score", 9).alias("score"))


@reg()
def targets_precise(spark, d):
    """The same without what falls off after the best, and no further than P1."""
    return K.precise(K.tiered(_targets(spark, d), 40), "P1").select("path", "tier", "position", F.round("score", 9).alias("score"))


@reg("SELECT t.file AS path, count(*) AS fan_in FROM edges e JOIN symbols t ON t.id = e.dst WHERE e.kind = 'call' GROUP BY t.file", "symbols edges")
def fan_in_all(spark, d):
    t = R.symbols(spark, d).select(F.col("id").alias("dst"), F.col("file").alias("path"))
    return R.edges(spark, d).where("kind = 'call'").join(t, "dst").groupBy("path").agg(F.count("*").alias("fan_in"))


FAN = "fan AS (SELECT t.file AS path, count(DISTINCT s.file) AS fan_in FROM edges e JOIN symbols t ON t.id = e.dst JOIN symbols s ON s.id = e.src WHERE e.kind = 'call' AND s.file <> t.file GROUP BY t.file)"


def _fan_in(spark, d):
    from tracewell.operators.graph import fan_in_files

    return fan_in_files(R.edges(spark, d).where("kind = 'call'"), R.symbols(spark, d))


@reg(f"WITH {FAN} SELECT path, fan_in FROM fan", "symbols edges")
def fan_in_distinct(spark, d):
    return _fan_in(spark, d)


@reg(f"WITH {FAN} SELECT path, fan_in FROM fan ORDER BY fan_in DESC, path LIMIT 20", "symbols edges")
def hotspots_topk(spark, d):
    return _fan_in(spark, d).orderBy(F.desc("fan_in"), "path").limit(20)


@reg("SELECT path_id, count(DISTINCT commit_id) AS commits FROM file_changes GROUP BY path_id", "file_changes")
def churn(spark, d):
    return R.file_changes(spark, d).groupBy("path_id").agg(F.count_distinct("commit_id").alias("commits"))


AGE = "date_diff('second', committed_at, TIMESTAMP '1998-08-02') / 86400.0"


def _aged(spark, d):
    age = (F.lit(902_016_000) - F.floor(epoch_us(F.col("committed_at")) / 1_000_000)) / 86400
    return R.file_changes(spark, d).join(R.commits(spark, d), "commit_id").withColumn("age", age)


@reg(f"SELECT path_id, count(*) AS changes FROM file_changes JOIN commits USING (commit_id) WHERE {AGE} BETWEEN 0 AND 30 GROUP BY path_id", "commits file_changes")
def recent_changes_30d(spark, d):
    return _aged(spark, d).where("age BETWEEN 0 AND 30").groupBy("path_id").agg(F.count("*").alias("changes"))


@reg(
    f"WITH a AS (SELECT path_id, sum(exp(-({AGE}) / 14)) AS s FROM file_changes JOIN commits USING (commit_id) WHERE {AGE} BETWEEN 0 AND 90 GROUP BY path_id) SELECT path_id, round(s / m, 6) AS score FROM a, (SELECT max(s) AS m FROM a)",
    "commits file_changes",
)
def activity_decay(spark, d):
    return K.normalized(A.decayed(_aged(spark, d), "path_id", F.col("age"), 14.0, 90.0), "score").select("path_id", F.round("score", 6).alias("score"))


NOW_US = 1_706_659_200_000_000  # 2024-01-31


@reg(f"SELECT user_id, round(sum(exp(-m / 30.0) * CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END), 6) AS score FROM (SELECT *, ({NOW_US} - epoch_us(ts)) / 60000000.0 AS m FROM events) WHERE m BETWEEN 0 AND 43200 GROUP BY user_id")
def session_decay(spark, d):
    e = table(spark, d, "events")
    age = (F.lit(NOW_US) - epoch_us(F.col("ts"))) / 60_000_000
    s = A.decayed(e, "user_id", age, 30.0, 43_200.0, F.when(F.col("event_type") == "purchase", 2.0).otherwise(1.0))
    return s.select("user_id", F.round("score", 6).alias("score"))


@reg(
    """SELECT sha256(event_type || chr(10) || '' || chr(10) || trim(regexp_replace(props, '\\s+', ' ', 'g'))) AS hash, count(*) AS count, min(epoch_us(ts)) AS first_ts, max(epoch_us(ts)) AS last_ts, arg_max(event_id, (epoch_us(ts), event_id)) AS last_run
      FROM events WHERE event_type = 'error' GROUP BY 1"""
)
def error_dedup(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    h = e.select(T.dedup_hash(F.col("event_type"), F.lit(None).cast("string"), F.col("props")).alias("hash"), epoch_us(F.col("ts")).alias("ts"), "event_id")
    return A.dedup_errors(h, "hash", "ts", "event_id").withColumnRenamed("last_run", "last_run")


@reg(f"SELECT event_id FROM events WHERE {NOW_US} - epoch_us(ts) <= {20 * 86_400_000_000} AND event_id >= (SELECT min(event_id) FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5000))")
def retention(spark, d):
    e = table(spark, d, "events").select("event_id", epoch_us(F.col("ts")).alias("us"))
    return A.retain(e, "us", "event_id", NOW_US, 20 * 86_400_000_000, 5000).select("event_id")


@reg("SELECT id FROM (SELECT id, max(time_updated) AS t FROM oc_session GROUP BY id HAVING max(time_updated) >= 1770000000000)")
def touched_sessions(spark, d):
    return table(spark, d, "oc_session").groupBy("id").agg(F.max("time_updated").alias("t")).where("t >= 1770000000000").select("id")


@reg("SELECT agent, count(DISTINCT session_id) AS sessions, count(*) AS turns, max(ts) AS last_ts FROM turns GROUP BY agent", "turns")
def agent_stats(spark, d):
    from tracewell.operators.corpus import agent_stats as stats

    return stats(R.turns(spark, d, timed=True))


@reg(
    "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.files, 0) AS files, coalesce(b.symbols, 0) AS symbols, CASE WHEN a.files > 0 THEN round(100.0 * coalesce(b.indexed, 0) / a.files, 6) END AS pct FROM (SELECT coalesce(lang, '') AS lang, count(*) AS files FROM files GROUP BY 1) a FULL JOIN (SELECT coalesce(f.lang, '') AS lang, count(*) AS symbols, count(DISTINCT f.path) AS indexed FROM symbols s JOIN files f ON f.path = s.file GROUP BY 1) b ON a.lang = b.lang",
    "files symbols",
)
def language_coverage(spark, d):
    f = R.files(spark, d, "lang").select("path", F.coalesce("lang", F.lit("")).alias("lang"))
    a = f.groupBy("lang").agg(F.count("*").alias("files"))
    b = R.symbols(spark, d).select(F.col("file").alias("path")).join(f, "path").groupBy("lang").agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("indexed"))
    j = a.join(b, "lang", "full")
    return j.select("lang", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.when(F.col("files") > 0, F.round(100.0 * F.coalesce("indexed", F.lit(0)) / F.col("files"), 6)).alias("pct"))


@reg("SELECT source, sum(strlen(text) // 4) AS tokens, CAST(round(median(strlen(text) // 4)) AS BIGINT) AS median FROM documents WHERE text IS NOT NULL GROUP BY source", whole="tokens")
def read_savings_audit(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("source", T.read_tokens(F.octet_length("text")).alias("t"))
    return docs.groupBy("source").agg(F.sum("t").alias("tokens"), F.round(F.median("t")).cast("long").alias("median"))


@reg(
    """WITH b AS (SELECT o_orderpriority AS gate, o_orderkey, o_orderstatus = 'F' AS delivered, count(l_orderkey) AS calls, list_distinct(list(l_partkey % 40) FILTER (l_returnflag <> 'R')) AS injected, list_distinct(list(l_partkey % 40) FILTER (l_linestatus = 'F')) AS used
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), c AS (SELECT gate, delivered, calls, coalesce(injected, []) AS i, coalesce(used, []) AS u FROM b)
      SELECT gate, count(*) AS n, count_if(delivered) AS delivered, CASE WHEN count(*) > 0 THEN round(count_if(calls = 0) / count(*), 6) END AS zero_call_rate, CASE WHEN sum(len(i)) > 0 THEN round(sum(len(list_intersect(i, u))) / sum(len(i)), 6) END AS precision, CASE WHEN sum(len(u)) > 0 THEN round(sum(len(list_intersect(i, u))) / sum(len(u)), 6) END AS recall FROM c GROUP BY gate""", whole="delivered")
def brief_metrics(spark, d):
    part = F.col("l_partkey") % 40
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("calls"), F.collect_set(F.when(F.col("l_returnflag") != "R", part)).alias("injected"), F.collect_set(F.when(F.col("l_linestatus") == "F", part)).alias("used"))
    empty = F.array().cast("array<bigint>")
    o = table(spark, d, "orders").join(l, "o_orderkey", "left").select(F.col("o_orderpriority").alias("gate"), (F.col("o_orderstatus") == "F").alias("delivered"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("injected", empty).alias("injected"), F.coalesce("used", empty).alias("used"))
    return A.rates(o, ["gate"], "delivered", "calls", "injected", "used")


@reg(
    """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1)
      SELECT event_type AS version, CASE WHEN value > 50 THEN 'full' ELSE 'partial' END AS coverage, count(*) AS operations, round(sum(value), 4) AS saved FROM f GROUP BY ALL"""
)
def ops_metrics_summary(spark, d):
    e = table(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.floor("value").cast("string")).alias("invocation"), "ts", "event_id", "event_type", "value")
    f = A.first_record(e, "invocation", ["ts", "event_id"])
    return f.groupBy(F.col("event_type").alias("version"), F.when(F.col("value") > 50, "full").otherwise("partial").alias("coverage")).agg(F.count("*").alias("operations"), F.round(F.sum("value"), 4).alias("saved"))


@reg("SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey % 3 AS model, year(l_shipdate) AS year, count(*) AS steps, sum(CAST(l_quantity AS BIGINT)) AS saved FROM lineitem GROUP BY ALL", whole="saved")
def time_estimate_groups(spark, d):
    l = table(spark, d, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_suppkey") % 3).alias("model"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("steps"), F.sum(F.col("l_quantity").cast("long")).alias("saved"))


JUDGED = "judged AS (SELECT doc_id, coalesce(lang, '?') AS actual, CASE WHEN doc_id % 5 = 0 THEN 'en' WHEN doc_id % 11 = 0 THEN 'xx' ELSE coalesce(lang, '?') END AS predicted FROM documents)"


def _judged(spark, d):
    lang = F.coalesce("lang", F.lit("?"))
    return table(spark, d, "documents").select("doc_id", lang.alias("actual"), F.when(F.col("doc_id") % 5 == 0, "en").when(F.col("doc_id") % 11 == 0, "xx").otherwise(lang).alias("predicted"))


@reg(f"WITH {JUDGED} SELECT actual, predicted, count(*) AS n FROM judged GROUP BY ALL")
def confusion_matrix(spark, d):
    return Q.confusion(_judged(spark, d), "actual", "predicted")


@reg(
    f"""WITH {JUDGED}, l AS (SELECT actual AS label, count(*) AS support, count_if(actual = predicted) AS hits FROM judged GROUP BY 1), g AS (SELECT predicted AS label, count(*) AS guessed FROM judged GROUP BY 1),
      r AS (SELECT label, support, CASE WHEN coalesce(guessed, 0) > 0 THEN hits / guessed ELSE 0 END AS p, hits / support AS r FROM l LEFT JOIN g USING (label))
      SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r"""
)
def confusion_prf(spark, d):
    return Q.label_scores(_judged(spark, d), "actual", "predicted")


WILSON = "({p} + 1.96 * 1.96 / (2 * n) {s} 1.96 * sqrt({p} * (1 - {p}) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)"


@reg(
    f"SELECT source, round(greatest(0, {WILSON.format(p='k / n', s='-')}), 6) AS low, round(least(1, {WILSON.format(p='k / n', s='+')}), 6) AS high FROM (SELECT source, count(*) FILTER (lang = 'en') AS k, count(*)::DOUBLE AS n FROM documents GROUP BY source)"
)
def wilson_by_group(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("k"), F.count("*").alias("n"))
    w = T.wilson(F.col("k"), F.col("n"))
    return g.select("source", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@reg(
    f"""WITH p AS (SELECT l_discount AS threshold, count(*) AS n, count_if(l_returnflag = 'R') AS wrong FROM lineitem GROUP BY 1), r AS (SELECT threshold, sum(n) OVER w AS n, sum(wrong) OVER w AS k FROM p WINDOW w AS (ORDER BY threshold DESC))
      SELECT threshold, n AS accepted, k AS wrong, round(n / (SELECT sum(n) FROM p), 6) AS coverage, round(k / n, 6) AS error, round(greatest(0, {WILSON.format(p='(k / n)', s='-')}), 6) AS low, round(least(1, {WILSON.format(p='(k / n)', s='+')}), 6) AS high FROM (SELECT threshold, n::DOUBLE AS n, k::DOUBLE AS k FROM r)"""
)
def error_coverage_curve(spark, d):
    l = table(spark, d, "lineitem").select("l_discount", (F.col("l_returnflag") != "R").alias("ok"), "l_orderkey")
    c = Q.error_curve(l, "l_discount", "ok", "l_orderkey")
    return c.withColumns({"accepted": F.col("accepted").cast("double"), "wrong": F.col("wrong").cast("double")})


@reg("SELECT l_returnflag, n, v[least(CAST(floor(n * 0.5) AS BIGINT), n - 1) + 1] AS p50, v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95 FROM (SELECT l_returnflag, count(*) AS n, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1)")
def floor_percentiles(spark, d):
    return Q.floor_percentile(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", {"p50": 0.5, "p95": 0.95})


@reg(
    """WITH o AS (SELECT DISTINCT user_id, event_id % 500 AS ident, arg_min(value, event_id) OVER (PARTITION BY user_id, event_id % 500) AS v FROM events)
      SELECT user_id, count(*) AS events, CASE WHEN count_if(v > 5) = count(*) THEN round(sum(v), 4) END AS duration, CASE WHEN count_if(v > 5) = count(*) THEN 'complete' WHEN count_if(v > 5) > 0 THEN 'partial' ELSE 'none' END AS coverage FROM o GROUP BY user_id"""
)
def trajectory_summary(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 500).alias("ident"), "event_id", "value")
    once = e.groupBy("user_id", "ident").agg(F.min_by("value", "event_id").alias("v"))
    t = A.trajectory(once.withColumn("duration", F.when(F.col("v") > 5, F.col("v"))), "user_id", "ident")
    return t.withColumn("duration", F.round("duration", 4))


@reg(
    """WITH b AS (SELECT o_custkey, o_orderpriority, min(CAST(round(o_totalprice) AS BIGINT)) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
      SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) - best AS regret, CASE WHEN best IS NULL THEN 'no-success' END AS reason FROM orders LEFT JOIN b USING (o_custkey, o_orderpriority)"""
)
def empirical_regret(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.round("o_totalprice").cast("long").alias("cost"), (F.col("o_orderstatus") == "F").alias("ok"))
    return A.regret(o, ["o_custkey", "o_orderpriority"], "o_orderkey", "cost", "ok")


@reg("SELECT f.lang, count(*) AS symbols FROM symbols s JOIN files f ON f.path = s.file GROUP BY f.lang", "files symbols")
def symbols_by_lang(spark, d):
    return R.symbols(spark, d).select(F.col("file").alias("path")).join(R.files(spark, d, "lang"), "path").groupBy("lang").agg(F.count("*").alias("symbols"))


@reg("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT id) FROM ruby_hybrid_unresolved WHERE op = 'added') AS unresolved", "files symbols edges")
def graph_counts(spark, d):
    one = lambda df, n: df.agg(F.count("*").alias(n)).withColumn("_k", F.lit(1))
    u = table(spark, d, "ruby_hybrid_unresolved").where("op = 'added'").select("id").distinct()
    parts = [one(R.files(spark, d, "id"), "files"), one(R.symbols(spark, d), "symbols"), one(R.edges(spark, d), "edges"), one(u, "unresolved")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_k")
    return out.drop("_k")


@reg(
    """WITH u AS (SELECT regexp_replace(trim(name), '^.*(::|#|[.])', '') AS leaf, count(DISTINCT id) AS n FROM ruby_hybrid_unresolved WHERE op = 'added' GROUP BY 1)
      SELECT s.uid, coalesce(u.n, 0) AS unresolved, coalesce(u.n, 0) > 0 AS lower_bound FROM symbols s LEFT JOIN u ON u.leaf = s.leaf""",
    "symbols",
)
def name_envelopes(spark, d):
    from tracewell.operators.orphans import leaf
    from tracewell.session import blank_to_null

    u = table(spark, d, "ruby_hybrid_unresolved").where("op = 'added'").groupBy(leaf(blank_to_null("name")).alias("leaf")).agg(F.count_distinct("id").alias("n"))
    return R.symbols(spark, d).join(u, "leaf", "left").select("uid", F.coalesce("n", F.lit(0)).alias("unresolved"), (F.coalesce("n", F.lit(0)) > 0).alias("lower_bound"))


@reg(
    """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS term FROM documents WHERE text IS NOT NULL), df AS (SELECT term, count(*) AS df FROM t WHERE term <> '' GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents), m AS (SELECT max(df) AS m FROM df)
      SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS lucene, round(1 + ln(m / df), 6) AS pool, round(CASE WHEN df * 4 > n THEN 0 ELSE least(ln((n + 1) / (df + 1)), 4) END, 6) AS keyword FROM df, n, m"""
)
def idf_table(spark, d):
    docs = table(spark, d, "documents")
    n = docs.count()
    df = docs.where("text IS NOT NULL").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    top = df.agg(F.max("df")).first()[0] or 1
    r = lambda c: F.round(c, 6)
    return df.select("term", "df", r(K.lucene_idf(F.lit(n), F.col("df"))).alias("lucene"), r(K.pool_idf(F.lit(top), F.col("df"))).alias("pool"), r(K.keyword_weight(F.col("df"), F.lit(n))).alias("keyword"))


@reg(
    """WITH r AS (SELECT doc_id, strlen(text) AS size, sum(strlen(text)) OVER (ORDER BY coalesce(lang, '') <> 'ja', epoch_us(created_at) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS kept FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL)
      SELECT doc_id, kept AS kept_size FROM r WHERE kept <= 400000""", whole="kept_size")
def eviction_budget(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL AND created_at IS NOT NULL").select("doc_id", F.octet_length("text").alias("size"), (F.coalesce("lang", F.lit("")) == "ja").alias("rescue"), epoch_us(F.col("created_at")).alias("at"))
    return A.evict(docs, "size", "rescue", "at", "doc_id", 400_000)


@reg("SELECT user_id, coalesce(p >= f, p IS NOT NULL) AS passing FROM (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS p, max(ts) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id) WHERE p IS NOT NULL OR f IS NOT NULL")
def test_status(spark, d):
    return A.last_signal(table(spark, d, "events"), "event_type", "ts", "purchase", "error", ["user_id"])


@reg("SELECT run_id, status, lag(status) OVER (ORDER BY run_id) AS was, status IS DISTINCT FROM lag(status) OVER (ORDER BY run_id) AS changed FROM index_runs")
def run_status_changes(spark, d):
    r = table(spark, d, "index_runs").select("run_id", "status", F.lit(0).alias("_g"))
    return A.status_changes(r, ["_g"], ["run_id"], "status").drop("_g")


@reg(
    """WITH c AS (SELECT doc_id, o AS seq, strlen(substr(text, o * 1300 + 1, 1500)) AS score FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 200) / 1300.0) AS BIGINT), 1))) AS o FROM documents WHERE length(text) > 0))
      SELECT doc_id, arg_max(seq, (score, -seq)) AS seq, max(score) AS score FROM c GROUP BY doc_id"""
)
def best_chunk_per_document(spark, d):
    from tracewell.operators.corpus import chunk_offsets

    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", "text", F.posexplode(chunk_offsets(F.col("text"))).alias("seq", "c"))
    chunks = docs.select("doc_id", F.col("seq").cast("long").alias("seq"), F.octet_length(F.substr("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))).alias("score"))
    return K.best_chunks(chunks, "doc_id", "score", "seq")


@reg(
    """SELECT turn_id, n AS line FROM (SELECT turn_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS n FROM (SELECT path AS turn_id, list_transform(string_split(head, chr(10)), lambda x: trim(x)) AS l FROM files))
      WHERE s <> '' AND NOT regexp_matches(s, '^[{}]+$') AND NOT regexp_matches(s, '^(//|#|")') AND regexp_matches(s, 'if |else if|while |for |match |catch|when |guard|assert|check|ensure|validate')::INT + regexp_matches(s, 'return |break;|continue;|throw |panic!|unwrap|expect|abort|exit\\(|\\?$')::INT + regexp_matches(s, '=|return |push|insert|remove|set|append')::INT >= 2""",
    "files",
)
def crux_scores(spark, d):
    f = R.files(spark, d, "id", "head")
    return f.select(F.col("path").alias("turn_id"), F.explode(K.crux_lines(F.col("head"), 6)).alias("c")).select("turn_id", F.col("c.line").alias("line"))


@reg(
    """WITH item AS (SELECT file, id, length(name) AS l0, length(name) + length(signature) AS l1, length(name) + length(signature) + (end_line - line + 1) * 30 AS l2 FROM symbols),
      step AS (SELECT file, id, 0 AS k, l0 AS grow FROM item UNION ALL SELECT file, id, 1, l1 - l0 FROM item UNION ALL SELECT file, id, 2, l2 - l1 FROM item),
      used AS (SELECT *, ceil(sum(coalesce(grow, 0)) OVER (PARTITION BY file ORDER BY k, id) / 4.0) AS u FROM step), ok AS (SELECT *, max(u) OVER (PARTITION BY file ORDER BY k, id) <= 120 AS fits FROM used)
      SELECT file, id, coalesce(max(k) FILTER (fits), -1)::INT AS level FROM ok GROUP BY file, id""",
    "symbols",
)
def budget_fit(spark, d):
    """Symbols of each file fitted into a token budget."""
    s = R.symbols(spark, d).select("file", "id", F.length("name").alias("l0"), (F.length("name") + F.length("signature")).alias("l1"), (F.col("end_line") - F.col("line") + 1) .alias("_n"))
    return K.fit_budget(s.withColumn("l2", F.col("l1") + F.col("_n") * 30), "file", "id", 120, ["l0", "l1", "l2"])


@reg("SELECT q, round(coalesce(sum(CASE WHEN rel AND r <= 10 THEN 1 / log2(r + 1) END), 0) / i, 6) AS ndcg FROM (SELECT q, rel, r, (SELECT sum(1 / log2(k + 1)) FROM (SELECT unnest(range(1, CAST(least(m, 10) + 1 AS BIGINT))) AS k)) AS i FROM (SELECT l_suppkey AS q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r, l_returnflag = 'R' AS rel, count_if(l_returnflag = 'R') OVER (PARTITION BY l_suppkey) AS m FROM lineitem) WHERE m > 0) GROUP BY q, i")
def ndcg_at_10(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), F.row_number().over(w).alias("r"), (F.col("l_returnflag") == "R").alias("rel"))
    n = Q.ndcg(r, "q", "r", "rel").withColumnRenamed("query", "q")
    return n.join(r.where("rel").select("q").distinct(), "q", "left_semi")


_PREDICT = " ".join("WHEN " + " OR ".join(f"contains(lower(o_orderpriority || ' ' || o_custkey), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in {"F": ["7", "3 f"], "O": ["5"], "P": [" p"]}.items())


@reg(
    f"""WITH o AS (SELECT o_orderpriority || ' ' || o_custkey AS t, o_orderstatus AS s FROM orders), known AS (SELECT o_orderpriority || ' ' || o_custkey AS t, min(o_orderstatus) AS p FROM orders WHERE o_orderkey % 20 = 0 GROUP BY 1),
      k AS (SELECT o_orderstatus AS s, CASE {_PREDICT} END AS p FROM orders), x AS (SELECT o.s, known.p FROM o LEFT JOIN known USING (t))
      SELECT 'keyword' AS baseline, count(*) AS rows, count(p) AS answered, count_if(p = s) AS "right" FROM k UNION ALL SELECT 'exact_lookup', count(*), count(p), count_if(p = s) FROM x"""
)
def baseline_comparison(spark, d):
    """Two stand-in classifiers over the same rows: by keywords and by stored examples."""
    o = table(spark, d, "orders").select(F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("text"), F.col("o_orderstatus").alias("actual"), "o_orderkey")
    known = o.where("o_orderkey % 20 = 0")
    return Q.baseline_scores(o, "text", "actual", [Q.KeywordBaseline({"F": ["7", "3 f"], "O": ["5"], "P": [" p"]}), Q.ExactLookupBaseline(known, "text", "actual")])
