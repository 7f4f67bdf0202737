"""History, cascade, corpus, vectors and lookups (RNK-14..28, CAS, LKP) over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import cascade as C
from tracewell.operators import corpus as X
from tracewell.operators import history as H
from tracewell.operators import rank as K
from tracewell.operators import vectors as V
from tracewell.operators.changes import epoch_us
from tracewell.plans.ranking import BM25, TERMS
from tracewell.plans.registry import Registry
from tracewell.session import table
from tracewell.sources import relations as R

reg = Registry(R.CTES)
QUERIES, ORACLES = reg.queries, reg.oracles
OCC = "(length(l) - length(replace(l, '{u}', ''))) // {n}"


@reg(
    """WITH m AS (SELECT doc_id AS oid, lower(text) AS l, created_at AS "at", doc_id AS seq FROM documents WHERE regexp_matches(lower(source), '^\\s*commit[ _-]messages\\s*$') AND text IS NOT NULL AND created_at IS NOT NULL),
      p AS (SELECT doc_id AS oid, lower(path) AS l, created_at AS "at", doc_id AS seq FROM documents WHERE path IS NOT NULL AND created_at IS NOT NULL),
      h AS (SELECT oid, 'message' AS kind, "at", (length(l) - length(replace(l, 'daemon', ''))) // 6 + (length(l) - length(replace(l, 'cursor', ''))) // 6 + seq / (SELECT max(seq) FROM m) * 1e-3 AS score FROM m WHERE contains(l, 'daemon') AND contains(l, 'cursor')
        UNION ALL SELECT oid, 'path', "at", (length(l) - length(replace(l, 'daemon', ''))) // 6 + (length(l) - length(replace(l, 'cursor', ''))) // 6 + seq / (SELECT max(seq) FROM p) * 1e-3 FROM p WHERE contains(l, 'daemon') OR contains(l, 'cursor'))
      SELECT oid, kind, round(max(score), 6) AS score FROM h GROUP BY ALL ORDER BY max(score) DESC, max("at") DESC, oid LIMIT 30"""
)
def history_search_ranked(spark, d):
    docs = table(spark, d, "documents").where("created_at IS NOT NULL")
    row = lambda df, c: df.select(F.col("doc_id").alias("oid"), F.col("created_at").alias("at"), F.col("doc_id").alias("seq"), F.col(c).alias("text"))
    m = docs.where(F.lower("source").rlike(r"^\s*commit[ _-]messages\s*$") & F.col("text").isNotNull())
    return H.search([("message", row(m, "text")), ("path", row(docs.where("path IS NOT NULL"), "path"))], ["daemon", "cursor"], 30).select("oid", "kind", F.round("score", 6).alias("score"))


@reg(
    "SELECT path_id, min(committed_at) AS first_at, max(committed_at) AS last_at, arg_max(CASE WHEN status = 'R' THEN 'D' ELSE status END, (committed_at, commit_id, CASE WHEN status = 'R' THEN 'D' ELSE status END)) = 'D' AS removed, count(*) AS total FROM file_changes JOIN commits USING (commit_id) GROUP BY path_id",
    "commits file_changes",
)
def lifecycle_first_last(spark, d):
    c = R.file_changes(spark, d).join(R.commits(spark, d), "commit_id").withColumn("status", F.when(F.col("status") == "R", "D").otherwise(F.col("status")))
    return H.lifecycle(c, "path_id", "committed_at", "commit_id", "status")


@reg("SELECT count_if(state = 'P') AS unindexed, count_if(state = 'P' AND committed_at < TIMESTAMP '1995-06-01') AS unindexed_before FROM commits", "commits", whole="unindexed unindexed_before")
def token_coverage(spark, d):
    import datetime

    c = R.commits(spark, d).withColumnRenamed("committed_at", "at")
    return H.token_coverage(c, F.col("state") == "P", datetime.datetime(1995, 6, 1))


@reg(
    """WITH h AS (SELECT id AS seq, path, stat_mtime AS "at", head AS added, lag(head) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY id) AS removed FROM files),
      x AS (SELECT seq, path, "at", contains(lower(coalesce(removed, '')), 'journal') AND NOT contains(lower(coalesce(added, '')), 'journal') AS suspect, len(list_filter(string_split(concat_ws(chr(10), removed, added), chr(10)), lambda s: contains(s, 'journal') AND NOT regexp_matches(ltrim(s), '^(//|#)'))) > 0 AS definition
        FROM h WHERE contains(lower(concat_ws(chr(10), removed, added)), 'journal') AND "at" IS NOT NULL)
      SELECT seq, path, suspect, definition FROM x ORDER BY suspect DESC, definition DESC, "at" DESC, seq DESC, path LIMIT 40""",
    "files",
)
def excavated(spark, d):
    f = table(spark, d, "index_files").select("id", "path", "indexed_at", "stat_mtime", "head")
    from tracewell.session import standing

    s = standing(f, "path", ["indexed_at", "id"])
    w = Window.partitionBy(F.substring_index("path", "/", 1)).orderBy("id")
    h = s.select(F.col("id").cast("string").alias("oid"), "path", F.col("stat_mtime").alias("at"), F.col("id").alias("seq"), F.col("head").alias("added"), F.lag("head").over(w).alias("removed"))
    return H.excavate(h.where("at IS NOT NULL"), ["journal"], 40).select("seq", "path", "suspect", "definition")


@reg("SELECT o_orderdate AS \"at\", o_orderkey AS seq, o_orderpriority AS priority FROM orders WHERE contains(o_orderpriority, 'URGENT') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def last_good_argmax(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("priority"))
    return H.last_good(o, F.col("priority").contains("URGENT"), "at", "seq", ["priority"])


@reg("SELECT o_orderkey AS oid FROM orders WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND NOT (o_orderdate < TIMESTAMP '1994-01-01')")
def revision_range(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderdate").alias("at"))
    lim = lambda s: F.lit(s).cast("timestamp_ntz")
    return H.revision_range(o, o.where(F.col("at") < lim("1994-01-01")), o.where(F.col("at") <= lim("1995-06-01"))).select("oid")


@reg("SELECT file, target, arg_max(note, (\"at\", note)) AS note, max(\"at\") AS \"at\" FROM (SELECT path AS file, lang AS target, hash AS note, indexed_at AS \"at\" FROM index_files WHERE lang IS NOT NULL AND hash IS NOT NULL) GROUP BY ALL")
def annotations(spark, d):
    n = table(spark, d, "index_files").where("lang IS NOT NULL AND hash IS NOT NULL").select(F.col("path").alias("file"), F.col("lang").alias("target"), F.col("hash").alias("note"), F.col("indexed_at").alias("at"))
    return H.annotate(n.where("at % 2 = 0"), n.where("at % 2 = 1"))


# -- cascade --------------------------------------------------------------------------------

CONCEPT = "concepts AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type) AS norm, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 2)) AS words FROM part)"


def _concepts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("norm"))
    return p.withColumn("words", T.concept_words(F.col("norm")))


@reg(f"WITH {CONCEPT} SELECT 0 AS tier, id, norm FROM concepts WHERE norm = (SELECT norm FROM concepts WHERE id = 7) ORDER BY norm, id LIMIT 20")
def cascade_exact(spark, d):
    c = _concepts(spark, d)
    phrase = c.where("id = 7").first()["norm"]
    return C.resolve(c, R.symbols(spark, d).select("id", "name"), phrase)


@reg(f"WITH {CONCEPT}, k AS (SELECT split_part(norm, ' ', 2) AS a, split_part(norm, ' ', 1) AS b FROM concepts WHERE id = 7) SELECT 1 AS tier, id, norm FROM concepts, k WHERE list_contains(words, a) AND list_contains(words, b) ORDER BY length(norm), norm, id LIMIT 20")
def cascade_words(spark, d):
    c = _concepts(spark, d)
    w = c.where("id = 7").first()["norm"].split(" ")
    return C.resolve(c, R.symbols(spark, d).select("id", "name"), f"{w[1]} - {w[0]}")


@reg(
    f"""WITH {CONCEPT}, q AS (SELECT list_distinct(list_transform(range(1, length('standrd plishd') - 1), lambda i: substr('standrd plishd', i, 3))) AS g), t AS (SELECT id, norm, list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) AS n FROM concepts)
      SELECT id, round(len(list_intersect(n, g)) / least(len(n), len(g)), 6) AS overlap FROM t, q WHERE len(list_intersect(n, g)) / least(len(n), len(g)) >= 0.34"""
)
def cascade_trigrams(spark, d):
    return C.by_trigrams(_concepts(spark, d), "standrd plishd").select("id", F.round("overlap", 6).alias("overlap"))


@reg(
    f"""WITH {CONCEPT} SELECT id, round(greatest(0, least(1, CASE WHEN norm = 'part standard' THEN 1.0 WHEN contains(norm, 'part standard') OR contains('part standard', norm) THEN 0.8 ELSE 0.3 + 0.4 * len(list_intersect(words, ['part', 'standard'])) / 2 END * CASE WHEN id % 5 = 0 THEN 0.7 ELSE 1 END + CASE WHEN id % 3 = 0 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS score FROM concepts"""
)
def concept_scores(spark, d):
    return _concepts(spark, d).select("id", F.round(C.score(F.col("norm"), "part standard", F.col("id") % 5 == 0, F.col("id") % 3 == 0), 6).alias("score"))


@reg(
    """SELECT id, round(len(list_intersect(list_distinct(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(name, '(\\p{Ll})(\\p{Lu})', '\\1_\\2', 'g'), '([^_\\-.:#])(\\p{Lu}\\p{Ll})', '\\1_\\2', 'g'), '[_\\-.:#]+'), lambda x: lower(x))), ['scan', 'harbor'])) / 2, 6) AS share FROM symbols WHERE share > 0""",
    "symbols",
)
def symbol_fallback(spark, d):
    return C.by_symbol(R.symbols(spark, d), ["scan", "harbor"]).select("id", F.round("share", 6).alias("share"))


# -- corpus -----------------------------------------------------------------------------------


@reg("SELECT doc_id, o * 1300 AS start, least(o * 1300 + 1500, n) AS \"end\" FROM (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(CAST(ceil((length(text) - 200) / 1300.0) AS BIGINT), 1))) AS o FROM documents WHERE length(text) > 0)")
def chunk_windows(spark, d):
    return table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.explode(X.chunk_offsets(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.end")


@reg(
    """WITH w AS (SELECT word, ln(50000 / (1 + count_if(contains(lower(text), word)))) AS x FROM turns, (SELECT unnest(['daemon', 'indexer', 'loads', 'stale']) AS word) GROUP BY word HAVING count_if(contains(lower(text), word)) > 0),
      s AS (SELECT turn_id, session_id, round(sum(x), 6) AS score FROM turns, w WHERE contains(lower(text), word) GROUP BY ALL)
      SELECT session_id, arg_max(turn_id, (score, -turn_id)) AS turn_id, max(score) AS score, count(*) - 1 AS more FROM s GROUP BY session_id ORDER BY max(score) DESC, session_id LIMIT 10""",
    "turns",
)
def ask_sessions(spark, d):
    return X.ask(R.turns(spark, d, timed=True), "stale daemon loads indexer", 10)


@reg("SELECT session_id, max(agent) AS agent, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts FROM turns GROUP BY session_id HAVING max(ts) >= 1750000000000 AND min(ts) <= 1770000000000", "turns")
def session_listing(spark, d):
    return X.session_list(R.turns(spark, d, timed=True), 1_750_000_000_000, 1_770_000_000_000)


@reg("SELECT turn_id, CASE WHEN length(text) >= 1 AND (role = 'assistant' OR role = 'user') THEN 0 ELSE 2 END AS embedded FROM turns WHERE NOT regexp_matches(ltrim(coalesce(text, '')), '^(<|\\[)') AND NOT starts_with(ltrim(coalesce(text, '')), 'Caveat')", "turns")
def embedding_policy(spark, d):
    t = R.turns(spark, d).where(~F.ltrim(F.coalesce("text", F.lit(""))).rlike(r"^(?:<|\[|Caveat)"))
    return t.select("turn_id", X.embedding_policy(F.col("role"), F.col("text"), F.length("text")).alias("embedded"))


@reg("SELECT turn_id FROM (SELECT turn_id, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC, turn_id DESC) AS n FROM turns) WHERE n <= 3", "turns")
def last_turns_per_session(spark, d):
    return X.latest_per_group(R.turns(spark, d), "session_id", "seq", "turn_id", 3).select("turn_id")


# -- vectors --------------------------------------------------------------------------------------

COS = "round(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE)) / sqrt(list_dot_product(list_transform(v.embedding, lambda x: x::DOUBLE), list_transform(v.embedding, lambda x: x::DOUBLE)) * list_dot_product(list_transform(q.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))), 6)"


@reg(f"SELECT v.vec_id, {COS} AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q ORDER BY score DESC, v.vec_id LIMIT 10")
def vector_topk_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return V.nearest(e, "vec_id", "embedding", e.orderBy("vec_id").first()["embedding"], 10)


@reg(
    """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS scale FROM embeddings)
      SELECT vec_id, round(list_dot_product(list_transform(q.e, lambda x: x::DOUBLE), list_transform(embedding, lambda x: CASE WHEN scale > 0 THEN round(x::DOUBLE / scale) ELSE 0 END::DOUBLE)) * scale, 6) AS score FROM s, q ORDER BY score DESC, vec_id LIMIT 10"""
)
def knn_quantized(spark, d):
    """Top 10 over int8 codes."""
    e = table(spark, d, "embeddings")
    q = T.quantize(F.col("embedding"))
    codes = e.select("vec_id", q.alias("q")).select("vec_id", F.col("q.scale").alias("scale"), F.col("q.codes").alias("codes"))
    return V.nearest_codes(codes, "vec_id", "scale", "codes", e.orderBy("vec_id").first()["embedding"], 10)


_TURN_BM25 = BM25.replace("doc_id", "turn_id").replace("FROM documents", "FROM turns")
_NEAREST = f"SELECT v.vec_id, {COS} AS score FROM embeddings v, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@reg(
    f"""WITH {_TURN_BM25}, a AS (SELECT turn_id, row_number() OVER (ORDER BY trunc(score * 1000000) DESC, turn_id) AS rank FROM bm25 WHERE score > 0 QUALIFY rank <= 60),
      b AS (SELECT vec_id AS turn_id, row_number() OVER (ORDER BY trunc(score * 1000000) DESC, vec_id) AS rank FROM ({_NEAREST}) WHERE vec_id IN (SELECT turn_id FROM turns) QUALIFY rank <= 60)
      SELECT turn_id, round(sum(s), 9) AS score FROM (SELECT turn_id, 2.0 / (60 + rank) AS s FROM a UNION ALL SELECT turn_id, 1.0 / (60 + rank) FROM b) GROUP BY turn_id""",
    "turns",
)
def hybrid_turns(spark, d):
    """Turns by words (twice the weight) and by meaning; a turn's vector is the one of its number."""
    t, e = R.turns(spark, d), table(spark, d, "embeddings")
    words = K.top(K.bm25(t, "turn_id", "text", TERMS), "score", "turn_id", 60)
    vectors = e.join(t.select(F.col("turn_id").alias("vec_id")), "vec_id", "left_semi")
    near = V.nearest(vectors, "vec_id", "embedding", e.orderBy("vec_id").first()["embedding"], 61)
    meaning = K.top(near.select(F.col("vec_id").alias("turn_id"), "score"), "score", "turn_id", 60)
    return K.rrf([(words, 2.0), (meaning, 1.0)], "turn_id").select("turn_id", F.round("score", 9).alias("score"))


@reg(
    f"""WITH {BM25}, c AS (SELECT path, doc_id, n.score FROM documents d JOIN ({_NEAREST}) n ON n.vec_id = d.doc_id WHERE path IS NOT NULL),
      best AS (SELECT path, max(score) AS cosine FROM c GROUP BY path), lex AS (SELECT path, max(CAST(trunc(score * 1000000) AS BIGINT)) AS w FROM bm25 JOIN documents USING (doc_id) WHERE path IS NOT NULL GROUP BY path HAVING w > 0),
      s AS (SELECT path, row_number() OVER (ORDER BY cosine DESC, path) AS s FROM best), l AS (SELECT path, rank() OVER (ORDER BY w DESC) AS l FROM lex),
      k AS (SELECT *, lower(path) AS p, CASE WHEN contains(regexp_extract(lower(path), '[^/]*$'), '.') THEN regexp_extract(lower(path), '[^.]*$') ELSE '' END AS ext FROM s LEFT JOIN l USING (path))
      SELECT path, round((2.0 / (60 + s) + coalesce(1.0 / (60 + l), 0)) * CASE WHEN regexp_matches(p, '(^|/)(test|__tests__|spec|specs)/') OR regexp_matches(p, '(_test\\.|\\.test\\.|\\.spec\\.|_spec\\.)[^/]*$') OR ext IN ('json', 'yaml', 'yml', 'toml', 'md') OR regexp_matches(p, '(^|/)(locales|locale|i18n)/') THEN 0.8 ELSE 1 END, 9) AS score
      FROM k ORDER BY (2.0 / (60 + s) + coalesce(1.0 / (60 + l), 0)) * CASE WHEN regexp_matches(p, '(^|/)(test|__tests__|spec|specs)/') OR regexp_matches(p, '(_test\\.|\\.test\\.|\\.spec\\.|_spec\\.)[^/]*$') OR ext IN ('json', 'yaml', 'yml', 'toml', 'md') OR regexp_matches(p, '(^|/)(locales|locale|i18n)/') THEN 0.8 ELSE 1 END DESC, path LIMIT 50"""
)
def resident_search(spark, d):
    """Files by meaning: the best chunk of each by cosine and its words by BM25.  A
    document is a chunk of the file at its path, its vector the one of its number."""
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.orderBy("vec_id").first()["embedding"]])
    chunks = e.select(F.col("vec_id").alias("doc_id"), F.round(V.cosine(F.col("embedding"), q), 6).alias("score")).join(docs.where("path IS NOT NULL").select("doc_id", "path"), "doc_id")
    best = K.best_chunks(chunks, "path", "score", "doc_id").select("path", F.col("score").alias("cosine"))
    return K.by_meaning(best, K.bm25(docs, "doc_id", "text", TERMS, keep=["path"]), "path", TERMS, 50).select("path", F.round("score", 9).alias("score"))


@reg(
    """WITH q AS (SELECT ['stale', 'snapshot', 'mirror'] AS w), f AS (SELECT id, path, string_split(regexp_extract(path, '[^/]*$'), '.')[1] AS norm FROM files),
      x AS (SELECT id, path, norm, len(list_intersect(list_distinct(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(norm, '(\\p{Ll})(\\p{Lu})', '\\1_\\2', 'g'), '([^_\\-.:#])(\\p{Lu}\\p{Ll})', '\\1_\\2', 'g'), '[_\\-.:#]+'), lambda x: lower(x))), w)) AS n FROM f, q)
      SELECT id, path, norm, round(least(0.8, 0.3 + 0.4 * n / 3 + 0.12), 6) AS score FROM x WHERE n > 0 ORDER BY path, id LIMIT 256""",
    "files",
)
def weak_filenames(spark, d):
    """File names that hold words of a phrase no concept answers well."""
    found = C.weak_filenames(R.files(spark, d, "id"), "stale snapshot mirror", C.by_any_word(_concepts(spark, d), ["stale", "snapshot", "mirror"]))
    return found.select("id", "path", "norm", F.round("score", 6).alias("score"))


NEAR = f"near AS (SELECT * FROM (SELECT q.vec_id AS query, v.vec_id, {COS} AS score, v.label FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 8)"


def _near(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    n = V.neighbours(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 8)
    return n.join(e.select("vec_id", "label"), "vec_id")


@reg(f"WITH {NEAR} SELECT query, vec_id, score FROM near")
def vector_neighbours(spark, d):
    return _near(spark, d).select("query", "vec_id", "score")


@reg(
    f"""WITH {NEAR}, v AS (SELECT query, label, sum(score) AS v FROM near WHERE score >= 0.3 GROUP BY ALL), w AS (SELECT query, arg_max(label, (v, label)) AS label, max(v) AS v, sum(v) AS t FROM v GROUP BY query),
      n AS (SELECT query, max(score) AS top, count_if(score >= 0.3) AS near, max(label) FILTER (score >= 1.0) AS same FROM near GROUP BY query),
      r AS (SELECT n.query, top, same, w.label, w.v / w.t AS share, CASE WHEN top >= 1 THEN 'accept' WHEN top < 0.3 THEN 'novelty' WHEN near < 2 THEN 'insufficient-support' WHEN w.v / w.t < 0.6 THEN 'disagreement' ELSE 'accept' END AS decision FROM n LEFT JOIN w USING (query))
      SELECT query, decision, CASE WHEN decision = 'accept' THEN coalesce(same, label) END AS label, round(CASE WHEN top >= 1 THEN 1.0::DOUBLE WHEN decision = 'accept' THEN share END, 6) AS confidence FROM r"""
)
def knn_vote_labels(spark, d):
    return K.knn_vote(_near(spark, d), "query", "label", "score")


@reg()
def embedded_turns(spark, d):
    """Turns embedded by the model interface's stand-in."""
    t = R.turns(spark, d).where("text IS NOT NULL")
    e = V.embed(F.col("text"), V.HashingEmbedder())
    return t.select("turn_id", F.round(V.dot(e, e), 4).alias("norm"))


# -- lookups -----------------------------------------------------------------------------------------


@reg("SELECT uid FROM symbols WHERE name = 'Harbor' OR regexp_matches(name, '(::|\\.|#)scan_[a-z_]+$') ORDER BY kind, uid LIMIT 20", "symbols")
def find_symbol(spark, d):
    s = R.symbols(spark, d)
    return s.where((F.col("name") == "Harbor") | F.col("name").rlike(r"(?:::|\.|#)scan_[a-z_]+$")).orderBy("kind", "uid").limit(20).select("uid")


@reg("SELECT file, row_number() OVER (PARTITION BY file ORDER BY line, id) AS position, signature FROM symbols", "symbols")
def skeletons(spark, d):
    w = Window.partitionBy("file").orderBy("line", "id")
    return R.symbols(spark, d).select("file", F.row_number().over(w).alias("position"), "signature")


@reg("SELECT file AS path, string_agg(leaf, ',' ORDER BY line, id) AS symbols FROM symbols GROUP BY file", "symbols")
def repo_map(spark, d):
    s = R.symbols(spark, d).groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("line", "id", "leaf"))).alias("l"))
    return s.select("path", F.array_join(F.transform("l", lambda x: x["leaf"]), ",").alias("symbols"))


@reg("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 4")
def journal_groups(spark, d):
    return X.latest_per_group(table(spark, d, "events"), "user_id", "ts", "event_id", 4).select("user_id", "event_id")


@reg(
    """SELECT path, label, min(line) AS line FROM (SELECT path, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS line FROM (SELECT path, string_split(head, chr(10)) AS l FROM files)), (SELECT unnest(['auth', 'env', 'db']) AS label, unnest(['token|credential', 'ENV|process[.]env', 'add_column|store']) AS rx)
      WHERE regexp_matches(s, rx) GROUP BY ALL""",
    "files",
)
def prerequisites(spark, d):
    rules = {"auth": "token|credential", "env": "ENV|process[.]env", "db": "add_column|store"}
    lines = R.files(spark, d, "id", "head").select("path", F.posexplode(F.split("head", "\n")).alias("i", "s"))
    tags = F.filter(F.array(*[F.when(F.col("s").rlike(x), F.lit(k)) for k, x in rules.items()]), lambda t: t.isNotNull())
    return lines.select("path", F.explode(tags).alias("label"), (F.col("i") + 1).cast("long").alias("line")).groupBy("path", "label").agg(F.min("line").alias("line"))


@reg("SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_left, b.k IS NOT NULL AS in_right FROM (SELECT DISTINCT src || '>' || dst AS k FROM edges WHERE tier = 'exact') a FULL JOIN (SELECT DISTINCT src || '>' || dst AS k FROM edges WHERE kind = 'call') b ON a.k = b.k", "symbols edges")
def resolver_comparison(spark, d):
    e = R.edges(spark, d)
    k = F.concat_ws(">", F.col("src").cast("string"), F.col("dst").cast("string")).alias("k")
    a = e.where("tier = 'exact'").select(k).distinct().withColumn("a", F.lit(True))
    b = e.where("kind = 'call'").select(k).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").select("k", F.col("a").isNotNull().alias("in_left"), F.col("b").isNotNull().alias("in_right"))


@reg("SELECT event_id FROM events WHERE event_type = 'error' AND (contains(event_type, 'k%') OR contains(props, '\"k\": 2')) ORDER BY event_id DESC LIMIT 50")
def error_search(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.where(F.col("event_type").contains("k%") | F.col("props").contains('"k": 2')).orderBy(F.desc("event_id")).limit(50).select("event_id")


@reg("SELECT event_id FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 200")
def errors_since(spark, d):
    return table(spark, d, "events").where("event_id > 1000").orderBy("event_id").limit(200).select("event_id")


@reg("SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 25")
def latest_by_kinds(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase")).orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id")


@reg("SELECT a.event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) a WHERE event_type = was")
def replay_divergence(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("was", F.lag("event_type").over(w)).where("event_type = was").select("event_id")


@reg("SELECT s.event_id, round(greatest(0, 1 - date_diff('second', s.ts, TIMESTAMP '2024-01-31') / 86400.0 / 30), 6)::DOUBLE AS fresh FROM events s WHERE s.ts >= TIMESTAMP '2024-01-30' AND s.ts <= TIMESTAMP '2024-01-31'")
def session_window_events(spark, d):
    e = table(spark, d, "events").withColumn("us", epoch_us(F.col("ts")))
    now = 1_706_659_200_000_000
    e = e.where(F.col("us").between(now - 86_400_000_000, now))
    secs = F.lit(now // 1_000_000) - F.floor(F.col("us") / 1_000_000)
    return e.select("event_id", F.round(F.greatest(F.lit(0.0), 1 - secs / 86400.0 / 30), 6).alias("fresh"))
