"""Text search and the inverted index (IDX, SRC-4/5) over the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import search as S
from tracewell.plans.registry import Registry
from tracewell.session import scratch_folder, table
from tracewell.sources import relations as R

reg = Registry(R.CTES)
QUERIES, ORACLES = reg.queries, reg.oracles
LINES = "lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
PATTERN = r"(?:cursor|budget) (?:moves|is spent)\. [A-Z]"


_WRITTEN: dict[tuple[str, str], str] = {}


def text_index(spark, d):
    """The folder of the documents' index, written by the first query that needs it."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _WRITTEN:
        _WRITTEN[at] = scratch_folder(spark)
        S.write_index(_docs(spark, d), "doc_id", "text", _WRITTEN[at])
    return _WRITTEN[at]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@reg(f"WITH {LINES} SELECT doc_id, line, content FROM lines WHERE regexp_matches(content, '{PATTERN}')")
def content_search_lines(spark, d):
    return S.search(_docs(spark, d), "doc_id", "text", PATTERN)


@reg(f"WITH {LINES} SELECT doc_id, line, content FROM lines WHERE regexp_matches(content, '{PATTERN}')")
def indexed_search_lines(spark, d):
    """The same through the written index; must equal the plain scan."""
    return S.search(_docs(spark, d), "doc_id", "text", PATTERN, text_index(spark, d))


@reg("SELECT count(DISTINCT gram) AS grams, CAST(sum(n) AS BIGINT) AS postings FROM (SELECT gram, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY gram)")
def written_index(spark, d):
    """What the written index of the documents holds."""
    p = spark.read.parquet(text_index(spark, d))
    return p.agg(F.count_distinct("gram").alias("grams"), F.sum(F.size("docs")).cast("long").alias("postings"))


@reg(
    f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS rn, count(*) OVER () AS n FROM lines WHERE regexp_matches(content, '{PATTERN}'))
      SELECT doc_id, line, content, n > 40 AS truncated FROM m WHERE rn > 15 AND rn <= 40"""
)
def search_page(spark, d):
    return S.page(S.search(_docs(spark, d), "doc_id", "text", PATTERN), ["doc_id", "line"], 15, 25)


@reg(
    """WITH g AS (SELECT DISTINCT event_type, unnest(list_transform(range(1, length(event_type) - 1), lambda i: substr(lower(event_type), i, 3))) AS gram FROM events)
      SELECT gram, count(*) AS docs, sum(n) AS events FROM g JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type) GROUP BY gram""", whole="events")
def gram_index(spark, d):
    kinds = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return kinds.select("event_type", "n", F.explode(S.grams(F.col("event_type"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"), F.sum("n").alias("events"))


@reg("SELECT gram, len(list(doc_id)) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS gram FROM documents WHERE length(text) >= 3) GROUP BY gram")
def postings_by_gram(spark, d):
    p = S.postings(_docs(spark, d), "doc_id", "text")
    return p.groupBy("gram").agg(F.sum(F.size("docs")).cast("long").alias("docs"), F.min(F.array_min("docs")).alias("first_doc"), F.max(F.array_max("docs")).alias("last_doc"))


@reg()
def sparse_grams(spark, d):
    """Sparse grams of the symbol names (brute force in the tests)."""
    s = R.symbols(spark, d).select(F.explode(S.sparse_grams(F.col("name"))).alias("g"))
    return s.groupBy("g.gram").agg(F.count("*").alias("n"))


@reg()
def gram_weights(spark, d):
    """The CRC-32 weight of each byte pair in use."""
    pairs = table(spark, d, "part").select(F.explode(S.grams(F.col("p_type"), 2)).alias("pair")).distinct()
    return pairs.select("pair", F.crc32(F.col("pair").cast("binary")).alias("weight"))


LAYERS = """base AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
  delta AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 7 = 0), gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 = 0),
  overlay AS (SELECT o_orderkey AS k, 'overlay' AS v FROM orders WHERE o_orderkey % 22 = 0)"""


@reg(
    f"""WITH {LAYERS} SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY layer DESC) AS rn FROM (
      SELECT k, v, 0 AS layer FROM base WHERE k NOT IN (SELECT k FROM gone) UNION ALL SELECT k, v, 1 FROM delta WHERE k NOT IN (SELECT k FROM gone) UNION ALL SELECT k, v, 2 FROM overlay)) WHERE rn = 1"""
)
def layered_index(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey").alias("k")
    return S.layered(
        o.where("o_orderdate < TIMESTAMP_NTZ'1996-01-01 00:00:00'").select(key, F.col("o_orderstatus").alias("v")),
        o.where("o_orderkey % 7 = 0").select(key, F.col("o_orderpriority").alias("v")),
        o.where("o_orderkey % 11 = 0").select(key),
        o.where("o_orderkey % 22 = 0").select(key, F.lit("overlay").alias("v")),
        "k",
    )


@reg("SELECT doc_id FROM documents WHERE contains(lower(text), 'stale postings') OR contains(lower(text), 'einträge')")
def unit_match(spark, d):
    docs = _docs(spark, d)
    return S.containing_units(docs, "doc_id", "text", ["stale postings", "Einträge", "ab"], spark.read.parquet(text_index(spark, d))).select("doc_id")


@reg("SELECT doc_id, created_at FROM (SELECT doc_id, created_at FROM documents WHERE contains(lower(text), 'daemon') AND created_at IS NOT NULL ORDER BY created_at DESC, doc_id DESC LIMIT 50)")
def newest_candidates(spark, d):
    docs = table(spark, d, "documents").where("created_at IS NOT NULL").select("doc_id", "created_at", "text")
    return S.newest(S.containing_units(docs, "doc_id", "text", ["daemon"]), "created_at", "doc_id", 50).select("doc_id", "created_at")


@reg("SELECT min(n) AS candidates FROM (SELECT count(*) FILTER (contains(lower(text), 'cur')) AS n FROM documents UNION ALL SELECT count(*) FILTER (contains(lower(text), 'urs')) FROM documents UNION ALL SELECT count(*) FILTER (contains(lower(text), 'rso')) FROM documents UNION ALL SELECT count(*) FILTER (contains(lower(text), 'sor')) FROM documents)")
def candidate_estimate(spark, d):
    n = S.candidate_count(S.read_postings(spark, text_index(spark, d), S.plan_pattern("cursor").grams()), S.plan_pattern("cursor").grams())
    return spark.createDataFrame([(n,)], "candidates long")


@reg(
    """SELECT doc_id FROM (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents WHERE text IS NOT NULL)
      WHERE contains(t, ' cold start ') AND contains(t, ' daemon ')"""
)
def message_phrases(spark, d):
    return S.phrase_match(_docs(spark, d).where("text IS NOT NULL"), "text", ["cold start", "daemon"]).select("doc_id")
