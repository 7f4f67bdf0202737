"""Queries of the text problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import conversations, languages, mixing, packing, sources, tokens
from tracewell.operators.ordering import numbered
from tracewell.plans import general
from tracewell.session import cut, standing, table


def file_origins(spark: SparkSession, d: str) -> DataFrame:
    files = standing(table(spark, d, "index_files").select("path", "lang", "hash", "head", "indexed_at"), "path", ["indexed_at"])
    return sources.classify(files, table(spark, d, "upstream_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return file_origins(spark, d).where(~F.col("by_hand")).select("path")


def p4_origins_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Files per language and kind."""
    kinds = ["generated", "minified", "vendored", "data", "by_hand"]
    return file_origins(spark, d).groupBy("language").agg(F.count("*").alias("files"), *[F.count_if(k).alias(k) for k in kinds])


def conversation_turns(spark: SparkSession, d: str, texts: bool, max_offset_ms: int | None = 0) -> DataFrame:
    # JSON is read after the range sort of the times, which reads its input twice
    sorted_ = general.time_messages(spark, d, table(spark, d, "oc_message"))
    timed = conversations.read_messages(sorted_).drop("data").dropDuplicates(["id"])
    return conversations.rebuild(timed, conversations.read_parts(table(spark, d, "oc_part"), texts), table(spark, d, "oc_session"), max_offset_ms)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # times are to be taken as they stand: no clocks to align, and no reply link drops anything
    return conversation_turns(spark, d, texts=False, max_offset_ms=None).select("session_id", "turn_no", "message_id")


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns kept with role, moment and text; sender clocks may be off by a day."""
    return conversation_turns(spark, d, texts=True, max_offset_ms=86_400_000)


def skewed_turns(spark: SparkSession, d: str) -> DataFrame:
    """The conversations kept, on clocks set wrong: each session's assistant clock is off
    by up to ten minutes either way (by hash of the session), and every spoken turn
    declares the one before it as what it replies to."""
    spoken = conversation_turns(spark, d, texts=False).where("role <> 'tool'").select("session_id", "turn_no", F.col("message_id").alias("id"), "role", "utc_ms")
    true = cut(numbered(spoken, ["session_id"], ["turn_no"], "said"))
    before = true.select("session_id", (F.col("said") + 1).alias("said"), F.col("id").alias("reply_to"))
    planted = F.when(F.col("role") == "assistant", F.pmod(F.xxhash64("session_id"), F.lit(1_200_001)) - 600_000).otherwise(0)
    return true.join(before, ["session_id", "said"], "left").withColumn("planted_ms", planted).withColumn("utc_ms", F.col("utc_ms") + planted)


def p6_realigned(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation the planted clock error, whether the order it came with was
    wrong, and whether the least-squares offsets put every turn back into its place."""
    skewed = cut(numbered(skewed_turns(spark, d), ["session_id"], ["utc_ms", "id"], "came"))
    parts = skewed.select(F.col("id").alias("message_id"), F.lit(False).alias("unreadable"), F.lit(True).alias("has_turn"))
    sessions = skewed.select(F.col("session_id").alias("id")).distinct()
    back = conversations.rebuild(skewed.drop("turn_no", "planted_ms", "said", "came"), parts, sessions, 3_600_000).select("session_id", F.col("message_id").alias("id"), F.col("turn_no").alias("place"))
    return (
        skewed.join(back, ["session_id", "id"], "left")
        .groupBy("session_id")
        .agg(F.max(F.when(F.col("role") == "assistant", F.col("planted_ms"))).alias("planted_ms"), F.bool_or(F.col("came") != F.col("said")).alias("came_wrong"), F.bool_and(F.coalesce(F.col("place") == F.col("said"), F.lit(False))).alias("restored"))
    )


def document_sizes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", *columns, tokens.token_count(F.col("text")).alias("tokens"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(document_sizes(spark, d), table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_pack(spark, d), table(spark, d, "pack_specs"))


def mixture(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Source]]:
    sized = document_sizes(spark, d, "source").where("source IS NOT NULL").withColumn("source", mixing.source_name(F.col("source")))
    sized = cut(sized.where("tokens > 0"))
    sources_ = mixing.plan(sized, table(spark, d, "mix_targets"))
    return mixing.mix(sized, sources_), sources_


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixture(spark, d))


_NETS: dict[tuple[str, str], languages.Network] = {}


def language_net(spark: SparkSession, d: str, docs: DataFrame) -> languages.Network:
    """The network fit on these documents, once a session; its weights are a few hundred KB."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _NETS:
        _NETS[at] = languages.fit(docs)
    return _NETS[at]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The languages of each document whose set of them is not the one its label names."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    net = language_net(spark, d, docs)
    # the label rides along with the text: no join
    read = languages.document_languages(docs.withColumn("label", languages.label_language(F.col("lang"))), net, "label")
    right = (F.size("found") == 1) & F.coalesce(F.col("found")[0]["lang"] == F.col("label"), F.lit(False))
    return read.where(~right).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.lang")


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document's languages with confidence and number of full sentences."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return languages.document_languages(docs, language_net(spark, d, docs)).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return languages.segments(docs, language_net(spark, d, docs))


QUERIES = {
    "p4_found": p4_found,
    "p4_origins_by_language": p4_origins_by_language,
    "p6_found": p6_found,
    "p6_conversations": p6_conversations,
    "p6_realigned": p6_realigned,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_languages": p9_languages,
    "p9_segments": p9_segments,
}
_TURNS = rf"""{general.TIMES},
  said AS (SELECT DISTINCT session_id, id, ms, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.role') = 'VARCHAR' THEN lower(regexp_replace(j ->> '$.role', '\s+', '', 'g')) END AS r FROM (SELECT *, CASE WHEN json_valid(data) THEN data END AS j FROM oc_message) LEFT JOIN mm ON key = id WHERE session_id IS NOT NULL),
  msg AS (SELECT *, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'model') THEN 'assistant' WHEN r IS NOT NULL THEN 'tool' END AS role FROM said),
  part AS (SELECT message_id, bool_or(coalesce(json_type(j), '') <> 'OBJECT') AS bad, bool_or(coalesce((j ->> '$.type') = 'tool' OR ((j ->> '$.type') = 'text' AND json_type(j, '$.text') = 'VARCHAR' AND regexp_matches(j ->> '$.text', '[^\s\x{{A0}}\x{{3000}}]')), false)) AS turn
    FROM (SELECT message_id, CASE WHEN json_valid(data) THEN data END AS j FROM oc_part) GROUP BY message_id),
  whole AS (SELECT session_id FROM msg LEFT JOIN part ON message_id = id WHERE session_id IN (SELECT id FROM oc_session) GROUP BY session_id HAVING NOT bool_or(ms IS NULL OR role IS NULL OR coalesce(bad, false))),
  turn AS (SELECT session_id, id, role, row_number() OVER (PARTITION BY session_id ORDER BY ms, id) AS n FROM msg JOIN part ON message_id = id WHERE turn AND session_id IN (SELECT session_id FROM whole)),
  spoken AS (SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY n) AS next, row_number() OVER (PARTITION BY session_id ORDER BY n) AS k FROM turn WHERE role <> 'tool'),
  kept AS (SELECT session_id FROM spoken GROUP BY session_id HAVING bool_or(k = 1 AND role = 'user') AND NOT bool_or(role = 'user' AND coalesce(next, 'user') = 'user'))
"""
ORACLES = {"p6_found": f"WITH {_TURNS} SELECT session_id, n::INT AS turn_no, id AS message_id FROM turn WHERE session_id IN (SELECT session_id FROM kept)"}
