"""Conversation turns: filters, chunks, rarity-selected words, fusion, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Openings of a user turn that machinery wrote, and marks inside one.
MACHINE_OPENINGS = [
    "<system-reminder>", "<task-notification>", "<command-name>", "<command-message>", "<local-command", "<bash-input>",
    "<realtime_delegation", "<send_user_message_question_reply", "[SYSTEM NOTIFICATION", "Caveat: The messages below", "[Request interrupted",
]
MACHINE_MARKS = ["CMUX agent handoff", "cmux-agent-send --queue"]


def user_intent(text: Column) -> Column:
    """human or orchestrator."""
    t, machine = F.ltrim(text), F.lit(False)
    for p in MACHINE_OPENINGS:
        machine = machine | t.startswith(p)
    for m in MACHINE_MARKS:
        machine = machine | t.contains(m)
    return F.when(machine, "orchestrator").otherwise("human")


def turn_filter(agent: str | None = None, cwd: str | None = None, role: str | None = None, since_ms: int | None = None, until_ms: int | None = None, session: int | None = None, human_only: bool = False) -> Column:
    """Conjunction of the given conditions; a working-directory prefix is taken
    literally, time bounds are inclusive.  Pushes down to the scan."""
    out = F.lit(True)
    for name, value in (("agent", agent), ("role", role), ("session_id", session)):
        if value is not None:
            out = out & (F.col(name) == value)
    if cwd is not None:
        out = out & F.col("cwd").startswith(cwd)
    if since_ms is not None:
        out = out & (F.col("ts") >= since_ms)
    if until_ms is not None:
        out = out & (F.col("ts") <= until_ms)
    if human_only:
        out = out & (F.col("role") == "user") & (user_intent(F.col("text")) == "human")
    return out


def chunk_offsets(text: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Windows of ``size`` characters that overlap by ``overlap``: ``array<struct<start, end>>``
    (0-based, end exclusive); an empty text has none."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - overlap) / step).cast("int"), F.lit(1)) - 1
    at = F.sequence(F.lit(0), last)
    spans = F.transform(at, lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def embedding_policy(role: Column, text: Column, length: Column, least: int = 1) -> Column:
    """0 to embed, 2 to skip: only human user turns and assistant turns with text."""
    keep = (role == "assistant") | ((role == "user") & (user_intent(text) == "human"))
    return F.when(F.coalesce(keep & (length >= least), F.lit(False)), 0).otherwise(2)


def agent_stats(turns: DataFrame) -> DataFrame:
    """Sessions, turns and last time per agent."""
    return turns.groupBy("agent").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns"), F.max("ts").alias("last_ts"))


def session_list(turns: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """``session_id, agent, turns, first_ts, last_ts`` of sessions that overlap the window;
    sessions without any time are kept where no window is given."""
    s = turns.groupBy("session_id").agg(F.max("agent").alias("agent"), F.count("*").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    if since_ms is not None:
        s = s.where(F.col("last_ts") >= since_ms)
    if until_ms is not None:
        s = s.where(F.col("first_ts") <= until_ms)
    return s


def word_costs(turns: DataFrame, words: list[str]) -> DataFrame:
    """``word, df``: turns that hold each word; one scan, no shuffle of text."""
    hits = F.array(*[F.when(F.lower("text").contains(w), F.lit(w)) for w in words]) if words else F.array().cast("array<string>")
    return turns.select(F.explode(F.filter(hits, lambda w: w.isNotNull())).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def rare_words(turns: DataFrame, words: list[str], most: int = 8, common: int = 50_000, floor: float = 0.1) -> dict[str, float]:
    """The query's rarest words with weight ln(common / (1 + df)): at most ``most``,
    none above ``common`` or below ``floor``.  A query has few words, so the result is
    bounded by the query."""
    import math

    df = {r["word"]: r["df"] for r in word_costs(turns, words).collect()}
    weighed = {w: math.log(common / (1 + df.get(w, 0))) for w in words if 0 < df.get(w, 0) <= common}
    best = sorted(((w, x) for w, x in weighed.items() if x >= floor), key=lambda p: (-p[1], p[0]))
    return dict(best[:most])


def ask(turns: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Sessions that answer a query: turns scored by the weights of the rare words they
    hold, the best turn per session and the number of its other hits."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    chosen = rare_words(turns, words)
    score = F.lit(0.0)
    for w, x in chosen.items():
        score = score + F.when(F.lower("text").contains(w), x).otherwise(0.0)
    hits = turns.withColumn("score", F.round(score, 6)).where("score > 0")
    best = hits.groupBy("session_id").agg(F.max(F.struct("score", (-F.col("turn_id")).alias("_n"), "turn_id")).alias("b"), (F.count("*") - 1).alias("more"))
    return best.select("session_id", F.col("b.turn_id").alias("turn_id"), F.col("b.score").alias("score"), "more").orderBy(F.desc("score"), "session_id").limit(k)


def latest_per_group(df: DataFrame, group: str, order: str, key: str, n: int) -> DataFrame:
    """The last ``n`` rows of each group; a group larger than the window's task is
    sorted with spill, never gathered in memory."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(key))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
