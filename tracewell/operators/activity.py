"""Recency-decayed activity, deduplication, retention and operation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decay(age: Column, fold: float, window: float) -> Column:
    """exp(-age / fold) for ages within 0..window, else 0; the fold is an e-folding
    constant, and the future does not count."""
    return F.when((age >= 0) & (age <= window), F.exp(-age / fold)).otherwise(0.0)


def decayed(df: DataFrame, key: str, age: Column, fold: float, window: float, weight: Column | None = None) -> DataFrame:
    """``key, score``: decayed weights summed per key, keys without any left out."""
    w = F.lit(1.0) if weight is None else weight
    inside = df.where((age >= 0) & (age <= window))
    return inside.groupBy(key).agg(F.sum(F.exp(-age / fold) * w).alias("score"))


def dedup_errors(errors: DataFrame, identity: str, ts: str, run: str) -> DataFrame:
    """``identity, count, first_ts, last_ts, last_run``: one row per error; all
    aggregates combine before the shuffle, so a hot error costs one row per task."""
    return errors.groupBy(identity).agg(F.count("*").alias("count"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max(F.struct(ts, run)).alias("_l")).withColumn("last_run", F.col("_l")[run]).drop("_l")


def merge_errors(old: DataFrame, new: DataFrame, identity: str) -> DataFrame:
    """Two deduplicated tables as one; the later sighting gives ``last_run``."""
    both = old.unionByName(new)
    return both.groupBy(identity).agg(F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.max(F.struct("last_ts", "last_run")).alias("_l")).withColumn("last_run", F.col("_l.last_run")).drop("_l")


def retain(df: DataFrame, ts: str, key: str, now: int, age: int, cap: int) -> DataFrame:
    """Rows no older than ``age`` and among the newest ``cap`` by key: the cap is a
    threshold on the key, found by a top-k, not a window over everything."""
    fresh = df.where(F.col(ts) >= now - age)
    floor = df.orderBy(F.desc(key)).limit(cap).agg(F.min(key)).first()[0]
    return fresh if floor is None else fresh.where(F.col(key) >= floor)


def evict(df: DataFrame, size: str, rescue: str, at: str, key: str, budget: int) -> DataFrame:
    """What stays within ``budget``: rescue rows before others, newer before older.

    The running size comes from :func:`tracewell.operators.ordering.numbered`, so no
    task holds the whole order.
    """
    from tracewell.operators.ordering import numbered

    ranked = df.select(F.lit(0).alias("_all"), (~F.col(rescue)).alias("_r"), (-F.col(at).cast("long")).alias("_at"), F.col(key), F.col(size), rescue)
    run = numbered(ranked, ["_all"], ["_r", "_at", key], "_n", F.col(size).cast("long"), "kept_size")
    return run.where(F.col("kept_size") <= budget).select(key, "kept_size")


def first_record(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each key."""
    rest = [c for c in df.columns if c not in (key, *order)]
    g = df.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return g.select(key, *[F.col("_r")[c].alias(c) for c in [*order, *rest]])


def rates(df: DataFrame, by: list[str], delivered: str, calls: str, injected: str, read: str) -> DataFrame:
    """Delivery, zero-call rate and pooled precision and recall per group; null where a
    denominator is 0.  ``injected`` and ``read`` are arrays."""
    both = F.size(F.array_intersect(injected, read))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(delivered).alias("delivered"), F.count_if(F.col(calls) == 0).alias("zero"),
        F.sum(both).alias("hit"), F.sum(F.size(injected)).alias("given"), F.sum(F.size(read)).alias("used"),
    )
    return g.select(*by, "n", "delivered", ratio(F.col("zero"), F.col("n")).alias("zero_call_rate"), ratio(F.col("hit"), F.col("given")).alias("precision"), ratio(F.col("hit"), F.col("used")).alias("recall"))


def trajectory(events: DataFrame, key: str, ident: str) -> DataFrame:
    """``key, events, duration, coverage``: repeated ids count once; a duration is given
    only where every event has one."""
    once = events.dropDuplicates([key, ident])
    g = once.groupBy(key).agg(F.count("*").alias("events"), F.sum("duration").alias("_d"), F.count("duration").alias("_n"))
    return g.select(
        key, "events", F.when(F.col("_n") == F.col("events"), F.col("_d")).alias("duration"),
        F.when(F.col("_n") == F.col("events"), "complete").when(F.col("_n") > 0, "partial").otherwise("none").alias("coverage"),
    )


def regret(attempts: DataFrame, identity: list[str], ident: str, cost: str, ok: str) -> DataFrame:
    """``ident, regret, reason``: own cost less the least cost of a successful attempt of
    the same identity; null with a reason where none succeeded or the cost is unknown."""
    best = attempts.where(F.col(ok)).groupBy(*identity).agg(F.min(cost).alias("_b"))
    j = attempts.join(best, identity, "left")
    return j.select(
        ident, (F.col(cost) - F.col("_b")).alias("regret"),
        F.when(F.col(cost).isNull(), "no-cost").when(F.col("_b").isNull(), "no-success").alias("reason"),
    )


def last_signal(events: DataFrame, kind: str, ts: str, passed: str, failed: str, by: list[str]) -> DataFrame:
    """``by, passing``: the last pass is no earlier than the last failure."""
    g = events.groupBy(*by).agg(F.max(F.when(F.col(kind) == passed, F.col(ts))).alias("_p"), F.max(F.when(F.col(kind) == failed, F.col(ts))).alias("_f"))
    return g.where("_p IS NOT NULL OR _f IS NOT NULL").select(*by, F.coalesce(F.col("_p") >= F.col("_f"), F.col("_p").isNotNull()).alias("passing"))


def status_changes(runs: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each run's value against the one before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return runs.withColumn("was", F.lag(value).over(w)).withColumn("changed", ~F.col(value).eqNullSafe(F.col("was")))
