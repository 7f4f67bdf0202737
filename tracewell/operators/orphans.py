"""References to records that do not exist: keyed pending-orphan state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut, scratch_folder

HEAVY = 64  # a key with more than 1/HEAVY of all references is heavy; there are fewer than HEAVY


def heavy_keys(refs: DataFrame, key: str) -> list:
    """Keys that hold more than 1/HEAVY of the rows: at most HEAVY - 1, whatever the data."""
    counts = refs.where(F.col(key).isNotNull()).groupBy(key).count()
    total = refs.count()
    return [r[0] for r in counts.where(F.col("count") > F.lit(total) / HEAVY).select(key).collect()]


FIRST = "!"  # the step before all others, as text


class OrphanReplay:
    """The pending state kept as a log of transitions.

    ``refs`` (any columns with ``key`` and ``step``) and ``events`` (``key, step,
    delta``: +1 where a parent row arrives, -1 where one goes) are written once, a
    folder a step.  A batch is a run of steps and looks up only the keys it touches:
    its own references probe the parents' counts as of their step, parents that arrive
    resolve the references waiting for them, parents that go reopen theirs.  What
    changes is appended to the log; nothing older is rewritten.  A null key is no
    reference; a null step comes before all others.

    Skew: counts are combined per key and step before anything is ordered, and
    references meet them in joins that AQE may broadcast or split on the references' side.
    """

    def __init__(self, refs: DataFrame, events: DataFrame, ident: list[str], key: str = "key"):
        self.key, self.ident = key, ident
        n = max(1, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        first = F.coalesce("step", F.lit(FIRST)).alias("step")
        own = [c for c in refs.columns if c not in (key, "step")]
        laid = lambda df, by: cut(df.repartition(n, "step", F.pmod(F.xxhash64(*by), F.lit(max(1, n // 4)))), ["step"])
        self.refs = laid(refs.where(F.col(key).isNotNull()).select(key, *own, first), ident)
        counts = events.where(F.col(key).isNotNull()).groupBy(key, first).agg(F.sum("delta").alias("delta")).where("delta <> 0")
        self.events = laid(counts.select(key, "delta", "step"), [key])
        self.root = scratch_folder(refs.sparkSession)
        self.done: list[list[str]] = []

    def steps(self) -> list[str]:
        """The steps there are, in order: one small row each."""
        return sorted(r[0] for r in self.refs.select("step").unionByName(self.events.select("step")).distinct().collect())

    def transitions(self, steps: list[str]) -> DataFrame:
        """What a batch changes: the reference, its key, ``step``, ``now`` (-1 it waits,
        1 it is resolved) and ``was`` (0 for a new one)."""
        k = self.key
        # steps are folders: a batch's bounds prune files and are in no compiled expression
        within = F.col("step").between(min(steps), max(steps))
        new, moved = self.refs.where(within), self.events.where(within)
        marks = new.select(k, "step", F.lit(0).cast("long").alias("delta")).distinct().unionByName(moved.select(k, "step", "delta"))
        marks = marks.groupBy(k, "step").agg(F.sum("delta").alias("delta"))
        before = self.events.where(F.col("step") < min(steps)).groupBy(k).agg(F.sum("delta").alias("held"))
        by = Window.partitionBy(k).orderBy("step")  # as many rows as a batch has steps
        sign = lambda n: F.when(n > 0, 1).otherwise(-1)
        held = F.coalesce("held", F.lit(0))
        stand = marks.join(before, k, "left").withColumn("now", sign(held + F.sum("delta").over(by)))
        stand = cut(stand.select(k, "step", "now", F.coalesce(F.lag("now").over(by), sign(held)).alias("was")))
        cols = [k, *self.ident]
        fresh = new.join(stand.select(k, "step", "now"), [k, "step"]).select(*cols, "step", "now", F.lit(0).alias("was"))
        flips = stand.where("now <> was").withColumnRenamed("step", "at")
        flipped = self.refs.where(F.col("step") <= max(steps)).join(flips, k).where("step < at").select(*cols, F.col("at").alias("step"), "now", "was")
        return fresh.unionByName(flipped)

    def run(self, batches: list[list[str]]) -> OrphanReplay:
        """Apply batches of steps, oldest first."""
        for steps in batches:
            self.transitions(steps).write.mode("overwrite").parquet(f"{self.root}/batch={len(self.done)}")
            self.done.append(steps)
        return self

    def log(self) -> DataFrame:
        """All transitions so far."""
        spark = self.refs.sparkSession
        if not self.done:
            return spark.createDataFrame([], self.transitions([FIRST]).schema)
        return spark.read.parquet(*[f"{self.root}/batch={b}" for b in range(len(self.done))])

    def pending(self) -> DataFrame:
        """The references that wait after the last batch."""
        last = self.log().groupBy(*self.ident).agg(F.max(F.struct("step", "now")).alias("l"))
        return last.where("l.now < 0").select(*self.ident)

    def snapshots(self, *by: str) -> DataFrame:
        """``step, by, orphans`` after every step, where any wait."""
        change = F.when(F.col("now") < 0, 1).otherwise(0) - F.when(F.col("was") < 0, 1).otherwise(0)
        moves = self.log().groupBy("step", *by).agg(F.sum(change).alias("c"))
        every = [s for steps in self.done for s in steps]
        known = moves.select(*by).distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in every]) if every else F.array().cast("array<string>")))
        same = moves["step"].eqNullSafe(known["step"])
        for c in by:
            same = same & moves[c].eqNullSafe(known[c])
        w = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        total = known.join(moves, same, "left").select(known["step"], *[known[c] for c in by], "c").withColumn("orphans", F.coalesce(F.sum("c").over(w), F.lit(0)))
        return total.where("orphans > 0").select("step", *by, "orphans")


def leaf(name: Column) -> Column:
    """What follows the last ``::``, ``#`` or ``.`` of a name."""
    return F.regexp_replace(name, r"(?s)^.*(?:::|#|\.)", "")
