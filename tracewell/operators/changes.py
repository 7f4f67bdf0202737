"""Change capture over an append log: log partitions, what each run has to read, and the
keys that changed between runs (the feed itself: :mod:`tracewell.streaming.feed`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_us(ntz: Column) -> Column:
    """Epoch microseconds of a zone-less UTC time, whatever the session's zone."""
    days = F.datediff(F.to_date(ntz), F.lit("1970-01-01").cast("date")).cast("long")
    whole = ((days * 24 + F.hour(ntz)) * 60 + F.minute(ntz)) * 60_000_000
    return whole + (F.extract(F.lit("SECOND"), ntz) * 1_000_000).cast("long")


def log_partition(key: list[str], n: int) -> Column:
    """The log partition of a record.  It hashes the record, not the entity, so an
    entity with a third of all records still spreads over all partitions."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def batch_plan(log: DataFrame, runs: list[tuple], partition: str, offset: str, landed: str, partitions: int) -> DataFrame:
    """What each run has to read: ``run_id, seq, committed, part, from_offset, to_offset, records``.

    ``runs`` lists ``(run_id, started, ok)``.  A run covers each partition from what
    the last ok run committed (exclusive) to the greatest offset landed by its
    start (inclusive); what a failed run had planned falls to the next one,
    whose range starts at the same offset.  ``offset`` is unique in a partition and
    grows with ``landed``.  Records fold to one row per partition and run before
    anything is ordered, so the windows hold runs x partitions rows at most.
    """
    runs = sorted(runs, key=lambda r: (r[1], r[0]))
    spark, kind = log.sparkSession, log.schema[landed].dataType
    due = F.size(F.filter(F.array(*[F.lit(r[1]).cast(kind) for r in runs]), lambda s: s < F.col(landed))) if runs else F.lit(0)
    seen = log.groupBy(F.col(partition).alias("part"), due.alias("n")).agg(F.max(offset).alias("o"), F.count("*").alias("c"))
    marks = spark.createDataFrame([(k, r[0], bool(r[2])) for k, r in enumerate(runs)], "n int, run_id int, committed boolean")
    every = marks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).join(seen, ["part", "n"], "left")
    w = Window.partitionBy("part").orderBy("n")
    sofar, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ends = every.withColumn("to_offset", F.max("o").over(sofar)).withColumn("total", F.coalesce(F.sum("c").over(sofar), F.lit(0)))
    return ends.select(
        "run_id",
        (F.col("n") + 1).alias("seq"),
        "committed",
        "part",
        F.max(F.when(F.col("committed"), F.col("to_offset"))).over(before).alias("from_offset"),
        "to_offset",
        (F.col("total") - F.coalesce(F.max(F.when(F.col("committed"), F.col("total"))).over(before), F.lit(0))).alias("records"),
    )


def changed(batches: DataFrame, base: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """``run_id, key`` of every key whose value is set and differs from the last ok run's.

    ``base`` (key, version, value) is the state before the first run, ``version``
    an orderable column (the greatest wins), a null ``value`` means absent.  Records
    are folded to one per key and run before the shuffle, so a key's window holds
    no more rows than there are runs, and repeated or replayed records change nothing.
    """
    per_run = batches.groupBy(key, "seq", "run_id").agg(F.max(F.struct(version, value)).alias("s"))
    first = base.groupBy(key).agg(F.max(F.struct(version, value)).alias("s")).select(key, F.lit(0).alias("seq"), F.lit(None).cast("int").alias("run_id"), "s")
    by = Window.partitionBy(key).orderBy("seq")
    states = (
        per_run.unionByName(first)
        .withColumn("now", F.max("s").over(by.rowsBetween(Window.unboundedPreceding, 0))[value])
        .withColumn("was", F.lag("now").over(by))
    )
    return states.where("seq > 0 AND now IS NOT NULL AND NOT (now <=> was)").select("run_id", key)
