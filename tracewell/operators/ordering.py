"""Positions within groups, and running totals, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut


def numbered(df: DataFrame, group: list[str], order: list[str | Column], tag: str = "position", weight: Column | None = None, total: str | None = None) -> DataFrame:
    """Add ``tag`` (1-based position in ``order`` within ``group``) and, with
    ``weight``, ``total``: the group's running sum of it up to and including the row.

    Rows are range partitioned by group and order, so a group with a third of all
    rows spans many tasks; only one small row per partition and group meets in a
    window.  Rows with equal order columns take some order of their own.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    w = F.lit(0).cast("long") if weight is None else weight
    placed = cut(
        df.withColumn("_nw", w)
        .repartitionByRange(n, *group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_nno", F.monotonically_increasing_id())
        .withColumn("_npart", F.shiftright("_nno", 33))
    )
    pieces = placed.groupBy(*group, "_npart").agg(F.min("_nno").alias("_nn0"), F.count("*").alias("_c"), F.sum("_nw").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_npart").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(
        *group,
        "_npart",
        # the rows of a piece are numbered one by one: its place less its first row's
        (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_nn0") + 1).alias("_nc0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_ns0"),
    )
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*group, "_npart"]]
    cond = same[0]  # by the piece alone where there is one group
    for c in same[1:]:
        cond = cond & c
    out = placed.alias("r").join(starts.alias("s"), cond).select("r.*", "s._nc0", "s._ns0").withColumn(tag, F.col("_nc0") + F.col("_nno"))
    if total:
        inside = Window.partitionBy(*group, "_npart").orderBy("_nno").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(total, F.col("_ns0") + F.sum("_nw").over(inside))
    return out.drop("_nw", "_nno", "_npart", "_nc0", "_ns0")
