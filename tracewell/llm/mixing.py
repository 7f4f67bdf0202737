"""Records of several sources mixed to target shares, along a time-varying curriculum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import numbered
from tracewell.session import cut


def source_name(c: Column) -> Column:
    """A source's plain name: lower case, blanks and hyphens as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s_-]+", "_")


@dataclass(frozen=True)
class Source:
    name: str
    share: float  # as asked
    aim: float  # of the mixture, over the sources that have records
    repeats: int
    supply: int
    demand: float  # tokens
    slope: float  # weight(t) = aim * (1 + slope * (2 t - 1))


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None, slopes: dict[str, float] | None = None) -> list[Source]:
    """What to take of each source; one entry per target row, a control table.

    Shares of sources without records go to the others in proportion.  Without
    ``total`` the mixture is as large as the shares allow: the source that runs
    out first, repeated ``max_repeats`` times, sets the size.  With a larger
    ``total`` such sources fall short and the others still take their share of it.
    ``slopes`` in [-1, 1] say how a source's weight moves from start to end; they
    are shifted so that the weights of all sources sum to 1 at every moment.  By
    default the smaller a source's share, the later it weighs most.
    """
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").dropDuplicates(["source"])
    have = sized.groupBy("source").agg(F.sum("tokens").alias("supply"))
    rows = [r for r in want.join(have, "source", "left").collect() if (r["target_share"] or 0) > 0]
    rows.sort(key=lambda r: (-r["target_share"], r["source"]))
    held = [r for r in rows if r["supply"]]
    asked = sum(r["target_share"] for r in held)
    most = min((r["max_repeats"] * r["supply"] * asked / r["target_share"] for r in held if r["max_repeats"] > 0), default=0.0)
    size = most if total is None else float(total)
    raw = {r["source"]: (slopes or {}).get(r["source"], -0.5 + i / max(1, len(held) - 1)) for i, r in enumerate(held)}
    mean = sum(raw[r["source"]] * r["target_share"] / asked for r in held)
    moved = {k: v - mean for k, v in raw.items()}
    widest = max([1.0, *(abs(v) for v in moved.values())])
    out = []
    for r in rows:
        aim = r["target_share"] / asked if r["supply"] else 0.0
        demand = min(aim * size, float((r["max_repeats"] or 0) * (r["supply"] or 0)))
        out.append(Source(r["source"], r["target_share"], aim, r["max_repeats"] or 0, r["supply"] or 0, demand, moved.get(r["source"], 0.0) / widest))
    return out


def _per(sources: list[Source], field: str) -> Column:
    return F.try_element_at(F.create_map(*[x for s in sources for x in (F.lit(s.name), F.lit(float(getattr(s, field))))]), F.col("source"))


def mix(sized: DataFrame, sources: list[Source], seed: int = 0) -> DataFrame:
    """``position, source, doc_id, copy_no, tokens, moment`` of the mixture.

    ``sized``: ``doc_id, source, tokens`` (> 0).  Each source is read in a hashed
    order, pass after pass, until its demand is met; the last gap takes the unused
    document that fits it best, so a source misses its demand by less than that.  A
    copy's place in its source's token demand is inverted through the integral of
    the source's weight, demand(t) = D (t + slope (t^2 - t)), to a moment in 0..1,
    and the moments are range-sorted to positions (from 1).
    """
    if not any(s.demand > 0 for s in sources):
        return sized.limit(0).selectExpr("0L position", "source", "doc_id", "0 copy_no", "tokens", "0D moment")
    used = sized.where(F.col("source").isin([s.name for s in sources if s.demand > 0]))
    ordered = used.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    run = cut(numbered(ordered, ["source"], ["_h", "doc_id"], "_no", F.col("tokens"), "_sum").drop("_no"))
    demand, supply = _per(sources, "demand"), _per(sources, "supply")
    passes = F.floor(demand / supply + 1e-12)
    rest = demand - passes * supply
    run = run.withColumns({"_passes": passes.cast("int"), "_rest": rest, "_supply": supply})
    took = run.where(F.col("_sum") <= F.col("_rest")).groupBy("source").agg(F.max("_sum").alias("_took"))
    gaps = {r["source"]: r["_took"] for r in took.collect()}  # one number per source of the plan
    gap = F.col("_rest") - F.coalesce(F.try_element_at(F.create_map(*[x for k, v in gaps.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("source")) if gaps else F.lit(None), F.lit(0.0))
    fits = run.where((F.col("_sum") > F.col("_rest")) & (F.col("tokens") <= gap))
    last = {r["source"]: r["best"]["doc_id"] for r in fits.groupBy("source").agg(F.max(F.struct("tokens", "_h", "doc_id")).alias("best")).collect()}
    extra = F.col("doc_id") == (F.try_element_at(F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v))]), F.col("source")) if last else F.lit(None))
    more = ((F.col("_sum") <= F.col("_rest")) | F.coalesce(extra, F.lit(False))).cast("int")
    copies = run.withColumn("_n", F.col("_passes") + more).where("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    final = F.col("copy_no") > F.col("_passes")
    middle = (F.col("copy_no") - 1) * F.col("_supply") + F.when(final & (F.col("_sum") > F.col("_rest")), F.col("_rest") - F.col("tokens") / 2).otherwise(F.col("_sum") - F.col("tokens") / 2)
    u = F.least(F.greatest(middle / demand, F.lit(0.0)), F.lit(1.0))
    a = _per(sources, "slope")
    moment = F.when(F.abs(a) < 1e-9, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a))
    timed = copies.select(F.lit(0).alias("_all"), "source", "doc_id", "copy_no", "tokens", moment.alias("moment"))
    return numbered(timed, ["_all"], ["moment", "source", "doc_id", "copy_no"], "position").select("position", "source", "doc_id", "copy_no", "tokens", "moment")


def shares(mixed: DataFrame, sources: list[Source]) -> DataFrame:
    """Per source of the plan: target, aim and reached share, documents, copies, tokens."""
    spark = mixed.sparkSession
    asked = spark.createDataFrame(
        [(s.name, s.share, s.aim, s.repeats, s.supply) for s in sources], "source string, target_share double, aimed_share double, max_repeats int, supply long"
    )
    got = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("copies"), F.max("copy_no").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    total = got.agg(F.sum("tokens").alias("_total"))
    one = total.first()["_total"] or 0
    return asked.join(got, "source", "left").select(
        "source", "target_share", "aimed_share", "max_repeats", "supply",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "most_repeats", "tokens")],
        F.round(F.coalesce("tokens", F.lit(0)) / F.lit(max(1, one)), 6).alias("reached_share"),
    )
