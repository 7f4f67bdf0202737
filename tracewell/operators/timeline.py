"""Mixed time texts to one UTC epoch-millisecond value each.

Every value gets the array of all moments it can denote
(:func:`tracewell.functions.instants.with_readings`); a Viterbi pass over each
source's record order picks one reading per record, at the least total of
reading costs, format switches and backward jumps.

Scale: records with a single reading pin the path, so the path splits there
exactly and only runs of ambiguous records reach Python.  A source is range
partitioned by its record order and cut into chunks of ``CHUNK`` rows, so a
source that holds a third of all rows is spread over many tasks; a run that
crosses chunks is solved for every choice at both ends of a chunk, and the
chunks of a source (one small row per 4,096 records) are joined as a tree by a
second, equally exact pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import instants
from tracewell.session import cut

K = 4  # readings of one text: two slash orders, each with two passes of a repeated hour
CHUNK_BITS = 12
FAN_BITS = 10  # chunks joined by one task: two to this


@dataclass(frozen=True)
class Costs:
    """``off_rule``: a reading against the declared clock; above twice
    ``switch + backward`` a declared clock always wins, so the path decides only
    where no clock is declared.  ``off_rule=0``: no clock is trusted.  ``strict``: a
    text none of whose readings follows its clock has no moment."""

    off_rule: float = 1000.0
    switch: float = 1.0
    backward: float = 2.0
    strict: bool = True


def _link(ms, fmt, a: int, i: int, b: int, j: int, costs: Costs) -> float:
    return costs.switch * (fmt[a, i] != fmt[b, j]) + costs.backward * (ms[b, j] < ms[a, i])


def _run(ms, fmt, cost, n, lo: int, hi: int, costs: Costs, first: int | None, last: int | None) -> tuple[float, list[int]]:
    """Least path over rows lo..hi, optionally with the reading at an end fixed."""
    best = [cost[lo, i] if first is None or i == first else np.inf for i in range(n[lo])]
    back: list[list[int]] = []
    for r in range(lo + 1, hi + 1):
        row, came = [], []
        for j in range(n[r]):
            steps = [best[i] + _link(ms, fmt, r - 1, i, r, j, costs) for i in range(n[r - 1])]
            i = int(np.argmin(steps))
            row.append(steps[i] + cost[r, j])
            came.append(i)
        best, _ = row, back.append(came)
    j = int(np.argmin(best)) if last is None else last
    total, path = best[j], [j]
    for came in reversed(back):
        path.append(came[path[-1]])
    return total, path[::-1]


def _runs(many: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Runs of ambiguous rows of lo..hi, each with its pinned neighbours."""
    at = np.flatnonzero(many[lo : hi + 1]) + lo
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    starts, ends = np.r_[at[0], at[cuts + 1]], np.r_[at[cuts], at[-1]]
    return [(max(lo, int(a) - 1), min(hi, int(b) + 1)) for a, b in zip(starts, ends)]


OUT = "row_no long, chunk long, source string, choice array<int>, ends array<double>"


def _decide(costs: Costs):
    def solve(p: pd.DataFrame) -> Iterator[tuple]:
        n = p["n"].to_numpy()
        many, chunk = n > 1, int(p["chunk"].iloc[0])
        src, no = p["source"].to_numpy(), p["row_no"].to_numpy()
        ms, fmt, cost = (np.array(p[x].tolist(), dtype=t) for x, t in (("ms", np.int64), ("fmt", np.int64), ("cost", np.float64)))
        cuts = np.flatnonzero(src[1:] != src[:-1])
        starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(p) - 1]
        for lo, hi in zip(starts.tolist(), ends.tolist()):
            inner = lo > 0 and hi < len(p) - 1
            if inner:
                for a, b in _runs(many, lo, hi):
                    for r, c in zip(range(a, b + 1), _run(ms, fmt, cost, n, a, b, costs, None, None)[1]):
                        if many[r]:
                            yield no[r], chunk, None, [c], None
                continue
            total = np.full((K, K), np.inf)
            total[: n[lo], : n[hi]] = 0.0
            if lo == hi:
                total[:] = np.inf
                for i in range(n[lo]):
                    total[i, i] = cost[lo, i]
                if many[lo]:
                    yield no[lo], chunk, src[lo], [k // K for k in range(K * K)], None
            else:
                for a, b in _runs(many, lo, hi):
                    firsts = range(n[lo]) if a == lo and many[lo] else [None]
                    lasts = range(n[hi]) if b == hi and many[hi] else [None]
                    picked = np.zeros((b - a + 1, K, K), dtype=int)
                    for i in firsts:
                        for j in lasts:
                            c, path = _run(ms, fmt, cost, n, a, b, costs, i, j)
                            at = (slice(None) if i is None else i, slice(None) if j is None else j)
                            total[at] += c
                            picked[(slice(None), *at)] = np.array(path).reshape(-1, *[1] * ((i is None) + (j is None)))
                    for r in range(a, b + 1):
                        if many[r]:
                            yield no[r], chunk, src[r], picked[r - a].ravel().tolist(), None
            yield None, chunk, src[lo], None, [n[lo], n[hi], *ms[lo], *ms[hi], *fmt[lo], *fmt[hi], *total.ravel()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row_no", "chunk", "source", "choice", "ends"]
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = held["chunk"] != held["chunk"].iloc[-1]
            if whole.any():
                for _, part in held[whole].groupby("chunk", sort=False):
                    yield pd.DataFrame(list(solve(part.reset_index(drop=True))), columns=names).astype({"row_no": "Int64"})
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            for _, part in held.groupby("chunk", sort=False):
                yield pd.DataFrame(list(solve(part.reset_index(drop=True))), columns=names).astype({"row_no": "Int64"})

    return run


def _enter(e: list[np.ndarray], first: int | None, costs: Costs) -> tuple[np.ndarray, list]:
    """Least totals at the end of a row of chunks, for each entry of ``first`` (None: any),
    and the way back: per chunk, by exit, the entry taken and the exit before it."""
    best, back = None, []
    for k, x in enumerate(e):
        n0, n1 = int(x[0]), int(x[1])
        ms0, f0, total = x[2 : 2 + K], x[2 + 2 * K : 2 + 3 * K], x[2 + 4 * K :].reshape(K, K)
        if best is None:
            enter, came = np.full(n0, 0.0 if first is None else np.inf), np.zeros(n0, int)
            if first is not None:
                enter[first] = 0.0
        else:
            y = e[k - 1]
            ms1, f1 = y[2 + K : 2 + 2 * K], y[2 + 3 * K : 2 + 4 * K]
            steps = np.array([[best[i] + costs.switch * (f1[i] != f0[j]) + costs.backward * (ms0[j] < ms1[i]) for i in range(len(best))] for j in range(n0)])
            enter, came = steps.min(axis=1), steps.argmin(axis=1)
        through = enter[:, None] + total[:n0, :n1]
        back.append((through.argmin(axis=0), came))
        best = through.min(axis=0)
    return best, back


def _pick(e: list[np.ndarray], first: int | None, last: int | None, costs: Costs) -> list[int]:
    """The entry and exit of each chunk (entry * K + exit) on the least path."""
    best, back = _enter(e, first, costs)
    j, out = int(np.argmin(best)) if last is None else last, []
    for at, came in reversed(back):
        i = int(at[j])
        out.append(i * K + j)
        j = int(came[i])
    return out[::-1]


ENDS = "source string, chunk long, ends array<double>"


def _merge_chunks(costs: Costs):
    """A row of chunks as one: its ends and the least total between each pair of them."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("chunk", kind="stable")
        e = [np.array(x) for x in p["ends"]]
        a, z = e[0], e[-1]
        n0, n1 = int(a[0]), int(z[1])
        total = np.full((K, K), np.inf)
        for i in range(n0):
            total[i, :n1] = _enter(e, i, costs)[0]
        ends = [a[0], z[1], *a[2 : 2 + K], *z[2 + K : 2 + 2 * K], *a[2 + 2 * K : 2 + 3 * K], *z[2 + 3 * K : 2 + 4 * K], *total.ravel()]
        return pd.DataFrame({"source": [p["source"].iloc[0]], "chunk": [p["up"].iloc[0]], "ends": [ends]})

    return run


def _choose_chunks(costs: Costs):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("chunk", kind="stable")
        fixed = p["fixed"].iloc[0]
        first, last = (None, None) if pd.isna(fixed) else divmod(int(fixed), K)
        return pd.DataFrame({"source": p["source"], "chunk": p["chunk"], "ends_at": _pick([np.array(x) for x in p["ends"]], first, last, costs)})

    return run


def join_chunks(ends: DataFrame, costs: Costs) -> DataFrame:
    """``source, chunk, ends_at``: the ends each chunk takes on its source's least path.

    Min-plus products are associative, so a source of many chunks is joined as a tree:
    up to ``2 ** FAN_BITS`` neighbours become one, level by level, until every source has
    no more than that; the ways back run down the same levels.  No task sees more.
    """
    levels = [ends.select("source", "chunk", "ends")]
    while (levels[-1].groupBy("source").count().agg(F.max("count")).first()[0] or 0) > 1 << FAN_BITS:
        grouped = levels[-1].withColumn("up", F.shiftright("chunk", FAN_BITS))
        levels.append(cut(grouped.groupBy("source", "up").applyInPandas(_merge_chunks(costs), ENDS)))
    out = "source string, chunk long, ends_at int"
    top = levels.pop().withColumn("fixed", F.lit(None).cast("int"))
    picks = top.groupBy("source").applyInPandas(_choose_chunks(costs), out)
    for level in reversed(levels):
        known = picks.select("source", F.col("chunk").alias("up"), F.col("ends_at").alias("fixed"))
        below = level.withColumn("up", F.shiftright("chunk", FAN_BITS)).join(known, ["source", "up"])
        picks = below.groupBy("source", "up").applyInPandas(_choose_chunks(costs), out)
    return picks


def placed(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """``rows`` range partitioned and sorted by source and record order, numbered in it.

    A narrow step may follow before :func:`decide`: what comes before is read twice,
    once to sample the ranges.
    """
    src = F.coalesce(F.col(source).cast("string"), F.lit("\x00"))
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = rows.withColumn("_src", src).repartitionByRange(n, "_src", *order).sortWithinPartitions("_src", *order)
    return sorted_.withColumn("_no", F.monotonically_increasing_id())


def resolve(rows: DataFrame, source: str, order: list[str], readings: str = "readings", costs: Costs = Costs(), tag: str = "utc_ms") -> DataFrame:
    """Add ``tag`` (epoch ms or null) and ``tag + '_format'`` to ``rows``.

    ``source`` names the record source, ``order`` its record order (repeated
    keys are fine: they keep some order of their own); ``readings`` is the array
    from :func:`instants.with_readings` and is dropped.  A null source is one source.
    Rows without a reading get nulls and take no part in a path; equal-cost paths
    go to the reading generated first.  Columns of any other name pass through.
    """
    return decide(placed(rows, source, order), readings, costs, tag)


def decide(rows: DataFrame, readings: str = "readings", costs: Costs = Costs(), tag: str = "utc_ms") -> DataFrame:
    """The second half of :func:`resolve`, over rows from :func:`placed`."""
    several = F.size(readings) > 1
    # a text has K readings at most; one more would be lost without a word
    at = cut(rows.withColumn(readings, F.when(F.size(readings) <= K, F.col(readings)).otherwise(F.raise_error(F.lit(f"more than {K} readings")))))
    pad = lambda f, z: F.array(*[F.coalesce(f(F.get(F.col(readings), F.lit(k))), z) for k in range(K)])
    flat = at.where(F.size(readings) > 0).select(
        F.col("_no").alias("row_no"),
        F.shiftright("_no", CHUNK_BITS).alias("chunk"),
        F.col("_src").alias("source"),
        F.least(F.size(readings), F.lit(K)).alias("n"),
        pad(lambda r: r["ms"], F.lit(0)).alias("ms"),
        pad(lambda r: F.crc32(r["fmt"]), F.lit(0)).alias("fmt"),
        pad(lambda r: r["cost"], F.lit(0.0)).alias("cost"),
    )
    decided = cut(flat.repartition("chunk").sortWithinPartitions("chunk", "row_no").mapInPandas(_decide(costs), OUT))
    ends = decided.where("ends IS NOT NULL").select("source", "chunk", "ends")
    joined = join_chunks(ends, costs)
    inner = decided.where("choice IS NOT NULL AND source IS NULL").select("row_no", F.col("choice")[0].alias("pick"))
    edge = (
        decided.where("choice IS NOT NULL AND source IS NOT NULL")
        .join(joined, ["source", "chunk"])
        .select("row_no", F.get("choice", F.col("ends_at")).alias("pick"))
    )
    picks = inner.unionByName(edge)
    # only ambiguous rows meet the picks; the rest keep their single reading in place
    sure = at.where(~several).withColumn("pick", F.lit(0))
    choice = at.where(several).join(picks, at["_no"] == picks["row_no"], "left").drop("row_no")
    chosen = F.get(F.col(readings), F.coalesce(F.col("pick"), F.lit(0)))
    return (
        sure.unionByName(choice)
        .withColumn("_chosen", chosen)
        .withColumn(tag, F.col("_chosen.ms"))
        .withColumn(f"{tag}_format", F.col("_chosen.fmt"))
        .drop("_src", "_no", "pick", "_chosen", readings)
    )


def _known_zone() -> Column:
    @F.pandas_udf("boolean")
    def known(s: pd.Series) -> pd.Series:
        from zoneinfo import available_timezones

        names = available_timezones()
        return s.map(lambda z: z in names)

    return known


def clocks(agent_clocks: DataFrame) -> DataFrame:
    """``agent, zone, date_order``, one row per agent; an unknown zone reads as UTC,
    an unknown order as dmy."""
    known = _known_zone()
    best = agent_clocks.where("agent IS NOT NULL").groupBy("agent").agg(F.min(F.struct("zone", "date_order")).alias("c"))
    zone = F.trim(F.col("c.zone"))
    return best.select(
        "agent",
        F.when(known(F.coalesce(zone, F.lit(""))), zone).otherwise("UTC").alias("zone"),
        F.when(F.lower(F.trim("c.date_order")) == "mdy", "mdy").otherwise("dmy").alias("date_order"),
    )


def read_times(rows: DataFrame, text: str, agent: str, source: str, order: list[str], clock_rows: DataFrame, costs: Costs = Costs(), tag: str = "utc_ms") -> DataFrame:
    """``rows`` with the moment its ``text`` denotes on its agent's clock.

    ``clock_rows`` comes from :func:`clocks`; agents without a row use UTC and dmy.
    """
    c = clock_rows.select(F.col("agent").alias("_agent"), F.col("zone").alias("_zone"), F.col("date_order").alias("_order"))
    known = placed(rows.join(c, F.col(agent) == F.col("_agent"), "left").drop("_agent"), source, order)
    zones = sorted({"UTC", *(r[0] for r in clock_rows.select("zone").distinct().collect())})  # a row per zone name
    read = instants.with_readings(known, text, F.coalesce("_zone", F.lit("UTC")), F.coalesce("_order", F.lit("dmy")), costs.off_rule, zones=zones)
    read = read.drop("_zone", "_order")
    if costs.strict:
        follows = F.get("readings", F.lit(0))["cost"] == 0  # the clock's own reading comes first
        read = read.withColumn("readings", F.when(follows, F.col("readings")).otherwise(F.array().cast(read.schema["readings"].dataType)))
    return decide(read, "readings", costs, tag)
