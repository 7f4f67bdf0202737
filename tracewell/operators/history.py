"""Commit history: ranked search, lifecycle, excavation, revision ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T


def search(facets: list[tuple[str, DataFrame]], units: list[str], limit: int, require_all: set[str] = frozenset({"message"})) -> DataFrame:
    """``oid, kind, score, at`` of the best hits over facets of (oid, at, seq, text).

    Score: occurrences of the units plus a thousandth of the relative recency; message
    facets need every unit, the others any.  The best hit per commit and kind stays;
    order is score, then recency, then id.
    """
    parts = []
    for kind, df in facets:
        top = df.agg(F.max("seq")).first()[0] or 0
        low = F.lower("text")
        hit = [low.contains(u.lower()) for u in units]
        cond = F.lit(bool(units) and kind in require_all)
        for h in hit:
            cond = (cond & h) if kind in require_all else (cond | h)
        score = T.relevance_of(F.col("text"), units) + T.recency_score(F.col("seq"), F.lit(top))
        parts.append(df.where(cond).select("oid", F.lit(kind).alias("kind"), score.alias("score"), "at"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy("oid", "kind").agg(F.max(F.struct("score", "at")).alias("b")).select("oid", "kind", "b.score", "b.at")
    return best.orderBy(F.desc("score"), F.desc("at"), "oid").limit(min(limit, 200))


def lifecycle(changes: DataFrame, key: str, at: str, seq: str, status: str) -> DataFrame:
    """``key, first_at, last_at, removed, total``: removed when the last change is a D.
    Aggregates only, combined before the shuffle."""
    order = F.struct(at, seq, status)
    g = changes.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max(order).alias("_l"), F.count("*").alias("total"))
    return g.select(key, "first_at", "last_at", (F.col("_l")[status] == "D").alias("removed"), "total")


def token_coverage(commits: DataFrame, unindexed: Column, first_seen) -> DataFrame:
    """``unindexed, unindexed_before``: commits whose text was never indexed, in all and
    before the token was first seen."""
    return commits.agg(F.count_if(unindexed).alias("unindexed"), F.count_if(unindexed & (F.col("at") < F.lit(first_seen))).alias("unindexed_before"))


def excavate(hunks: DataFrame, units: list[str], limit: int, allowed: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Candidates for where a phrase went: hunks (oid, path, at, seq, removed, added) that
    hold a unit, those that dropped it first, then definitions over comments, newest first.

    ``allowed`` or ``excluded`` (oid) narrow the revision range before the limit.
    """
    h = hunks
    if allowed is not None:
        h = h.join(allowed.select("oid").distinct(), "oid", "left_semi")
    if excluded is not None:
        h = h.join(excluded.select("oid").distinct(), "oid", "left_anti")
    both = F.concat_ws("\n", "removed", "added")
    hit = F.lit(False)
    for u in units:
        hit = hit | F.lower(both).contains(u.lower())
    gone = T.phrase_removed_between(F.coalesce("removed", F.lit("")), F.coalesce("added", F.lit("")), units)
    defined = F.lit(False)
    for u in units:
        defined = defined | T.phrase_outside_comment(both, u)
    out = h.where(hit).select("oid", "path", "at", "seq", gone.isNotNull().alias("suspect"), F.coalesce(defined, F.lit(False)).alias("definition"))
    return out.orderBy(F.desc("suspect"), F.desc("definition"), F.desc("at"), F.desc("seq"), "path").limit(limit)


def last_good(rows: DataFrame, present: Column, at: str, seq: str, keep: list[str]) -> DataFrame:
    """The latest row with the phrase still in it."""
    return rows.where(present).agg(F.max(F.struct(at, seq, *keep)).alias("m")).where("m IS NOT NULL").select(*[F.col("m")[c].alias(c) for c in [at, seq, *keep]])


def revision_range(commits: DataFrame, ancestors_of_from: DataFrame | None, ancestors_of_to: DataFrame | None) -> DataFrame:
    """Commits of an inclusive [from .. to] range: ancestors of ``to`` (with it) less
    proper ancestors of ``from``."""
    out = commits
    if ancestors_of_to is not None:
        out = out.join(ancestors_of_to.select("oid"), "oid", "left_semi")
    if ancestors_of_from is not None:
        out = out.join(ancestors_of_from.select("oid"), "oid", "left_anti")
    return out


def annotate(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes (file, target, note, at) with newer ones in place of older."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [notes, new])
    g = every.groupBy("file", "target").agg(F.max(F.struct("at", "note")).alias("m"))
    return g.select("file", "target", "m.note", "m.at")
