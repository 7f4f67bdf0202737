"""Resolution of a phrase to concepts: exact, then words, then trigrams, then symbols."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.search import windows

OVERLAP = 0.34


def _words(phrase: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(r"[^0-9a-z]+", phrase.lower()) if len(w) >= 2))


def exact(concepts: DataFrame, norm: str) -> DataFrame:
    return concepts.where(F.col("norm") == norm)


def by_all_words(concepts: DataFrame, words: list[str]) -> DataFrame:
    """Concepts (with ``words``) that hold every word."""
    return concepts.where(reduce(lambda a, w: a & F.array_contains("words", w), words, F.lit(bool(words))))


def by_any_word(concepts: DataFrame, words: list[str]) -> DataFrame:
    """Concepts that hold any word, with ``coverage``: how many."""
    n = reduce(lambda a, w: a + F.array_contains("words", w).cast("int"), words, F.lit(0))
    return concepts.withColumn("coverage", n).where("coverage > 0")


def by_trigrams(concepts: DataFrame, norm: str) -> DataFrame:
    """Concepts whose trigrams overlap the phrase's by at least ``OVERLAP`` of the
    smaller set; a phrase under three characters is matched as a substring."""
    if len(norm) < 3:
        return concepts.where(F.col("norm").contains(norm)).withColumn("overlap", F.lit(1.0))
    mine = F.array(*[F.lit(g) for g in sorted({norm[i : i + 3] for i in range(len(norm) - 2)})])
    theirs = F.array_distinct(F.when(F.length("norm") >= 3, windows(F.col("norm"), 3)).otherwise(F.array("norm")))
    return concepts.withColumn("overlap", T.overlap(theirs, mine)).where(F.col("overlap") >= OVERLAP)


def by_symbol(symbols: DataFrame, words: list[str]) -> DataFrame:
    """Symbols by the share of the query's words their name holds."""
    held = F.size(F.array_intersect(T.split_ident_words(F.col("name")), F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    return symbols.withColumn("share", held / max(1, len(words))).where("share > 0")


def score(norm: Column, phrase: str, is_test: Column, owned: Column) -> Column:
    """1 exact, 0.8 substring, else 0.3 to 0.7 by shared words; tests x 0.7, owners + 0.15."""
    words = _words(phrase)
    shared = F.size(F.array_intersect(T.concept_words(norm), F.array(*[F.lit(w) for w in words]))) if words else F.lit(0)
    base = F.when(norm == phrase, 1.0).when(norm.contains(phrase) | F.lit(phrase).contains(norm), 0.8).otherwise(0.3 + 0.4 * shared / max(1, len(words)))
    lifted = base * F.when(is_test, 0.7).otherwise(1.0) + F.when(owned, 0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lifted))


def weak_filenames(files: DataFrame, phrase: str, current: DataFrame, cap: int = 256) -> DataFrame:
    """``id, path, norm, score``: files whose name holds words of the phrase, where the
    concepts found so far (``current``: norm) say little.

    Nothing for a phrase under two words, or where a concept already holds more than
    half of them.  ``files``: id, path; the score is 0.3 to 0.7 by the share of words,
    0.12 more for a name, and no more than a substring's 0.8.  The first ``cap`` paths.
    """
    words = _words(phrase)
    want = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    empty = files.select("id", "path", F.lit("").alias("norm"), F.lit(0.0).alias("score")).limit(0)
    if len(words) < 2:
        return empty
    held = F.size(F.array_intersect(T.concept_words(F.col("norm")), want))
    if not current.where(2 * held > len(words)).isEmpty():
        return empty
    stem = F.substring_index(F.substring_index("path", "/", -1), ".", 1)
    shared = F.size(F.array_intersect(T.split_ident_words(stem), want))
    scored = files.select("id", "path", stem.alias("norm"), shared.alias("_n")).where("_n > 0")
    return scored.select("id", "path", "norm", F.least(F.lit(0.8), 0.3 + 0.4 * F.col("_n") / len(words) + 0.12).alias("score")).orderBy("path", "id").limit(cap)


def resolve(concepts: DataFrame, symbols: DataFrame, phrase: str, limit: int = 20, reranker: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``tier, id, norm``: the first tier that answers, and nothing of the later ones
    (``reranker``, a callable over the answer, may reorder it before it is cut).

    ``concepts``: id, norm, words; ``symbols``: id, name.  Every tier is planned at once
    and the least answered one kept by one aggregate, so a cascade is two passes, not
    one per tier.
    """
    words = _words(phrase)
    pick = lambda df, tier, rank: df.select(F.lit(tier).alias("tier"), rank.cast("double").alias("rank"), "id", "norm")
    named = symbols.withColumnRenamed("name", "norm")
    every = reduce(
        DataFrame.unionByName,
        [
            pick(exact(concepts, phrase), 0, F.lit(0)),
            pick(by_all_words(concepts, words), 1, F.length("norm")),
            pick(by_any_word(concepts, words), 2, -F.col("coverage")),
            pick(by_trigrams(concepts, phrase), 3, -F.col("overlap")),
            pick(by_symbol(named.withColumn("name", F.col("norm")), words), 4, -F.col("share")),
        ],
    )
    first = every.agg(F.min("tier")).first()[0]
    answer = every.where(F.col("tier") == (first if first is not None else -1))
    return (reranker(answer) if reranker else answer).orderBy("rank", "norm", "id").limit(limit).select("tier", "id", "norm")
