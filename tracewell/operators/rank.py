"""Scoring, fusion, tiers and other ranking."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import paths as P
from tracewell.functions import text as T
from tracewell.operators.ordering import numbered
from tracewell.session import cut

K1, B, RRF_K = 1.2, 0.75, 60.0


def lucene_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def pool_idf(n: Column, df: Column) -> Column:
    return 1 + F.log(n / F.greatest(df, F.lit(1)))


def keyword_weight(df: Column, n: Column) -> Column:
    """0 for words in more than a quarter of the files, at most 4, 4 for unseen ones."""
    return F.when(df == 0, 4.0).when(df * 4 > n, 0.0).otherwise(F.least(F.log((n + 1) / (df + 1)), F.lit(4.0)))


def term_frequencies(docs: DataFrame, text: str, terms: list[str], keep: list[str]) -> DataFrame:
    """``keep, len, tf0..tfk``: occurrences of the query's terms, counted in place, so no
    text or token is shuffled whatever the size of the corpus.

    Tokens are runs of ``[a-z0-9_]`` in the lower-cased text; they are counted by
    patterns, not split off, so no array of tokens is built.  A term with other
    characters occurs nowhere.
    """
    low = docs.select(*keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    count = lambda t: F.regexp_count("_low", F.lit(rf"(?<![a-z0-9_]){t}(?![a-z0-9_])")) if re.fullmatch("[a-z0-9_]+", t) else F.lit(0)
    return low.select(*keep, F.regexp_count("_low", F.lit("[a-z0-9_]+")).alias("len"), *[count(t).alias(f"tf{i}") for i, t in enumerate(terms)])


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = K1, b: float = B, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """``key, [keep], score`` of the documents with a positive Okapi BM25 score over the pool.

    One pass over the texts counts the terms and writes a few numbers per document;
    sizes, document frequencies and scores are made from those.  An empty query or
    pool scores nothing.
    """
    tf = cut(term_frequencies(docs, text, terms, [key, *keep]))
    if not terms:
        return tf.select(key, *keep, F.lit(0.0).alias("score")).limit(0)
    stat = tf.agg(F.count("*").alias("n"), F.sum("len").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, total = stat["n"], stat["total"] or 0
    if not n or not total:
        return tf.select(key, *keep, F.lit(0.0).alias("score")).limit(0)
    norm = 1 - b + b * (F.col("len") / F.lit(total / n))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (n - stat[f"df{i}"] + 0.5) / (stat[f"df{i}"] + 0.5))
        x = F.col(f"tf{i}").cast("double")
        score = score + F.when(x > 0, F.lit(idf) * (x * (k1 + 1)) / (x + k1 * norm)).otherwise(0.0)
    return tf.select(key, *keep, score.alias("score")).where("score > 0")


def fixed(score: Column) -> Column:
    """A score on whole numbers (x 1e6, truncated), for orders without float hazards."""
    return (score * 1_000_000).cast("long")


def top(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The best ``k`` with their 1-based rank: a top-k, then a window over k rows."""
    best = scored.withColumn("_f", fixed(F.col(score))).orderBy(F.desc("_f"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_f"), key))).drop("_f")


def rrf(lists: list[tuple[DataFrame, float]], key: str, rank: str = "rank", k: float = RRF_K) -> DataFrame:
    """``key, score``: sum of weight / (k + rank) over ranked lists (ranks from 1)."""
    parts = [df.select(key, (F.lit(float(w)) / (F.lit(k) + F.col(rank))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum("s").alias("score"))


def competition_ranks(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Add ``rank``: 1 + the number of rows with a strictly greater value.

    Counts are folded per distinct value and summed over range partitions of the
    values, so no task sees them all; the rank comes back by a join on the value.
    A null value ranks after all others, a null group is a group.
    """
    per = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = numbered(per, by, [F.col(value).desc_nulls_last()], "_p", F.col("_c"), "_t")
    ranks = run.select(*by, value, (F.col("_t") - F.col("_c") + 1).alias("rank"))
    same = F.lit(True)
    for c in (*by, value):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"r.{c}"))
    return df.alias("d").join(ranks.alias("r"), same).select("d.*", "rank")


def filename_scores(paths_: DataFrame, path: str, keywords: list[str]) -> DataFrame:
    """``path, words, score``: keywords a path names, twice as heavy in the basename,
    by inverse document frequency; keywords are the query's few."""
    comps = F.split(path, "/")
    dirs = F.flatten(F.transform(F.slice(comps, 1, F.greatest(F.size(comps) - 1, F.lit(0))), T.split_ident_words))
    base = T.split_ident_words(F.element_at(comps, -1))
    d = paths_.select(path, dirs.alias("_d"), base.alias("_b"))

    def hit(kw: str):
        return lambda w: T.word_matches(w, F.lit(kw))

    weights = [F.when(F.exists("_b", hit(kw)), 2).when(F.exists("_d", hit(kw)), 1).otherwise(0).alias(f"w{i}") for i, kw in enumerate(keywords)]
    m = d.select(path, *weights)
    stat = m.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"w{i}") > 0).alias(f"df{i}") for i in range(len(keywords))]).first()
    score, named = F.lit(0.0), F.lit(0)
    for i in range(len(keywords)):
        idf = math.log(1 + (stat["n"] - stat[f"df{i}"] + 0.5) / (stat[f"df{i}"] + 0.5))
        score = score + F.col(f"w{i}") * F.lit(idf)
        named = named + (F.col(f"w{i}") > 0).cast("int")
    return m.select(path, named.alias("words"), score.alias("score")).where("words > 0")


def path_matches(paths_: DataFrame, path: str, tokens: list[str]) -> DataFrame:
    """``path, class``: 0 where a token is the path, 1 where it is a suffix of it."""
    p, cls = F.lower(path), F.lit(None).cast("int")
    low = [t.removeprefix("./").lower() for t in tokens]
    for t in low:
        cls = F.least(cls, F.when(p == t, 0).when(p.endswith("/" + t), 1))
    return paths_.select(path, cls.alias("class")).where("class IS NOT NULL")


def content_scores(hits: DataFrame, path: str, keyword: str, count: str, cap: int = 50) -> DataFrame:
    """``path, score, total``: summed pool idf of the distinct keywords (thousandths,
    truncated) and capped counts, for the order score desc, total desc, path."""
    h = hits.groupBy(path, keyword).agg(F.least(F.sum(count), F.lit(cap)).alias("_n"))
    df = h.groupBy(keyword).agg(F.count("*").alias("_df"))  # one row per query keyword
    most = df.agg(F.max("_df")).first()[0] or 1
    idf = {r[keyword]: 1 + math.log(most / r["_df"]) for r in df.collect()}
    weight = F.try_element_at(F.create_map(*[x for k, v in idf.items() for x in (F.lit(k), F.lit(v))]), F.col(keyword)) if idf else F.lit(0.0)
    g = h.groupBy(path).agg(F.sum(weight).alias("s"), F.sum("_n").alias("total"))
    return g.select(path, F.floor(F.round(F.col("s") * 1000, 6)).alias("score"), "total")


def rerank(df: DataFrame, weights: tuple[float, float, float] = (0.15, 0.35, 0.20), penalty: Column | None = None) -> DataFrame:
    """Scores of ranked candidates lifted by activity, session and fan-in and lowered by
    a penalty; the order is tier, score, path, so no row leaves its tier."""
    a, s, f = weights
    lift = 1 + a * F.coalesce("activity", F.lit(0.0)) + s * F.coalesce("session", F.lit(0.0)) + f * F.coalesce("fan_in", F.lit(0.0))
    return df.withColumn("score", F.col("score") * lift * (F.lit(1.0) if penalty is None else penalty))


def normalized(df: DataFrame, value: str) -> DataFrame:
    """``value`` over its greatest; no rows where that is not positive."""
    most = df.agg(F.max(value)).first()[0]
    if most is None or most <= 0:
        return df.limit(0)
    return df.withColumn(value, F.col(value) / F.lit(float(most)))


def tiered(cands: DataFrame, limit: int, p0_cap: int = 5) -> DataFrame:
    """Tiers of fused candidates (path, score, exact, lexical, graph): P0 for an exact
    name or two lexical signals, at most ``p0_cap``; P1 for any lexical signal, with
    what P0 had no room for; P2 for the rest, at most a quarter of ``limit`` (rounded
    up).  The caps are filled in order of score, then path, and P2 beyond its cap
    does not use up the limit.

    A cap cuts at most ``limit`` rows, so each tier is a top-k before any window.
    """
    limit = min(limit, 100)
    order = [F.desc("_f"), "path"]
    c = cands.withColumn("_f", fixed(F.col("score")))
    strong = F.col("exact") | (F.col("lexical") >= 2)
    p0 = c.where(strong).orderBy(*order).limit(p0_cap).withColumn("tier", F.lit("P0"))
    spill = c.where(strong).join(p0.select("path"), "path", "left_anti")
    p1 = spill.unionByName(c.where(~strong & (F.col("lexical") >= 1))).orderBy(*order).limit(limit).withColumn("tier", F.lit("P1"))
    p2 = c.where(~strong & (F.col("lexical") == 0)).orderBy(*order).limit(-(-limit // 4)).withColumn("tier", F.lit("P2"))
    few = p0.unionByName(p1).unionByName(p2)
    w = Window.orderBy("tier", F.desc("_f"), "path")  # over at most 5 + 1.25 limit rows
    return few.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).drop("_f")


#: A file stays if it reaches this share of the last P0's score, or, without
#: a P0, of the first's where the second falls short of it.
GAP, SECOND_GAP = 0.5, 0.7


def precise(targets: DataFrame, max_tier: str = "P2", gap: bool = True) -> DataFrame:
    """``targets`` of :func:`tiered` (a hundred rows at most) without what falls off: files
    below the gap after the last P0, or, without one, after a clear first; then tiers
    beyond ``max_tier``.  The best file always stays."""
    stat = targets.agg(
        F.max("score").alias("top"), F.min(F.when(F.col("tier") == "P0", F.col("score"))).alias("p0"), F.min_by("score", "position").alias("first"),
        F.min_by(F.when(F.col("position") > 1, F.col("score")), F.when(F.col("position") > 1, F.col("position"))).alias("second"), F.count("*").alias("n"),
    ).first()
    out = targets
    if gap and stat["n"] > 1:
        floor = None
        if stat["p0"] is not None:
            floor = stat["p0"] * GAP
        elif stat["first"] > 0 and stat["second"] < stat["first"] * SECOND_GAP:
            floor = stat["first"] * SECOND_GAP
        if floor is not None:
            out = out.where((F.col("score") >= F.lit(floor)) | (F.col("position") == 1))
    return out.where(F.col("tier") <= max_tier)


def best_chunks(chunks: DataFrame, key: str, score: str, seq: str) -> DataFrame:
    """The best chunk of each file; the first of equals."""
    return chunks.groupBy(key).agg(F.max(F.struct(score, (-F.col(seq)).alias("_s"))).alias("b")).select(key, (-F.col("b._s")).alias(seq), F.col("b")[score].alias(score))


def knn_vote(neighbours: DataFrame, query: str, label: str, sim: str, least: float = 0.30, support: int = 2, share: float = 0.60) -> DataFrame:
    """``query, decision, label, confidence``: similarity-weighted votes with typed
    abstention; an exact neighbour decides alone.  Equal votes go to the greatest label."""
    n = neighbours.groupBy(query).agg(F.max(sim).alias("top"), F.max(F.when(F.col(sim) >= 1.0, F.col(label))).alias("same"), F.count_if(F.col(sim) >= least).alias("near"))
    votes = neighbours.where(F.col(sim) >= least).groupBy(query, F.col(label).alias("_l")).agg(F.sum(sim).alias("_v"))
    win = votes.groupBy(query).agg(F.max(F.struct("_v", "_l")).alias("w"), F.sum("_v").alias("t"))
    got = n.join(win, query, "left")
    part = F.col("w._v") / F.col("t")
    decision = (
        F.when(F.col("top") >= 1.0, "accept").when(F.col("top") < least, "novelty").when(F.col("near") < support, "insufficient-support").when(part < share, "disagreement").otherwise("accept")
    )
    ok = decision == "accept"
    return got.select(
        query, decision.alias("decision"), F.when(ok, F.coalesce("same", F.col("w._l"))).alias("label"),
        F.round(F.when(F.col("top") >= 1.0, 1.0).when(ok, part), 6).alias("confidence"),
    )


def by_meaning(best: DataFrame, lexical: DataFrame, path: str, terms: list[str], k: int, semantic: float = 2.0, words: float = 1.0) -> DataFrame:
    """``path, score``: the ``k`` best files by rank of meaning and of words.

    ``best``: path, cosine of its best chunk; ``lexical``: path, score of its words.  The
    place by cosine (ties by path) counts ``semantic / (60 + place)``, the competition
    rank of a positive word score ``words / (60 + rank)``, and kinds of file the terms do
    not name are demoted.  Places come from range partitions, so no task sees every file.
    """
    placed = numbered(best.where(F.col(path).isNotNull()).select(path, "cosine"), [], [F.desc("cosine"), F.col(path)], "_s")
    held = lexical.where(F.col(path).isNotNull()).groupBy(path).agg(fixed(F.max("score")).alias("_lex")).where("_lex > 0")
    ranks = competition_ranks(held, "_lex").select(path, F.col("rank").alias("_l"))
    fused = F.lit(semantic) / (RRF_K + F.col("_s")) + F.coalesce(F.lit(words) / (RRF_K + F.col("_l")), F.lit(0.0))
    scored = placed.join(ranks, path, "left").select(path, (fused * P.demotion(F.col(path), terms)).alias("score"))
    return scored.orderBy(F.desc("score"), path).limit(k)


def fit_budget(items: DataFrame, group: str, order: str, budget: int, levels: list[str]) -> DataFrame:
    """``group, order, level``: how far each item of a list can be shown (-1: not at all).

    All items in order at the first level, then each in order at the next, and so on,
    stopping at the first step that would exceed the budget (bytes / 4).  ``levels``
    name columns of sizes; a null size is 0.  The steps are rows of a running sum per
    list, so lists of any number are fitted at once.
    """
    size = [F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in levels]
    steps = F.array(*[F.struct(F.lit(i).alias("k"), (x - (size[i - 1] if i else F.lit(0))).alias("grow")) for i, x in enumerate(size)])
    every = items.select(group, order, F.explode(steps).alias("s")).select(group, order, "s.*")
    w = Window.partitionBy(group).orderBy("k", order).rowsBetween(Window.unboundedPreceding, 0)
    used = every.withColumn("_u", F.ceil(F.sum("grow").over(w) / 4)).withColumn("_most", F.max("_u").over(w))
    shown = used.groupBy(group, order).agg(F.max(F.when(F.col("_most") <= budget, F.col("k"))).alias("k"))
    return shown.select(group, order, F.coalesce("k", F.lit(-1)).alias("level"))


def crux_lines(body: Column, threshold: int = 3) -> Column:
    """``array<struct<line, text>>`` of a body's guards, bails and mutations (3 each)."""
    # Words that mark a guard, a way out and a change
    guard = r"if |else if|while |for |match |catch|when |guard|assert|check|ensure|validate"
    bail = r"return |break;|continue;|throw |panic!|unwrap|expect|abort|exit\(|\?$"
    change = r"=|return |push|insert|remove|set|append"
    lines = F.transform(F.split(body, "\n"), lambda s, i: F.struct((i + 1).alias("line"), F.trim(s).alias("text")))
    point = lambda s, p: F.when(s.rlike(p), 3).otherwise(0)
    skip = lambda s: (s == "") | s.rlike(r"^[{}]+$") | s.rlike(r'^(?://|#|")')
    return F.filter(lines, lambda x: ~skip(x["text"]) & (point(x["text"], guard) + point(x["text"], bail) + point(x["text"], change) >= threshold))


def test_penalty(path: Column, terms: list[str], factor: float = 0.5) -> Column:
    """The factor for test files, unless the task is about tests."""
    about = set(terms) & {"test", "tests", "testing", "spec", "specs"}
    return F.lit(1.0) if about else F.when(P.is_test_path(path), factor).otherwise(1.0)
