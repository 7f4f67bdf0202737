"""Content probes, classification quality and review rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators.ordering import numbered

PROBE_BYTES = 4096
#: Credential-shaped substrings by class, and names a credential is assigned to.
SECRET_VALUES = {
    "private-key": ["-----BEGIN ", "PRIVATE KEY-----"],
    "github-token": ["ghp_", "github_pat_", "gho_", "ghu_", "ghs_", "ghr_"],
    "openai-key": ["sk-proj-", "sk-ant-", "sk-svca-"],
    "slack-token": ["xoxb-", "xoxp-", "xoxa-", "xoxr-"],
}
SECRET_NAMES = ["api_key", "api-key", "apikey", "secret", "password", "passwd", "passphrase", "credential"]


def content_kind(text: Column, path: Column) -> Column:
    """binary, minified, generated or text, from the first 4 KiB.

    NUL means binary; a mean line above 400 bytes or one above 2,000 minified;
    more than 30 % non-ASCII bytes in JSON or JavaScript generated.  Null is text.
    """
    probe = F.substring(F.coalesce(text, F.lit("")), 1, PROBE_BYTES)
    lines = F.filter(F.split(probe, "\n"), lambda s: s != "")
    sizes = F.transform(lines, F.octet_length)
    mean = F.floor(F.aggregate(sizes, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lines), F.lit(1)))
    size = F.octet_length(probe)
    foreign = (size - F.length(F.regexp_replace(probe, r"[^\x00-\x7F]", ""))) / F.greatest(size, F.lit(1))
    return (
        F.when(probe.contains("\0"), "binary")
        .when(size == 0, "text")
        .when((mean > 400) | (F.coalesce(F.array_max(sizes), F.lit(0)) > 2000), "minified")
        .when(F.lower(path).rlike(r"\.(?:json|js|mjs)$") & (foreign > 0.30), "generated")
        .otherwise("text")
    )


def generated_blob(text: Column, min_bytes: int, bytes_per_line: int) -> Column:
    """A large text with long lines throughout; both conditions must hold."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    lines = newlines + F.when(text.endswith("\n"), 0).otherwise(1)
    size = F.octet_length(text)
    return F.coalesce((size >= min_bytes) & (F.floor(size / F.greatest(lines, F.lit(1))) >= bytes_per_line), F.lit(False))


def secret_class(line: Column) -> Column:
    """The class of credential a line holds; null for none.  Values outrank names."""
    out = F.when(
        F.lower(line).rlike("|".join(SECRET_NAMES)) & (line.contains("=") | line.contains(":")),
        "credential-named-assignment",
    )
    out = F.when(line.rlike("AKIA[A-Z0-9]{16}"), "cloud-access-key").otherwise(out)
    for name, needles in reversed(SECRET_VALUES.items()):
        hit = F.lit(False)
        for n in needles:
            hit = hit | line.contains(n)
        out = F.when(hit, name).otherwise(out)
    return out


def secret_findings(lines: DataFrame, path: str, line: str, text: str) -> DataFrame:
    """``path, line, class, severity``: values are critical, named assignments medium;
    fixtures and bare literals drop a rung."""
    p, s = F.col(path), F.ltrim(F.col(text))
    name = F.substring_index(p, "/", -1)
    fixture = p.rlike(r"(?:^|/)(?:tests|fixtures|fixture)/") | name.startswith("test_") | name.rlike(r"_test\.|_tests\.|\.test\.")
    bare = ~s.contains("=") & s.rlike(r'^["(&]')
    mild = fixture | bare
    c = secret_class(F.col(text))
    strong = c != "credential-named-assignment"
    severity = F.when(strong & ~mild, "CRITICAL").when(strong | ~mild, "MEDIUM").otherwise("LOW")
    return lines.select(p.alias("path"), F.col(line).alias("line"), c.alias("class"), severity.alias("severity")).where("class IS NOT NULL")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def label_scores(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """``label, support, precision, recall, f1`` of the labels with support; 0 on an
    empty denominator.  One pass over the (small) confusion table, no self-join."""
    c = confusion(df, actual, predicted)
    both = F.array(F.struct(F.col("actual").alias("label"), F.lit("a").alias("side")), F.struct(F.col("predicted").alias("label"), F.lit("p").alias("side")))
    sides = c.select("n", (F.col("actual") == F.col("predicted")).alias("hit"), F.explode(both).alias("s")).select("n", "hit", "s.*")
    g = sides.groupBy("label").agg(
        F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("guessed"),
        F.sum(F.when((F.col("side") == "a") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    return g.where("support > 0").select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def error_curve(df: DataFrame, confidence: str, correct: str, key: str, buckets: int = 100) -> DataFrame:
    """Coverage against error as the confidence threshold falls, with Wilson bounds:
    one point per distinct confidence.  Rows are folded per confidence first, so the
    running sums run over distinct values, range partitioned."""
    per = df.groupBy(F.col(confidence).alias("threshold")).agg(F.count("*").alias("n"), F.sum((~F.col(correct)).cast("int")).alias("wrong"))
    down = [F.col("threshold").desc_nulls_last()]
    run = numbered(per, [], down, "_p", F.col("n"), "accepted").drop("_p", "n").withColumnRenamed("wrong", "_wrong")
    run = numbered(run, [], down, "_p", F.coalesce("_wrong", F.lit(0)), "wrong")
    all_ = per.agg(F.sum("n")).first()[0] or 0
    ci = T.wilson(F.col("wrong"), F.col("accepted"))
    return run.select(
        "threshold", "accepted", "wrong", F.round(F.col("accepted") / F.lit(max(1, all_)), 6).alias("coverage"), F.round(F.col("wrong") / F.col("accepted"), 6).alias("error"),
        F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"),
    )


def floor_percentile(df: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by floor index, min(floor(n f), n - 1) of the ascending values.

    Values are counted per group first; the windows run over distinct values.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("c").over(Window.partitionBy(*by))
    run = per.withColumn("upto", F.sum("c").over(w)).withColumn("n", n)
    at = lambda f: F.least(F.floor(F.col("n") * f), F.col("n") - 1)
    return run.groupBy(*by).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > at(f), F.col(value))).alias(k) for k, f in fractions.items()])


def ndcg(ranked: DataFrame, query: str, rank: str, relevant: str, k: int = 10) -> DataFrame:
    """``query, ndcg``: binary relevance at 1-based ranks up to ``k``; 0 without any relevant."""
    gain = F.when(F.col(relevant) & (F.col(rank) <= k), 1 / F.log2(F.col(rank) + 1)).otherwise(0.0)
    g = ranked.groupBy(F.col(query).alias("query")).agg(F.sum(gain).alias("dcg"), F.least(F.count_if(F.col(relevant)), F.lit(k)).alias("m"))
    ideal = F.aggregate(F.when(F.col("m") > 0, F.sequence(F.lit(1), F.col("m").cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return g.select("query", F.round(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


class Baseline:
    """A classifier to measure others against: ``predict`` adds ``predicted`` (null: it
    abstains) to rows with a text column."""

    name = "none"

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("predicted", F.lit(None).cast("string"))


class KeywordBaseline(Baseline):
    """The first label, in the given order, one of whose keywords the text holds."""

    name = "keyword"

    def __init__(self, keywords: dict[str, list[str]]):
        self.keywords = keywords

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        low, label = F.lower(text), F.lit(None).cast("string")
        for name, words in reversed(self.keywords.items()):
            hit = F.lit(False)
            for w in words:
                hit = hit | low.contains(w.lower())
            label = F.when(hit, name).otherwise(label)
        return df.withColumn("predicted", label)


class ExactLookupBaseline(Baseline):
    """The label of a stored example with the very same text (the least of several)."""

    name = "exact_lookup"

    def __init__(self, examples: DataFrame, text: str, label: str):
        self.known = examples.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).agg(F.min(label).alias("predicted"))

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        j = df.withColumn("_q", F.xxhash64(text)).join(self.known, (F.col("_q") == F.col("_h")) & (F.col(text) == F.col("_t")), "left")
        return j.drop("_q", "_h", "_t")


def baseline_scores(df: DataFrame, text: str, actual: str, baselines: list[Baseline]) -> DataFrame:
    """``baseline, rows, answered, right`` of each baseline over the same rows."""
    out = None
    for b in baselines:
        p = b.predict(df, text)
        one = p.agg(F.count("*").alias("rows"), F.count("predicted").alias("answered"), F.count_if(F.col("predicted") == F.col(actual)).alias("right")).select(F.lit(b.name).alias("baseline"), "rows", "answered", "right")
        out = one if out is None else out.unionByName(one)
    return out
