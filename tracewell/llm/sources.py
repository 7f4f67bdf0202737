"""Source files nobody wrote by hand: tool output, minified or bundled code,
third-party copies and data saved as code.

Layout statistics with thresholds per language decide on minified, tabular and
machine-numbered text; the path and comment lines add declared provenance, and
five-word shingles the copies of known third-party files.  All of it is built-in
expressions; the shingles of the known files are the only thing joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and extensions a language goes by.
ALIASES = {
    "rb": "ruby", "rs": "rust", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "py": "python", "golang": "go",
}
LANGUAGES = ["ruby", "rust", "javascript", "typescript", "python", "go"]
#: Per language: least share of white space, greatest share of digits, least and
#: greatest share of letters and digits, and longest line of hand-written text.  Go and
#: TypeScript indent less, Python and Rust more; Rust and Python carry more punctuation.
LIMITS = {
    "go": (0.09, 0.10, 0.45, 0.84, 1000), "typescript": (0.10, 0.10, 0.42, 0.84, 1200), "javascript": (0.10, 0.10, 0.42, 0.82, 1200),
    "ruby": (0.11, 0.10, 0.42, 0.83, 1000), "rust": (0.12, 0.11, 0.38, 0.80, 1000), "python": (0.12, 0.10, 0.40, 0.82, 1000),
}
OTHER_LIMITS = (0.09, 0.10, 0.38, 0.86, 1200)
SHORT = 100  # characters below which layout says nothing
LONG_MEAN = 200  # a mean line beyond this is no hand's
ENCODED_SHARE = 0.5  # share of the text in runs of 60 or more encoded characters
NUMBERED, NUMBERED_SHARE = 5, 0.3  # names numbered 0, 1, 2, ... up to here at least, on this share of the lines
LEAST_SHARED = 8  # shingles a copy shares with the known file at least
SIMILAR = 0.8
SHINGLE = 5

#: Directories third-party code is copied to, and tool output is written to.
VENDOR_DIRS = ["vendor", "vendored", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "Pods", "Carthage", "external", "deps", "site-packages", "gems"]
GENERATED_DIRS = ["gen", "generated", "__generated__", "autogen"]
GENERATED_SUFFIXES = ["pb", "gen", "tab", "generated", "g", "pb2", "pb_gw"]
GENERATED_STEMS = ["_pb2", "_pb2_grpc", "_generated", "_gen"]
#: What tools write on a comment line of their own, as a small grammar over six languages:
#: a subject that was made, a making "by itself", a making with a warning, or a tag.
_SUBJECT = r"(?:this (?:is an? )?|the )?(?:code|file|source|module|document|diese datei|dieser code|ce fichier|ce code|este (?:archivo|fichero|c[oó]digo|arquivo|ficheiro)|dit bestand)"
_BE = r"(?: (?:was|is|has been|wurde|ist|est|a été|fue|es|foi|é|is|werd))?"
_SELF = r"(?:auto|automatically|automatisch|automatiquement|automáticamente|automaticamente|machine|mechanically)"
_MADE = r"(?:generated|emitted|regenerated|erzeugt|generiert|généré|generado|gerado|gegenereerd)"
_WRITTEN = r"(?:generated|emitted|written|produced|created|built|erzeugt|generiert|erstellt|généré|produit|generado|creado|gerado|criado|gegenereerd|gemaakt)"
_BY = r"(?:by|from|with|mit|von|aus|par|de|à partir|por|con|a partir|com|door|met|uit)"
_WARN = r"(?:(?:do not|don't) (?:edit|modify|change|touch)|changes will be lost|at build time|nicht (?:bearbeiten|ändern)|ne pas (?:modifier|éditer)|no (?:editar|modificar)|não (?:editar|modificar)|niet (?:bewerken|wijzigen))"
MARKERS = "(?i)^(?:" + "|".join(
    [
        rf"@generated\b|<auto-?generated",
        rf"{_SUBJECT}{_BE}(?: {_SELF}[ -]?)? ?{_MADE}(?: {_BY}\b|[.!]? *$)",  # code generated by ..., this file was automatically generated from ...
        rf"(?:this (?:is|file is) an? )?{_SELF}[ -]?{_WRITTEN}\b",  # automatisch erzeugt, auto-generated, this is a machine-written file
        rf"{_MADE} (?:{_SELF}\b|{_BY} .*{_WARN})",  # généré automatiquement, generated from ... do not modify
        r"(?:erzeugt|generiert|généré|generado|gerado|gegenereerd) (?:mit|von|aus|par|por|con|com|door|met)\b",
        rf"{_WARN}.*{_MADE}",
    ]
) + ")"
_COMMENT = r"^\s*(?://+!?|#+|/\*+!?|\*+|--+|;+|<!--|\"\"\"|''')\s*"


def language(lang: Column, path: Column) -> Column:
    """The language a file is in: by its extension, else by its label."""
    names = F.create_map(*[F.lit(x) for kv in {**ALIASES, **{k: k for k in LANGUAGES}}.items() for x in kv])
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(names, ext), F.try_element_at(names, F.lower(F.trim(lang))), F.lit("other"))


def layout(files: DataFrame, text: str = "head") -> DataFrame:
    """Add the layout statistics of ``text`` (null counts as empty).

    ``n, max_line, mean_line, space, alnum, digits, encoded`` (share in long
    encoded runs), ``numbered`` (names numbered 0..k-1), ``numbered_lines`` (share of
    lines that hold a numbered name) and ``json_lines`` (share of lines that are a JSON
    token).
    """
    df = files.withColumn("_x", F.coalesce(F.col(text), F.lit(""))).withColumn("n", F.length("_x")).withColumn("_lines", F.split("_x", r"\r?\n"))
    n = F.greatest(F.col("n"), F.lit(1))
    share = lambda pattern: F.regexp_count("_x", F.lit(pattern)) / n
    filled = F.filter("_lines", lambda s: F.length(F.trim(s)) > 0)
    df = df.withColumn("_filled", filled).withColumns(
        {
            "max_line": F.coalesce(F.array_max(F.transform("_lines", lambda s: F.length(s))), F.lit(0)),
            "mean_line": F.col("n") / F.greatest(F.size("_filled"), F.lit(1)),
            "space": share(r"\s"),
            "alnum": share(r"[A-Za-z0-9]"),
            "digits": share(r"[0-9]"),
            "encoded": F.aggregate(F.regexp_extract_all("_x", F.lit(r"([A-Za-z0-9+/=_-]{60,})"), 1), F.lit(0), lambda a, s: a + F.length(s)) / n,
            "_ids": F.array_distinct(F.transform(F.regexp_extract_all("_x", F.lit(r"[A-Za-z]_?([0-9]{1,4})(?![0-9A-Za-z])"), 1), lambda s: s.cast("int"))),
            "numbered_lines": F.size(F.filter("_filled", lambda s: s.rlike(r"[A-Za-z]_?[0-9]{1,4}(?![0-9A-Za-z])"))) / F.greatest(F.size("_filled"), F.lit(1)),
            "json_lines": F.size(F.filter("_filled", lambda s: s.rlike(r'^\s*(?:[\[\]{}],?|"(?:[^"\\]|\\.)*"(?:\s*:\s*(?:[\[{]|"(?:[^"\\]|\\.)*"|[-0-9.eE]+|true|false|null|\[\]|\{\}))?,?|[-0-9.]+,?)\s*$')))
            / F.greatest(F.size("_filled"), F.lit(1)),
        }
    )
    first_missing = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("_ids")), F.col("_ids")))
    return df.withColumn("numbered", first_missing).drop("_x", "_ids")


def shingles(df: DataFrame, key: str, text: str, out: str = "shingles") -> DataFrame:
    """``key, out``: the distinct hashed five-word shingles of each text, as an array.

    Words and shingles are steps of their own: a step inlined into the next one's
    lambda would be evaluated anew for every shingle.
    """
    words = df.select(key, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(\w+)"), 1).alias("_w"))
    last = F.size("_w") - (SHINGLE - 1)
    at = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("_w", i, SHINGLE)))
    return words.select(key, F.when(last >= 1, F.array_distinct(at)).otherwise(F.array().cast("array<bigint>")).alias(out))


def copies(files: DataFrame, upstream: DataFrame, key: str = "path", text: str = "head") -> DataFrame:
    """``key, similarity``: files that hold, or are held by, a known file to ``SIMILAR``.

    Similarity is the greater of the two containments of five-word shingles, so
    neither a header nor local additions hide a copy; fewer than ``LEAST_SHARED``
    shingles, such as a licence line, are no copy.  Both sides are sets of
    hashes; counts are combined before any shuffle of them.
    """
    # an outer explode: from a plain one the optimizer derives a filter on the array, and
    # would evaluate the words anew for every shingle in it
    known = upstream.select(F.xxhash64("package", "version", "file_name", "hash").alias("up"), F.col(text).alias("_t"))
    theirs = shingles(known, "up", "_t").select("up", F.size("shingles").alias("size"), F.explode_outer("shingles").alias("shingle")).distinct()
    mine = shingles(files, key, text).select(key, F.size("shingles").alias("own"), F.explode_outer("shingles").alias("shingle"))
    both = mine.join(theirs, "shingle").groupBy(key, "up", "own", "size").agg(F.count("*").alias("both"))
    sim = F.when(F.col("both") >= LEAST_SHARED, F.greatest(F.col("both") / F.col("own"), F.col("both") / F.col("size")))
    return both.groupBy(key).agg(F.max(sim).alias("similarity")).where(F.col("similarity") >= SIMILAR)


def classify(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``path, generated, minified, vendored, data, by_hand`` per file.

    ``files`` has one standing row per path with ``path, lang, hash, head``.  Null
    or blank text is nobody's tool output: such a file counts as hand-written
    unless its path says otherwise.  Marker phrases count only on a comment line
    that starts with them, so code that prints or mentions them stays.
    """
    stats = layout(files.select("path", "lang", "hash", "head")).withColumn("language", language(F.col("lang"), F.col("path")))
    limit = lambda k: F.coalesce(F.try_element_at(F.create_map(*[x for n, v in LIMITS.items() for x in (F.lit(n), F.lit(v[k]))]), F.col("language")), F.lit(OTHER_LIMITS[k]))
    tall = F.col("n") >= SHORT
    marked = F.exists("_filled", lambda s: s.rlike(_COMMENT) & F.regexp_replace(s, _COMMENT, "").rlike(MARKERS))
    in_dirs = lambda names: F.col("path").rlike("/(?:" + "|".join(names) + ")/")
    suffix = F.col("path").rlike(r"(?:\.(?:" + "|".join(GENERATED_SUFFIXES) + ")|" + "|".join(GENERATED_STEMS) + r")\.[A-Za-z0-9]+$")
    odd = (F.col("alnum") < limit(2)) | (F.col("alnum") > limit(3))
    counted = (F.col("numbered") >= NUMBERED) & (F.col("numbered_lines") >= NUMBERED_SHARE)
    tabular = tall & ((F.col("digits") > limit(1)) | (F.col("encoded") > ENCODED_SHARE) | (F.col("json_lines") > 0.9) | (odd & (F.col("space") < limit(0))))
    dense = tall & ((F.col("space") < limit(0)) | (F.col("mean_line") > LONG_MEAN) | (F.col("max_line") > limit(4)) | odd)
    known = upstream.select(F.lower("hash").alias("_known")).distinct()
    judged = (
        stats.join(copies(files, upstream), "path", "left")
        .join(known, F.lower("hash") == F.col("_known"), "left")
        .select(
            "path",
            "language",
            F.coalesce(marked | in_dirs(GENERATED_DIRS) | suffix | counted, F.lit(False)).alias("generated"),
            F.coalesce((dense & ~tabular) | F.col("path").rlike(r"[.-]min\.[A-Za-z]+$"), F.lit(False)).alias("minified"),
            (F.col("similarity").isNotNull() | F.col("_known").isNotNull() | F.coalesce(in_dirs(VENDOR_DIRS), F.lit(False))).alias("vendored"),
            F.coalesce(tabular, F.lit(False)).alias("data"),
        )
    )
    return judged.withColumn("by_hand", ~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data")))
