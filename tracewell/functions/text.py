"""Text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.session import blank_to_null  # noqa: F401  (part of this module's surface)


def split_ident_words(name: Column) -> Column:
    """Lower-case words of an identifier: camel humps, acronyms and ``_ - . : #``."""
    humps = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^_\-.:#])(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.transform(F.split(humps, r"[_\-.:#]+"), F.lower), lambda w: w != "")


def nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def norm(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    # ASCII is in normal form already and never leaves the JVM
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(norm(text))


def normalize(text: Column, unicode_form: bool = False) -> Column:
    """Lower case, single blanks, no ASCII punctuation at the ends; NFC on demand."""
    t = F.regexp_replace(F.lower(nfc(text) if unicode_form else text), r"\s+", " ")
    return F.regexp_replace(t, r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")


def concept_words(norm: Column) -> Column:
    """Distinct words of at least two bytes, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(norm), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 2))


def tokens(text: Column) -> Column:
    """ASCII word tokens of a lower-cased text, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: w != "")


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct n-character windows of the lower-cased text with single blanks; a
    shorter text is its own gram."""
    t = F.regexp_replace(F.lower(text), r"\s+", " ")
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller set."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def relevance_of(text: Column, units: list[str]) -> Column:
    """Non-overlapping occurrences of all units, case folded."""
    low, total = F.lower(text), F.lit(0)
    for u in units:
        needle = u.lower()
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(needle)))) / len(needle)).cast("int")
    return total.cast("long")


def word_matches(word: Column, keyword: Column) -> Column:
    """Equal, or one a prefix of the other with the shorter at least four
    characters and half the longer."""
    short = F.when(F.length(word) <= F.length(keyword), word).otherwise(keyword)
    long = F.when(F.length(word) <= F.length(keyword), keyword).otherwise(word)
    return (word == keyword) | ((F.length(short) >= 4) & long.startswith(short) & (F.length(short) * 2 >= F.length(long)))


def window_around(text: Column, needle: str, before: int = 20, after: int = 120) -> Column:
    """The text around the first occurrence of ``needle``, cut ends marked by an
    ellipsis; null without one.  Counts characters, not bytes."""
    at = F.instr(F.lower(text), needle.lower())
    start, end = F.greatest(at - before, F.lit(1)), F.least(at + after, F.length(text) + 1)
    body = F.substr(text, start, end - start)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, cut)


def snippet_around(text: Column, needle: str, around: int = 120) -> Column:
    """``struct<snippet, truncated>``: the match with ``around`` characters on both sides."""
    at = F.instr(text, needle)
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(needle) + around, F.length(text) + 1)
    return F.when(at > 0, F.struct(F.substr(text, start, end - start).alias("snippet"), ((start > 1) | (end <= F.length(text))).alias("truncated")))


def normalize_message(message: Column) -> Column:
    """An error message without its volatile parts: URLs, ISO times, hex runs of eight
    or more, numbers of five to seven digits; single blanks."""
    def word(w: Column) -> Column:
        tail = F.regexp_extract(w, r"([.,)'\"]*)$", 1)
        spans = F.regexp_replace(w, r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8,}(?![\p{L}\p{N}])", "<hex>")
        spans = F.regexp_replace(spans, r"(?<![0-9A-Fa-f])[0-9]{5,7}(?![\p{L}\p{N}])", "<num>")
        iso = (F.length(w) >= 16) & w.rlike(r"^[0-9]{4}-[0-9]{2}-") & w.contains(":")
        return F.when(w.rlike(r"^https?://"), F.concat(F.lit("<url>"), tail)).when(iso, "<ts>").otherwise(spans)

    return F.trim(F.array_join(F.transform(F.split(message, r"\s+"), word), " "))


def top_app_frames(frames: Column) -> Column:
    """The first three ``file:line`` of application frames (``array<struct<file, line>>``)."""
    app = F.filter(
        frames,
        lambda f: (f["file"] != "") & ~f["file"].contains("node_modules") & ~f["file"].startswith("node:") & ~f["file"].startswith("bun:"),
    )
    return F.transform(F.slice(F.coalesce(app, F.array().cast("array<struct<file:string,line:int>>")), 1, 3), lambda f: F.concat_ws(":", f["file"], f["line"].cast("string")))


def dedup_hash(surface: Column, kind: Column, message: Column, frames: Column | None = None) -> Column:
    """The identity of an error: sha-256 over surface, kind, message and frames."""
    parts = [surface, F.coalesce(kind, F.lit("")), normalize_message(message)]
    head = F.concat_ws("\n", *parts)
    if frames is not None:
        tops = top_app_frames(frames)
        head = F.concat(head, F.array_join(F.transform(tops, lambda s: F.concat(F.lit("\n"), s)), ""))
    return F.sha2(head, 256)


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4)


def read_tokens(size: Column) -> Column:
    return F.floor(size / 4)


def saved_percent(full: Column, answer: Column) -> Column:
    """Whole percent saved; null where nothing is saved or there was nothing to read."""
    return F.when((full > 0) & (answer < full), F.round((full - answer) * 100 / full).cast("long"))


def savings_ratio(snippet: Column, pool: Column) -> Column:
    """1 - snippet / pool within 0..1; null for an empty pool."""
    return F.when(pool != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - snippet / pool)))


def cap_text(text: Column, cap: int) -> Column:
    """``struct<text, truncated>``: at most ``cap`` bytes, cut between characters."""
    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t.encode()[:cap].decode(errors="ignore"), na_action="ignore")

    long = F.octet_length(text) > cap
    ascii_ = F.octet_length(text) == F.length(text)
    kept = F.when(~long, text).when(ascii_, F.substring(text, 1, cap)).otherwise(cut(text))
    return F.struct(kept.alias("text"), long.alias("truncated"))


def derive_title(text: Column, cap: int = 120) -> Column:
    """The first non-blank line, trimmed, at most ``cap`` characters."""
    line = F.get(F.filter(F.split(text, r"\r?\n"), lambda s: F.trim(s) != ""), F.lit(0))
    return F.substring(F.trim(F.coalesce(line, F.lit(""))), 1, cap)


def phrase_removed_between(before: Column, after: Column, units: list[str]) -> Column:
    """The first unit found in ``before`` and no longer in ``after``, case folded."""
    out = F.lit(None).cast("string")
    for u in reversed([u for u in units if u]):
        out = F.when(F.lower(before).contains(u.lower()) & ~F.lower(after).contains(u.lower()), F.lit(u)).otherwise(out)
    return out


def phrase_outside_comment(text: Column, phrase: str) -> Column:
    return F.exists(F.split(text, r"\r?\n"), lambda s: s.contains(phrase) & ~F.ltrim(s).rlike(r"^(?://|#)"))


def string_worth_indexing(text: Column) -> Column:
    """At least three words and twelve characters."""
    return (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 3) & (F.length(text) >= 12)


def path_parts(path: Column) -> Column:
    """``struct<basename, dir_base>``: the last component and the one before it."""
    p = F.split(path, "/")
    return F.struct(F.element_at(p, -1).alias("basename"), F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit("")).alias("dir_base"))


def quantize(vector: Column) -> Column:
    """``struct<scale, codes>``: a vector as signed bytes, scale = max|v| / 127."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(0.0))
    codes = F.transform(vector, lambda x: F.when(scale > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int")))).otherwise(0))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def recency_score(id_: Column, max_id: Column) -> Column:
    return F.when(max_id > 0, id_ / max_id * 1e-3).otherwise(0.0)


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """``struct<low, high>`` of a share; (0, 1) without trials."""
    n = total.cast("double")
    p = successes / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    empty, mid, scale = total == 0, p + z * z / (2 * n), 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)
    return F.struct(F.when(empty, 0.0).otherwise(low).alias("low"), F.when(empty, 1.0).otherwise(high).alias("high"))


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as a signed long."""
    @F.pandas_udf("long")
    def fnv(s: pd.Series) -> pd.Series:
        def one(t: str) -> int:
            h = 0xCBF29CE484222325
            for b in t.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            return h - (1 << 64) if h >> 63 else h

        return s.map(one, na_action="ignore").astype("Int64")

    return fnv(text)


def window_ms(since: str) -> int | None:
    """``30m``, ``24h``, ``7d`` in ms; ``all`` is None."""
    if since == "all":
        return None
    m = re.fullmatch(r"(\d+)([smhdw])", since)
    if not m:
        raise ValueError(f"not a span of time: {since}")
    return int(m[1]) * {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[m[2]]


def sanitize_query(raw: str) -> list[str]:
    """Quoted phrases first, then bare terms of more than one character; an
    unterminated quote drops what stands before it."""
    units: list[str] = []
    rest = raw
    while (open_ := rest.find('"')) >= 0:
        close = rest.find('"', open_ + 1)
        if close < 0:
            rest = rest[open_:].replace('"', " ")
            break
        phrase = rest[open_ + 1 : close].strip()
        if len(phrase) > 1:
            units.append(phrase)
        rest = rest[:open_] + rest[close + 1 :]
    return units + [t for t in re.split(r"[^A-Za-z0-9_]+", rest) if len(t) > 1]


def rubric_fingerprint(context: Column, labels: Column, criteria: Column) -> Column:
    """The identity of a rubric: sha-256 over context, labels in their order and criteria
    (a map) by label; null parts count as empty."""
    pairs = F.array_sort(F.map_entries(F.coalesce(criteria, F.create_map().cast("map<string,string>"))))
    rows = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("\n")))
    names = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit("\n")))
    return F.sha2(F.concat(F.coalesce(context, F.lit("")), F.lit("\n"), F.array_join(names, ""), F.array_join(rows, "")), 256)
