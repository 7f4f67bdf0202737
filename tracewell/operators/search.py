"""Inverted gram index and verified content search.

A pattern is planned on the driver into a boolean tree over grams that every match
must satisfy; the tree is evaluated per document in one pass over the postings of
the query's grams (a bounded list), and the survivors are verified line by line.
"""

from __future__ import annotations

import binascii
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser as sre

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
BLOCK = 65_536  # documents per posting block
EXACT_CAP, CLASS_CAP = 64, 4  # alternatives kept while planning, characters of a class


# -- grams -----------------------------------------------------------------------------


def windows(text: Column, n: int) -> Column:
    """Every n-character window, in order; linear in the text.

    A look-ahead matches at every place, which is compiled; it would also match between
    the halves of a character beyond the basic plane, so texts that hold one are cut
    into an array of characters first (positions in a UTF-8 string are not constant time).
    """
    c = F.split(text, "")
    out = c
    for k in range(1, n):
        out = F.zip_with(out, F.slice(c, k + 1, F.length(text)), lambda a, b: F.concat(a, b))
    by_character = F.filter(out, lambda g: g.isNotNull())
    wide = text.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(wide, by_character).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct n-character windows of the lower-cased text; none of a shorter text."""
    t = F.lower(text)
    return F.when(F.length(t) >= n, F.array_distinct(windows(t, n))).otherwise(F.array().cast("array<string>"))


def pair_weight(pair: bytes) -> int:
    return binascii.crc32(pair)


def sparse_spans(data: bytes, least: int = 3, most: int = 100) -> list[tuple[int, int]]:
    """Spans whose two border pairs outweigh every pair between them, by one
    monotone stack over the weights of all byte pairs; ``end`` is exclusive."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, int]] = []
    for j in range(len(data) - 1):
        w = pair_weight(data[j : j + 2])
        while stack:
            i, wi = stack[-1]
            if least <= j + 2 - i <= most:
                out.append((i, j + 2))
            if wi > w:
                break
            stack.pop()
            if wi == w:
                break
        stack.append((j, w))
    return sorted(set(out))


def covering(data: bytes) -> list[bytes]:
    """Sparse grams that cover a literal: longest first, spans inside a kept one dropped."""
    kept: list[tuple[int, int]] = []
    for a, b in sorted(sparse_spans(data), key=lambda s: (s[0] - s[1], s[0])):
        if not any(x <= a and b <= y for x, y in kept):
            kept.append((a, b))
    return [data[a:b] for a, b in sorted(kept)]


def sparse_grams(text: Column) -> Column:
    """``array<struct<gram, start>>`` of a text's sparse grams (a stack needs Python)."""
    @F.pandas_udf("array<struct<gram string, start int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: [{"gram": t.encode()[a:b].decode(errors="replace"), "start": a} for a, b in sparse_spans(t.encode())] if t else [])

    return run(text)


# -- index ------------------------------------------------------------------------------


def postings(docs: DataFrame, key: str, text: str, extract=grams) -> DataFrame:
    """``gram, block, docs``: sorted document ids per gram and block of ``BLOCK`` ids, so
    no gram gathers more than a block in one row however common it is."""
    pairs = docs.select(F.col(key).cast("long").alias("doc"), F.explode(extract(F.col(text))).alias("gram"))
    return pairs.groupBy("gram", F.floor(F.col("doc") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("doc")).alias("docs"))


BUCKETS = 64
MASK = 62  # grams a long holds a bit for
INDEX = "gram string, block long, docs array<long>, bucket int"


def bucket_of(gram: str, buckets: int = BUCKETS) -> int:
    """The folder a gram's postings are in; the driver's side of ``crc32 % buckets``."""
    return binascii.crc32(gram.encode()) % buckets


def write_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Postings as Parquet, a folder per gram hash and sorted by gram in it, so a lookup
    reads a few folders and in them few row groups."""
    p = postings(docs, key, text).withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int"))
    p.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark, path: str, wanted: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of the given grams; partition and row-group pruning do the rest."""
    # only the folders that can hold them are even listed
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [b for b in sorted({bucket_of(g, buckets) for g in wanted}) if fs.exists(root.suffix(f"/bucket={b}"))]
    read = spark.read.schema(INDEX).option("basePath", path)
    return read.parquet(*[f"{path}/bucket={b}" for b in there]).where(F.col("gram").isin(wanted)) if there else read.parquet(path).where("false")


def candidate_count(post: DataFrame, wanted: list[str]) -> int | None:
    """Postings of the rarest gram: an upper bound of the candidates; None without grams."""
    if not wanted:
        return None
    sizes = {r["gram"]: r["n"] for r in post.where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum(F.size("docs")).alias("n")).collect()}
    return min(sizes.get(g, 0) for g in wanted)


def layered(base: DataFrame, delta: DataFrame, tombstones: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """base with delta's newer rows, less tombstones, under the overlay: the newest
    layer of a key wins, and a tombstone hides base and delta only."""
    tag = lambda df, n: df.withColumn("_layer", F.lit(n))
    buried = tombstones.select(key).distinct()
    lower = tag(base, 0).unionByName(tag(delta, 1)).join(buried, key, "left_anti")
    every = lower.unionByName(tag(overlay, 2).select(*lower.columns))
    rest = [c for c in every.columns if c not in (key, "_layer")]
    top = every.groupBy(key).agg(F.max(F.struct("_layer", *rest)).alias("_r"))
    return top.select(key, *[F.col("_r")[c].alias(c) for c in rest])


def overlay_full(overlay: DataFrame, tombstones: DataFrame, files: int = 1000, dead: int = 5000) -> bool:
    """Whether an overlay has outgrown its caps and is due to be folded into the base; no row
    is dropped either way."""
    return overlay.limit(files + 1).count() > files or tombstones.limit(dead + 1).count() > dead


class Segments:
    """An index in append-only segments at ``path``: each append writes one, small ones are
    merged, and one manifest, replaced in a step, says which ones count."""

    def __init__(self, spark, path: str):
        from tracewell.streaming.feed import Store

        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, f"{path.rstrip('/')}/manifest")

    def _listed(self) -> list[dict]:
        return (self.store.read("segments") or {"segments": []})["segments"]

    def append(self, docs: DataFrame, key: str, text: str) -> None:
        """Index documents not indexed before (ids grow, none comes twice)."""
        data = f"{self.path}/{uuid.uuid4().hex}"
        postings(docs, key, text).write.parquet(data)
        self.store.write("segments", {"segments": [*self._listed(), {"data": data, "docs": docs.select(key).count()}]})

    def merge(self, small: int) -> int:
        """Merge the segments of fewer than ``small`` documents into one; how many."""
        listed = self._listed()
        few = [x for x in listed if x["docs"] < small]
        if len(few) < 2:
            return 0
        every = self.spark.read.parquet(*[x["data"] for x in few])
        data = f"{self.path}/{uuid.uuid4().hex}"
        every.groupBy("gram", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs")).write.parquet(data)
        self.store.write("segments", {"segments": [*[x for x in listed if x not in few], {"data": data, "docs": sum(x["docs"] for x in few)}]})
        return len(few)

    def postings(self) -> DataFrame | None:
        listed = self._listed()
        return self.spark.read.parquet(*[x["data"] for x in listed]) if listed else None


# -- planning -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """``all`` matches anything; ``gram`` needs one gram; and/or combine parts."""

    op: str
    gram: str = ""
    parts: tuple[Plan, ...] = ()

    def grams(self) -> list[str]:
        return [self.gram] if self.op == "gram" else sorted({g for p in self.parts for g in p.grams()})

    def holds(self, has) -> Column:
        """The plan as a condition, given a condition per gram."""
        if self.op == "gram":
            return has(self.gram)
        out = F.lit(self.op != "or")
        for p in self.parts:
            out = (out & p.holds(has)) if self.op == "and" else (out | p.holds(has))
        return out


ALL = Plan("all")


def _combine(op: str, parts: list[Plan]) -> Plan:
    if op == "or" and any(p.op == "all" for p in parts):
        return ALL
    flat: list[Plan] = []
    for p in parts:
        if p.op == "all":
            continue
        for q in p.parts if p.op == op else (p,):
            if q not in flat:
                flat.append(q)
    if not flat:
        return ALL
    return flat[0] if len(flat) == 1 else Plan(op, parts=tuple(sorted(flat, key=repr)))


def _literal(text: str) -> Plan:
    t = text.lower()
    return _combine("and", [Plan("gram", t[i : i + GRAM]) for i in range(len(t) - GRAM + 1)])


def _walk(tree) -> tuple[set[str] | None, Plan]:
    """(exact alternatives or None, plan) of a parsed pattern; sound, not complete."""
    exact: set[str] | None = {""}
    plans: list[Plan] = []

    def flush() -> None:
        nonlocal exact
        if exact is not None:
            plans.append(_combine("or", [_literal(s) for s in sorted(exact)]))
        exact = {""}

    def append(more: set[str] | None, plan: Plan) -> None:
        nonlocal exact
        if more is not None and exact is not None and len(exact) * len(more) <= EXACT_CAP:
            exact = {a + b for a in exact for b in more}
            return
        flush()
        if more is None:
            plans.append(plan)
        else:
            exact = set(more)

    broken = False
    for op, arg in tree:
        if op is K.LITERAL:
            append({chr(arg)}, ALL)
        elif op is K.IN and len(arg) <= CLASS_CAP and all(o is K.LITERAL for o, _ in arg):
            append({chr(a) for _, a in arg}, ALL)
        elif op is K.SUBPATTERN:
            append(*_walk(arg[3]))
        elif op is K.BRANCH:
            both = [_walk(b) for b in arg[1]]
            if all(e is not None for e, _ in both) and sum(len(e) for e, _ in both) <= EXACT_CAP:
                append({s for e, _ in both for s in e}, ALL)
            else:
                append(None, _combine("or", [p for _, p in both]))
                broken = True
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            least, most, body = arg
            e, p = _walk(body)
            if least == most == 1:
                append(e, p)
            elif (least, most) == (0, 1) and e is not None and len(e) < EXACT_CAP:
                append(e | {""}, ALL)
            else:
                append(None, p if least else ALL)
                broken = True
        elif op is K.AT:
            continue
        else:
            append(None, ALL)
            broken = True
    if not broken and not plans and exact is not None:
        return exact, _combine("or", [_literal(s) for s in sorted(exact)])
    flush()
    return None, _combine("and", plans)


def plan_pattern(pattern: str) -> Plan:
    """The gram plan of a regular expression; ``ALL`` where nothing can be required.
    Grams are lower case, so the plan serves case-sensitive and -insensitive search."""
    return _walk(sre.parse(pattern))[1]


def candidates(post: DataFrame, plan: Plan) -> DataFrame | None:
    """``doc`` of the documents that satisfy the plan; None for ``ALL``.

    One pass: a document's set of query grams (bounded by the query) is gathered
    with map-side combining and the boolean tree is evaluated on it.
    """
    wanted = plan.grams()
    if not wanted:
        return None
    # a bit per gram, looked up once a posting row; MASK bits a column
    cols = range(-(-len(wanted) // MASK))
    bits = [F.create_map(*[x for i, g in enumerate(wanted[c * MASK : (c + 1) * MASK]) for x in (F.lit(g), F.lit(1 << i).cast("long"))]) for c in cols]
    hit = post.where(F.col("gram").isin(wanted)).select(F.explode("docs").alias("doc"), *[F.coalesce(F.try_element_at(m, F.col("gram")), F.lit(0).cast("long")).alias(f"m{c}") for c, m in enumerate(bits)])
    flags = hit.groupBy("doc").agg(*[F.bit_or(f"m{c}").alias(f"m{c}") for c in cols])

    def has(gram: str) -> Column:
        i = wanted.index(gram)
        return F.col(f"m{i // MASK}").bitwiseAND(F.lit(1 << i % MASK).cast("long")) != 0

    return flags.where(plan.holds(has)).select("doc")


# -- search -----------------------------------------------------------------------------


def lines_matching(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """``key, line, content`` of every line that matches; a text stops at its first NUL.
    Java's dialect: keep to the subset the planner's parser shares."""
    body = F.substring_index(F.col(text), "\0", 1)
    # the anchors of a line hold inside the text only with (?m); those of the text, and
    # what looks around, mean another place in a line than in the whole
    whole = not re.search(r"\\[AZzGbB]|\(\?<?[=!]|\(\?[a-z]*-", pattern)
    some = docs.where(F.col(text).rlike(f"(?m){pattern}")) if whole else docs
    lines = some.select(key, F.posexplode(F.split(body, "\n")).alias("_i", "content"))
    return lines.where(F.col("content").rlike(pattern)).select(key, (F.col("_i") + 1).alias("line"), "content")


def search(docs: DataFrame, key: str, text: str, pattern: str, post: DataFrame | str | None = None, where: Column | None = None) -> DataFrame:
    """Verified matches; ``post`` (postings, or the folder :func:`write_index` wrote)
    narrows the documents first, ``where`` is applied before anything is read of the
    text."""
    if where is not None:
        docs = docs.where(where)
    plan = plan_pattern(pattern) if post is not None else ALL
    if isinstance(post, str):
        post = read_postings(docs.sparkSession, post, plan.grams())
    found = candidates(post, plan) if post is not None else None
    if found is not None:
        docs = docs.join(found.select(F.col("doc").alias(key)), key, "left_semi")
    return lines_matching(docs, key, text, pattern)


def page(matches: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page in a total order, with ``truncated``: whether anything follows it."""
    top = matches.orderBy(*order).limit(offset + limit + 1)
    w = Window.orderBy(*order)  # over at most offset + limit + 1 rows
    numbered = top.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(1))))
    return numbered.where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).withColumn("truncated", F.col("_all") > offset + limit).drop("_n", "_all")


def units_match(post: DataFrame, units: list[str]) -> DataFrame | None:
    """Documents with every gram of any unit; units under three characters say
    nothing, and without a longer one the answer is None."""
    long = [u for u in units if len(u) >= GRAM]
    if not long:
        return None
    return candidates(post, _combine("or", [_literal(u) for u in long]))


def containing_units(docs: DataFrame, key: str, text: str, units: list[str], post: DataFrame | None = None) -> DataFrame:
    """Documents that hold any unit of three or more characters, case folded."""
    found = units_match(post, units) if post is not None else None
    if found is not None:
        docs = docs.join(found.select(F.col("doc").alias(key)), key, "left_semi")
    hit = F.lit(False)
    for u in units:
        if len(u) >= GRAM:
            hit = hit | F.lower(text).contains(u.lower())
    return docs.where(hit)


def newest(df: DataFrame, at: str, key: str, cap: int) -> DataFrame:
    """The newest ``cap`` rows by time, then key; a top-k, not a sort of everything."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(cap)


def phrase_match(docs: DataFrame, text: str, units: list[str]) -> DataFrame:
    """Rows whose words hold every unit as a phrase of whole words, case folded."""
    spaced = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
    out = F.lit(True)
    for u in units:
        out = out & spaced.contains(f" {' '.join(u.lower().split())} ")
    return docs.where(out)
