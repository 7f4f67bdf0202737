"""Interval, suffix and staged joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, left_at: str, right_at: str, span: int, on: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs whose times lie within ``span`` of each other, both ends included.

    An equi-join on buckets of ``span`` width: the right side is repeated for the two
    neighbouring buckets, so no pair of rows further apart than two buckets ever
    meets.  Both time columns are whole numbers; nulls match nothing.
    """
    b = lambda c: F.floor(F.col(c) / span)
    r = right.withColumn("_b", F.explode(F.array(b(right_at) - 1, b(right_at), b(right_at) + 1)))
    joined = left.withColumn("_b", b(left_at)).join(r, ["_b", *on])
    return joined.where(F.abs(F.col(left_at) - F.col(right_at)) <= span).drop("_b")


WIDTH = 64  # lines a bucket of the interval joins holds


def _spread(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Rows repeated for every bucket of ``width`` their span touches (``_b``)."""
    ends = [F.floor(f(F.col(start), F.col(end)) / width) for f in (F.least, F.greatest)]
    return df.withColumn("_b", F.explode(F.sequence(*ends)))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs with the same key whose spans share a point, ends included.

    Spans meet in the buckets they touch, so a key with many spans is spread and only
    neighbours are compared; a pair counts in the bucket where the later one starts.
    Null ends match nothing.
    """
    joined = _spread(a, *a_span, width).join(_spread(b, *b_span, width), [*on, "_b"])
    meet = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    return joined.where(meet & (F.col("_b") == F.floor(F.greatest(a_span[0], b_span[0]) / width))).drop("_b")


def innermost(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str, ident: str, keep: list[str], width: int = WIDTH) -> DataFrame:
    """Each point with its smallest enclosing span's ``ident`` (null if none); equal
    sizes go to the later start, then the least ident.  A point meets the spans of its
    own bucket only."""
    s = _spread(spans.select(*on, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(ident).alias("_i")), "_s", "_e", width)
    hit = points.withColumn("_b", F.floor(F.col(at) / width)).join(s, [*on, "_b"], "left")
    inside = (F.col("_s") <= F.col(at)) & (F.col(at) <= F.col("_e"))
    best = F.min(F.when(inside, F.struct((F.col("_e") - F.col("_s")).alias("w"), (-F.col("_s")).alias("s"), F.col("_i").alias("i"))))
    return hit.groupBy(*keep).agg(best.alias("_b")).select(*keep, F.col("_b.i").alias(ident))


def residues(spans: DataFrame, covers: DataFrame, on: list[str], start: str, end: str) -> DataFrame:
    """``on, span_start, span_end, start, end``: what of each span no cover touches.

    Covers are clipped to the span and the gaps read off the running greatest end;
    a sentinel after the span closes the last gap.
    """
    key = [*on, "span_start", "span_end"]
    s = spans.select(*on, F.col(start).alias("span_start"), F.col(end).alias("span_end")).distinct()
    c = overlapping(s, covers.select(*on, F.col(start).alias("_s"), F.col(end).alias("_e")), on, ("span_start", "span_end"), ("_s", "_e"))
    marks = c.select(*key, "_s", "_e").unionByName(s.select(*key, (F.col("span_end") + 1).alias("_s"), (F.col("span_end") + 1).alias("_e")))
    w = Window.partitionBy(*key).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.withColumn("start", F.greatest(F.coalesce(F.max("_e").over(w) + 1, F.col("span_start")), F.col("span_start"))).withColumn("end", F.least(F.col("_s") - 1, F.col("span_end")))
    return gaps.where("start <= end").select(*key, "start", "end")


#: reasons by priority
REASONS = ["same-file", "call-edge", "import-adjacency", "same-name"]


def conflicts(regions: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``uid, reason, with, others``: what each region (uid, file, name) may not be
    changed apart from.

    One row per region and class instead of one per pair, so a name or file that a
    third of all regions share costs a row each: ``same-file`` and ``same-name`` name
    the file or name and count its other regions, ``import-adjacency`` the file at the
    other end of an import and its regions, ``call-edge`` the other region itself.  Two
    regions conflict exactly if a class of one holds the other.  ``calls``: caller,
    callee; ``imports``: importer, imported.  Null names and files join nothing.
    """
    r = regions.select("uid", "file", "name").distinct()

    def shared(col: str, reason: str) -> DataFrame:
        size = r.groupBy(col).agg((F.count("*") - 1).alias("others")).where("others > 0")
        return r.join(size, col).select("uid", F.lit(reason).alias("reason"), F.col(col).alias("with"), "others")

    both = lambda df, x, y: df.select(x, y).unionByName(df.select(F.col(y).alias(x), F.col(x).alias(y))).where(F.col(x) != F.col(y)).distinct()
    known = r.select("uid")
    call = both(calls, "caller", "callee").join(known.withColumnRenamed("uid", "caller"), "caller", "left_semi").join(known.withColumnRenamed("uid", "callee"), "callee", "left_semi")
    called = call.select(F.col("caller").alias("uid"), F.lit("call-edge").alias("reason"), F.col("callee").alias("with"), F.lit(1).cast("long").alias("others"))
    sizes = r.groupBy("file").agg(F.count("*").alias("others"))
    near = both(imports, "importer", "imported").join(sizes.withColumnRenamed("file", "imported"), "imported")
    imported = r.join(near.withColumnRenamed("importer", "file"), "file").select("uid", F.lit("import-adjacency").alias("reason"), F.col("imported").alias("with"), "others")
    return shared("file", "same-file").unionByName(called).unionByName(imported).unionByName(shared("name", "same-name"))


def sink_matches(errors: DataFrame, concepts: list[str], text: str) -> Column:
    """The concepts (a query's few candidates) a text holds."""
    held = F.array(*[F.when(F.col(text).contains(c), F.lit(c)) for c in concepts]) if concepts else F.array().cast("array<string>")
    return F.filter(held, lambda c: c.isNotNull())


def link_parents(rows: DataFrame, group: list[str], source_id: str, parent_source_id: str, ident: str) -> DataFrame:
    """Add ``parent``: the ident of the row of the same group with that source id."""
    up = rows.select(*group, F.col(source_id).alias("_p"), F.col(ident).alias("parent")).groupBy(*group, "_p").agg(F.min("parent").alias("parent"))
    cond = F.col(parent_source_id) == F.col("_p")
    for g in group:
        cond = cond & F.col(f"c.{g}").eqNullSafe(F.col(f"u.{g}"))
    return rows.alias("c").join(up.alias("u"), cond, "left").select("c.*", "parent")


def resolve_suffix(specs: DataFrame, files: DataFrame, spec: str, importer: str, path: str) -> DataFrame:
    """``importer, spec, target``: the file an import names, matched on its last
    component and then on the longest common suffix; a tie goes to the file that
    shares the longest prefix with the importer, then to the least path.

    The last component is the join key, so a spec meets only files of that name.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    f = files.select(F.col(path).alias("_path")).distinct().withColumn("_k", stem(F.col("_path")))
    s = specs.select(importer, spec).distinct().withColumn("_k", stem(F.col(spec)))
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    hit = s.join(f, "_k").where((bare(F.col("_path")) == bare(F.col(spec))) | bare(F.col("_path")).endswith(F.concat(F.lit("/"), bare(F.col(spec)))))
    a, b = F.split(F.col(importer), "/"), F.split("_path", "/")
    shared = F.aggregate(F.sequence(F.lit(0), F.least(F.size(a), F.size(b)) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))
    best = hit.groupBy(importer, spec).agg(F.min(F.struct((-shared).alias("s"), F.col("_path").alias("p"))).alias("b"))
    return best.select(importer, spec, F.col("b.p").alias("target"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``id, dst, tier`` for call sites (id, file, name): a symbol of the same file
    (exact), of exactly one imported file (exact), unique in the repository
    (probable); sites none of it settles are left out.

    ``symbols``: sid, file, name; ``imports``: importer, imported.  Three joins on the
    name; the counts per name are made before the join, so common names cost one row.
    """
    per_file = symbols.groupBy("file", "name").agg(F.min("sid").alias("sid"), F.count("*").alias("n"))
    t0 = calls.join(per_file, ["file", "name"]).select("id", F.col("sid").alias("d0"))
    via = calls.join(imports.distinct(), F.col("file") == F.col("importer")).select("id", F.col("imported").alias("file"), "name").join(per_file, ["file", "name"])
    t1 = via.groupBy("id").agg(F.min("sid").alias("d1"), F.count("*").alias("n")).where("n = 1").drop("n")
    unique = per_file.groupBy("name").agg(F.min("sid").alias("d2"), F.sum("n").alias("n")).where("n = 1").drop("n")
    found = calls.select("id", "name").join(t0, "id", "left").join(t1, "id", "left").join(unique, "name", "left")
    exact = F.coalesce("d0", "d1")
    return found.select("id", F.coalesce(exact, F.col("d2")).alias("dst"), F.when(exact.isNotNull(), "exact").otherwise("probable").alias("tier")).where("dst IS NOT NULL")


def fan_out(members: dict[str, DataFrame], operator) -> DataFrame:
    """One operator over several repositories, rows tagged with ``repo``."""
    parts = [operator(df).withColumn("repo", F.lit(name)) for name, df in sorted(members.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
