"""Parent-child rows to whole hierarchies.

Level-wise frontier joins run from the roots; what they never reach hangs on a
circle.  Reached rows leave the child table after each batch of levels, so deep,
thin chains join ever smaller tables and the total read stays near one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.orphans import heavy_keys
from tracewell.session import cut, drop

LEVELS = 6  # levels joined per job


def hierarchy(nodes: DataFrame, key: str, parent: str, paths: bool = True) -> DataFrame:
    """``id, root_id, depth, on_circle[, path]`` for every distinct ``key``.

    ``nodes`` holds one standing row per key (see :func:`tracewell.session.standing`);
    a null or empty ``parent`` means none, a parent without a row makes its child
    a root.  ``path`` runs from the root to the node.  A node whose links upward
    never end gets depth -1, the least id (byte order) of its circle as root and
    a null path; ``on_circle`` tells the circle's own nodes from those that hang
    on it.  Null keys are dropped; an empty table gives an empty result.
    """
    pairs = cut(
        nodes.select(F.col(key).cast("string").alias("id"), F.when(F.col(parent) != "", F.col(parent).cast("string")).alias("parent")).where("id IS NOT NULL")
    )
    linked = pairs.where("parent IS NOT NULL").join(pairs.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")
    left = cut(linked)
    start = pairs.join(left.select("id"), "id", "left_anti").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    if paths:
        start = start.withColumn("path", F.array("id"))
    frontier = cut(start)
    reached = [frontier]
    # a parent of more than 1/64 of all children (fewer than 64 of them) is met in pieces:
    # its children carry a salt, and its row is repeated for each
    hot = heavy_keys(left, "parent")
    pieces = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        # a row follows one way down, level by level; every node on it is found
        at = frontier.withColumnRenamed("id", "c0")
        for k in range(1, LEVELS + 1):
            step, match = left.select(F.col("id").alias(f"c{k}"), F.col("parent").alias("_p")), F.col(f"c{k - 1}") == F.col("_p")
            if hot:
                salts = F.when(F.col(f"c{k - 1}").isin(hot), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
                at = at.withColumn("_s", F.explode(salts))
                step = step.withColumn("_t", F.when(F.col("_p").isin(hot), F.pmod(F.xxhash64(f"c{k}"), F.lit(pieces))).otherwise(0).cast("int"))
                match = match & (F.col("_s") == F.col("_t"))
            at = at.join(step, match, "left").drop("_p", "_s", "_t")
        hop = [F.struct(F.col(f"c{k}").alias("id"), (F.col("depth") + k).alias("depth"), F.lit(k == LEVELS).alias("edge"), *([F.concat("path", F.array(*[f"c{i}" for i in range(1, k + 1)])).alias("path")] if paths else [])) for k in range(1, LEVELS + 1)]
        ways = at.select("root_id", F.explode(F.filter(F.array(*hop), lambda h: h["id"].isNotNull())).alias("h"))
        # the same expressions in every batch: compiled once, whatever the depth
        found = cut(ways.select("h.id", "root_id", "h.depth", "h.edge", *(["h.path"] if paths else [])).dropDuplicates(["id"]))
        reached.append(found.drop("edge"))
        rest = cut(left.join(found.select("id"), "id", "left_anti"))
        drop(left)
        left, frontier = rest, found.where("edge").drop("edge")
        if frontier.isEmpty():
            break
    out = reduce(DataFrame.unionByName, reached).withColumn("on_circle", F.lit(False))
    caught = circles(left)
    if paths:
        caught = caught.withColumn("path", F.lit(None).cast("array<string>"))
    return out.unionByName(caught.select(*out.columns))


def circles(rest: DataFrame) -> DataFrame:
    """Nodes whose parents all lie in ``rest`` too: each leads onto a circle.

    Pointers double, so a circle of n nodes takes log2(n) joins: after them every
    pointer rests on the circle and carries the least id of a stretch at least as
    long as the circle.
    """
    n, span = rest.count(), 1
    at = rest.select("id", F.col("parent").alias("ptr"), F.col("id").alias("low"))
    step = 0
    while span < n:
        a, b = at.alias("a"), at.alias("b")
        at = a.join(b, F.col("a.ptr") == F.col("b.id")).select("a.id", F.col("b.ptr").alias("ptr"), F.least("a.low", "b.low").alias("low"))
        span, step = span * 2, step + 1
        if step % 2 == 0:
            at = cut(at)
    if n:
        at = cut(at)
    lows = at.select(F.col("id").alias("ptr"), F.col("low").alias("root_id"))
    ring = at.select(F.col("ptr").alias("id")).distinct().withColumn("on_circle", F.lit(True))
    return (
        at.select("id", "ptr")
        .join(lows, "ptr")
        .join(ring, "id", "left")
        .select("id", "root_id", F.lit(-1).alias("depth"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"))
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for every pair on a path (circles have none)."""
    up = tree.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return up.where("pos < depth").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def caught_descendants(tree: DataFrame, nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``ancestor, descendant, distance`` for the nodes of ``tree`` that hang on a circle or lie on it.

    The way up from such a node runs into its circle and once around it; each node on
    it counts once, at its first place, and none is its own ancestor.  Ways double, so
    a way of n nodes takes log2(n) joins; what has come around is left as it is.
    """
    caught = tree.where("depth < 0").select("id")
    links = nodes.select(F.col(key).cast("string").alias("id"), F.col(parent).cast("string").alias("up")).join(caught, "id", "left_semi")
    ways = cut(links.select("id", F.array("up").alias("way"), (F.col("id") == F.col("up")).alias("done")))
    while not ways.where("NOT done").isEmpty():
        on = ways.select(F.col("id").alias("_l"), F.col("way").alias("_w"), F.col("done").alias("_d"))
        longer = ways.where("NOT done").withColumn("_l", F.element_at("way", -1)).join(on, "_l").select("id", F.concat("way", "_w").alias("_r"), F.array_distinct(F.concat("way", "_w")).alias("way"), "_d")
        done = F.col("_d") | (F.size("way") < F.size("_r")) | F.array_contains("way", F.col("id"))
        ways = cut(ways.where("done").unionByName(longer.select("id", "way", done.alias("done"))))
    up = ways.select(F.col("id").alias("descendant"), F.posexplode(F.array_except("way", F.array("id"))).alias("pos", "ancestor"))
    return up.select("ancestor", "descendant", (F.col("pos") + 1).alias("distance"))
