"""Graph traversals over edges (src, dst, ...), joins only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut


def fan_in_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, fan_in``: distinct other files with an edge into a file."""
    s = symbols.select("id", "file")
    e = edges.select("src", "dst").distinct().join(s.withColumnsRenamed({"id": "dst", "file": "path"}), "dst").join(s.withColumnsRenamed({"id": "src", "file": "_from"}), "src")
    return e.where("_from <> path").select("path", "_from").distinct().groupBy("path").agg(F.count("*").alias("fan_in"))


def _turned(edges: DataFrame, upstream: bool) -> DataFrame:
    """Edges as ``at -> next`` along the walking direction, parallel ones folded: the
    best tier of each pair, 0 for exact."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    return edges.groupBy(F.col(a).alias("at"), F.col(b).alias("next")).agg(F.min(F.when(F.col("tier") == "exact", 0).otherwise(1)).alias("t"))


def hops(edges: DataFrame, seeds: DataFrame, depth: int, upstream: bool = True) -> DataFrame:
    """``seed, id, depth, tier``: nodes within ``depth`` hops of each seed, at their
    least depth; a node is exact if some shortest path is exact throughout.

    ``seeds`` has ``id``.  The depth is a query parameter, so the joins are unrolled; a
    level keeps one row per seed and node and drops what was reached before.
    """
    steps = _turned(edges, upstream)
    at = seeds.select(F.col("id").alias("seed"), "id").distinct().withColumn("t", F.lit(0))
    seen, out = at.select("seed", "id"), []
    for k in range(1, depth + 1):
        nxt = at.withColumnRenamed("t", "t0").join(steps, F.col("id") == F.col("at")).select("seed", F.col("next").alias("id"), F.greatest("t0", "t").alias("t"))
        at = nxt.groupBy("seed", "id").agg(F.min("t").alias("t")).join(seen, ["seed", "id"], "left_anti")
        if depth > 3:
            at = cut(at)
        out.append(at.withColumn("depth", F.lit(k)))
        seen = seen.unionByName(at.select("seed", "id"))
    every = reduce(DataFrame.unionByName, out)
    return every.select("seed", "id", "depth", F.when(F.col("t") == 0, "exact").otherwise("probable").alias("tier"))


def risk(direct, processes, lower_bound):
    """LOW to CRITICAL from direct callers and affected processes, one step up where call
    sites stayed unresolved."""
    level = F.when((direct > 50) | (processes > 20), 3).when((direct > 15) | (processes > 8), 2).when(direct > 3, 1).otherwise(0) + lower_bound.cast("int")
    return F.when(level == 0, "LOW").when(level == 1, "MEDIUM").when(level == 2, "HIGH").otherwise("CRITICAL")


def reach(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int, upstream: bool = False) -> tuple[str, DataFrame]:
    """Whether any target can be reached from any source within ``max_depth`` steps.

    Returns a verdict (established, absent, unknown) and ``id, depth`` of what was
    reached: absent only where the frontier ran dry, unknown where the depth did.  A
    source that is a target is established at depth 0.
    """
    steps = cut(_turned(edges, upstream).select("at", "next"))
    goal = targets.select("id").distinct()
    at = cut(sources.select("id").distinct().withColumn("depth", F.lit(0)))
    seen, k = at, 0
    while True:
        if not at.join(goal, "id", "left_semi").isEmpty():
            return "established", seen
        if k >= max_depth:
            return "unknown", seen
        k += 1
        at = cut(at.join(steps, F.col("id") == F.col("at")).select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        if at.isEmpty():
            return "absent", seen
        seen = seen.unionByName(at)


def trace(edges: DataFrame, source: int, target: int, max_depth: int, furthest: bool = False) -> DataFrame:
    """``step, id`` of a shortest path, by least predecessors; empty where there is none.

    With ``furthest`` a target out of reach gives the path to the furthest node reached
    instead (the least id of the furthest), so it ends anywhere but at the target.
    """
    verdict, seen = reach(edges, edges.sparkSession.range(source, source + 1), edges.sparkSession.range(target, target + 1), max_depth)
    levels = cut(seen)
    if verdict != "established":
        if not furthest:
            return edges.sparkSession.createDataFrame([], "step int, id long")
        target = -levels.agg(F.max(F.struct("depth", (-F.col("id")).alias("n"))).alias("m")).first()["m"]["n"]
    steps = _turned(edges, False).select("at", "next")
    last = levels.where(F.col("id") == target).first()["depth"]
    path, at = [(last, target)], target
    for k in range(last - 1, -1, -1):  # one row per step of one path
        up = steps.where(F.col("next") == at).join(levels.where(F.col("depth") == k), F.col("at") == F.col("id")).agg(F.min("at").alias("m")).first()
        at = up["m"]
        path.append((k, at))
    return edges.sparkSession.createDataFrame(sorted(path), "step int, id long")


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: strongly connected components with more than one node or a
    self-loop, named by their least id.

    Every node takes the least id that reaches it and the least id it reaches; both
    spread along the edges until they rest.  Two nodes of a component share both, so
    edges between nodes that differ are cut, and the least node of every remaining
    piece has its whole component under its own id.  Acyclic parts fall apart in the
    first rounds.  All pieces are refined at once.
    """
    left = cut(edges.select("src", "dst").distinct())
    loops = left.where("src = dst").select(F.col("src").alias("id"))
    left = cut(left.where("src <> dst"))
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
        both = cut(left.select(F.lit(True).alias("fwd"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(left.select(F.lit(False).alias("fwd"), F.col("dst").alias("a"), F.col("src").alias("b"))))
        label, total = cut(nodes.select("id", F.col("id").alias("f"), F.col("id").alias("g"))), None
        while True:
            # what reaches my least ancestor reaches me: labels of labels shorten long ways
            far_f = label.select(F.col("id").alias("f"), F.col("f").alias("f2"))
            far_g = label.select(F.col("id").alias("g"), F.col("g").alias("g2"))
            far = label.join(far_f, "f").join(far_g, "g").select("id", F.col("f2").alias("f"), F.col("g2").alias("g"))
            sent = both.join(far, F.col("a") == F.col("id")).select(F.col("b").alias("id"), F.when(F.col("fwd"), F.col("f")).alias("f"), F.when(~F.col("fwd"), F.col("g")).alias("g"))
            label = cut(far.unionByName(sent).groupBy("id").agg(F.min("f").alias("f"), F.min("g").alias("g")))
            now = tuple(label.agg(F.sum(F.col("f").cast("decimal(38,0)")), F.sum(F.col("g").cast("decimal(38,0)"))).first())
            if now == total:
                break
            total = now
        ends = left.join(label.withColumnsRenamed({"id": "src", "f": "f1", "g": "g1"}), "src").join(label.withColumnsRenamed({"id": "dst", "f": "f2", "g": "g2"}), "dst")
        kept = cut(ends.where("f1 = f2 AND g1 = g2").select("src", "dst", "f1", "g1"))
        if kept.where("f1 <> g1").isEmpty():
            settled = kept
            break
        left = kept.select("src", "dst")
    else:
        settled = left.select("src", "dst", F.col("src").alias("f1"), F.col("src").alias("g1"))
    big = settled.select(F.explode(F.array("src", "dst")).alias("id"), F.col("f1").alias("component")).distinct()
    alone = loops.distinct().join(big.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return big.unionByName(alone)


def witness(edges: DataFrame, comps: DataFrame, most_edges: int = 10_000) -> DataFrame:
    """``component, walk``: a shortest closed walk through the least id of each component.

    Components of at most ``most_edges`` inner edges are walked in a task each, larger
    ones level by level in joins.
    """
    import pandas as pd

    inside = cut(edges.select("src", "dst").distinct().join(comps.withColumnsRenamed({"id": "src", "component": "c"}), "src").join(comps.withColumnsRenamed({"id": "dst", "component": "c2"}), "dst").where("c = c2").select(F.col("c").alias("component"), "src", "dst"))
    sizes = cut(inside.groupBy("component").count())
    small = inside.join(sizes.where(F.col("count") <= most_edges), "component", "left_semi")
    large = sizes.where(F.col("count") > most_edges)

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        out: dict[int, list[int]] = {}
        for a, b in sorted(zip(p["src"], p["dst"])):
            out.setdefault(a, []).append(b)
        root = min(out)
        came, todo = {}, deque([root])
        while todo:
            at = todo.popleft()
            for b in out.get(at, []):
                if b == root:
                    path = [root, at] if at != root else [root]
                    while path[-1] != root:
                        path.append(came[path[-1]])
                    path = path if at != root else [root, root]
                    return pd.DataFrame({"component": [int(p["component"].iloc[0])], "walk": [[int(x) for x in path[::-1]]]})
                if b not in came:
                    came[b] = at
                    todo.append(b)
        return pd.DataFrame({"component": [int(p["component"].iloc[0])], "walk": [None]})

    short = small.groupBy("component").applyInPandas(walk, "component long, walk array<long>")
    if large.isEmpty():
        return short
    return short.unionByName(_closed_walks(cut(inside.join(large, "component", "left_semi")), large.select("component")))


def _closed_walks(inside: DataFrame, comps: DataFrame) -> DataFrame:
    """``component, walk`` by breadth-first levels of all components at once; each node
    keeps its least predecessor, so going back takes a row per component and level."""
    at = seen = cut(comps.select("component", F.col("component").alias("id")))
    levels, ended = [], []
    while not at.isEmpty():
        near = at.join(inside.withColumnRenamed("src", "id"), ["component", "id"]).groupBy("component", F.col("dst").alias("_n")).agg(F.min("id").alias("by"))
        near = cut(near.withColumnRenamed("_n", "id"))
        back = near.where("id = component").select("component", F.col("by").alias("at"), F.array("by", "component").alias("walk"))
        ended.append(back)
        on = near.join(seen, ["component", "id"], "left_anti").join(back.select("component"), "component", "left_anti")
        found = cut(on.select("component", "id", "by"))
        levels.append(found)
        at = found.select("component", "id")
        seen = cut(seen.join(back.select("component"), "component", "left_anti").unionByName(at))
    ways = ended.pop()
    for k in range(len(ended) - 1, -1, -1):
        up = levels[k].select("component", F.col("id").alias("at"), "by")
        ways = ways.join(up, ["component", "at"]).select("component", F.col("by").alias("at"), F.concat(F.array("by"), "walk").alias("walk"))
        ways = cut(ways.unionByName(ended[k]))
    return ways.select("component", "walk")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``id, label``: each node takes the most frequent label of its neighbours, ties to
    the least, in synchronous rounds; parallel edges count each."""
    adj = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("w")))
    labels = cut(adj.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = adj.join(labels, F.col("b") == F.col("id")).groupBy("a", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("m")).select(F.col("a").alias("id"), (-F.col("m.l")).alias("label"))
        nxt = cut(best)
        if nxt.exceptAll(labels).isEmpty():
            break
        labels = nxt
    return labels


def label_propagation_in_place(edges: DataFrame, rounds: int = 10, most_edges: int = 5_000_000) -> DataFrame:
    """The same with labels updated in place in id order, on one task: for graphs of at
    most ``most_edges`` edges; a larger one is refused, not cut."""
    import pandas as pd

    if edges.count() > most_edges:
        raise ValueError("in-place label propagation runs on one task; use label_propagation")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        from collections import Counter, defaultdict

        adj = defaultdict(list)
        for a, b in zip(p["src"], p["dst"]):
            adj[a].append(b)
            adj[b].append(a)
        label = {v: v for v in adj}
        for _ in range(rounds):
            changed = False
            for v in sorted(adj):
                c = Counter(label[u] for u in adj[v])
                best = min(c, key=lambda k: (-c[k], k))
                changed |= best != label[v]
                label[v] = best
            if not changed:
                break
        return pd.DataFrame({"id": list(label), "label": list(label.values())})

    one = edges.select("src", "dst", F.lit(0).alias("_g"))
    return one.groupBy("_g").applyInPandas(run, "id long, label long")


def clusters(edges: DataFrame, labels: DataFrame, symbols: DataFrame, least: int = 3) -> DataFrame:
    """``cluster, size, cohesion, dir, words``: groups under ``least`` nodes become ``misc``
    (-1); cohesion halves the internal edges (each is seen from both ends) and no others.

    ``dir`` is the commonest folder of the members' files (``root`` for none), ``words``
    the five commonest words of at least two bytes in their names; equals by name.
    """
    from pyspark.sql import Window

    from tracewell.functions.text import split_ident_words

    sizes = labels.groupBy("label").count()
    named = labels.join(sizes, "label").select("id", F.when(F.col("count") >= least, F.col("label")).otherwise(-1).alias("cluster"))
    adj = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    both = adj.join(named.withColumnsRenamed({"id": "a", "cluster": "ca"}), "a").join(named.withColumnsRenamed({"id": "b", "cluster": "cb"}), "b")
    links = both.groupBy(F.col("ca").alias("cluster")).agg(F.floor(F.count_if(F.col("ca") == F.col("cb")) / 2).alias("i"), F.count_if(F.col("ca") != F.col("cb")).alias("x"))
    size = named.groupBy("cluster").agg(F.count("*").alias("size"))
    members = named.join(symbols.select("id", "file", "name"), "id")
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("root")
    dirs = members.groupBy("cluster", folder.alias("dir")).agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "dir")).alias("d"))
    words = members.select("cluster", F.explode(split_ident_words(F.col("name"))).alias("word")).where(F.octet_length("word") >= 2).groupBy("cluster", "word").agg(F.count("*").alias("n"))
    best = words.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "word"))).where("r <= 5")
    top = best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), ",").alias("words"))
    cohesion = F.round(F.col("i") / F.greatest(F.col("i") + F.col("x"), F.lit(1)), 6).alias("cohesion")
    return size.join(links, "cluster").join(dirs, "cluster", "left").join(top, "cluster", "left").select("cluster", "size", cohesion, F.coalesce("d.dir", F.lit("root")).alias("dir"), F.coalesce("words", F.lit("")).alias("words"))


#: SQL LIKE patterns (ASCII case-insensitive, _ a wildcard) of names and
#: paths that are no entry points.
TEST_NAMES = ["test_%", "test%", "%_test", "%Test", "%_tests", "%Tests", "it_%", "it%", "spec_%", "should_%", "expect_%"]
TEST_PATHS = ["tests/%", "%/tests/%", "test/%", "%/test/%", "%/__tests__/%", "benches/%", "%/benches/%", "%.test.ts", "%.test.tsx", "%.spec.ts", "%.spec.tsx", "%_test.go", "test_%.py", "%/test_%.py"]


def _like_any(c, patterns):
    return reduce(lambda a, b: a | b, [F.col(c).ilike(p) for p in patterns])


def entry_points(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, out``: symbols that call and are never called, tests left out."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    real = symbols.where(~_like_any("name", TEST_NAMES) & ~_like_any("file", TEST_PATHS)).select("id")
    return out.join(real, "id", "left_semi").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def flows(edges: DataFrame, entries: DataFrame, depth: int, branching: int, least: int = 3) -> DataFrame:
    """``entry, members``: what each entry reaches level by level, at most ``branching``
    new nodes per node (exact edges first, then id); equal member sets once (least
    entry), sets under ``least`` dropped.

    Levels are breadth-first, and the nodes of a level take theirs in the order they
    were taken in: what one has no room for stays free for the next.  A level has at
    most ``branching ** depth`` nodes an entry, and a node is asked for no more than its
    first that the others of its level cannot all have taken, so a task's rows for an
    entry are bounded by the two parameters.
    """
    import pandas as pd
    from pyspark.sql import Window

    steps = cut(_turned(edges, False))
    at = seen = cut(entries.select(F.col("id").alias("entry"), "id", F.lit(0).cast("long").alias("n")))

    def take(p: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        used: dict[int, int] = {}
        for n, _, i in sorted(zip(p["n"].tolist(), p["t"].tolist(), p["id"].tolist())):
            if i not in taken and used.get(n, 0) < branching:
                taken[i] = len(taken)
                used[n] = used.get(n, 0) + 1
        return pd.DataFrame({"entry": int(p["entry"].iloc[0]), "id": list(taken), "n": list(taken.values())})

    for k in range(depth):
        free = at.join(steps, F.col("id") == F.col("at")).select("entry", "n", F.col("next").alias("id"), "t").join(seen, ["entry", "id"], "left_anti")
        w = Window.partitionBy("entry", "n").orderBy("t", "id")
        # those ahead in a level take fewer than branching ** (k + 1) nodes
        asked = free.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= branching ** (k + 1)).select("entry", "n", "id", "t")
        at = cut(asked.groupBy("entry").applyInPandas(take, "entry long, id long, n long"))
        seen = seen.unionByName(at)
    sets = seen.groupBy("entry").agg(F.array_sort(F.collect_set("id")).alias("members")).where(F.size("members") >= least)
    return sets.groupBy("members").agg(F.min("entry").alias("entry")).select("entry", "members")


def dead_code(edges: DataFrame, symbols: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Functions and methods without callers or references, entry points and names
    with unresolved call sites (``leaf``) left out."""
    used = edges.where("kind IN ('call', 'reference')").select(F.col("dst").alias("id"))
    name, file = F.col("leaf"), F.substring_index("file", "/", -1)
    entry = (name == "main") | ((name == "init") & F.col("file").endswith(".go")) | F.col("file").rlike(r"(?:^|/)(?:test|tests|__tests__|spec)/") | file.rlike(r"_test\.(?:go|py)$|^test_.*\.py$|\.test\.|\.spec\.")
    s = symbols.where("kind IN ('function', 'method')").where(~entry)
    return s.join(used, "id", "left_anti").join(unresolved.select("leaf").distinct(), "leaf", "left_anti").select("id", "uid", "file", "line")


def merge_findings(*findings: DataFrame) -> DataFrame:
    """Findings (file, line, label, severity, fan_in) of several queries: one per file,
    line and label, the earliest query's."""
    tagged = [f.withColumn("_q", F.lit(i)) for i, f in enumerate(findings)]
    every = reduce(DataFrame.unionByName, tagged)
    g = every.groupBy("file", "line", "label").agg(F.min(F.struct("_q", "severity", "fan_in")).alias("m"))
    return g.select("file", "line", "label", "m.severity", "m.fan_in")


def layers(edges: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """``id, layer``: the longest path to a sink, over the graph with its strongly
    connected components condensed; members of a component share a layer.

    Up to ``most_edges`` edges are walked in one task.  Of a larger graph, what has no
    way out or no way in is peeled off in joins until the rest is small enough; what
    stays larger, all of it between cycles, is condensed in joins and peeled again.
    """
    pairs = cut(edges.select("src", "dst").distinct())
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("layer", F.lit(0))
    return _layers(pairs.where("src <> dst"), nodes, most_edges)


def _layers(left: DataFrame, open_: DataFrame, most_edges: int) -> DataFrame:
    """The same of the nodes ``open_``, whose ``layer`` is what they have at least."""
    settled, waiting, before, n = [], [], None, left.count()
    while n > most_edges and n != before:
        # no way out: what a node has at least is its layer, and those before it have one more
        ends = cut(open_.join(left.select(F.col("src").alias("id")), "id", "left_anti"))
        settled.append(ends)
        above = left.join(ends.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("layer") + 1).alias("l2"))
        open_ = cut(open_.join(ends.select("id"), "id", "left_anti").join(above, "id", "left").select("id", F.greatest("layer", F.coalesce("l2", F.lit(0))).alias("layer")))
        left = cut(left.join(ends.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        # no way in: nobody needs their layers, so they wait for all others
        starts = cut(open_.join(left.select(F.col("dst").alias("id")), "id", "left_anti"))
        first = starts.select(F.col("id").alias("src"))
        waiting.append((starts, cut(left.join(first, "src", "left_semi"))))
        open_, left = cut(open_.join(starts.select("id"), "id", "left_anti")), cut(left.join(first, "src", "left_anti"))
        before, n = n, left.count()
    if n <= most_edges:
        core = left.select("src", "dst", F.lit(0).alias("layer")).unionByName(open_.select(F.col("id").alias("src"), F.col("id").alias("dst"), "layer"))
        core = core.repartition(1).mapInPandas(_longest(), "id long, layer int")
    else:
        group = cut(open_.join(components(left), "id", "left").select("id", F.coalesce("component", "id").alias("g"), "layer"))
        ends_of = group.select("id", "g")
        dag = cut(left.join(ends_of.withColumnsRenamed({"id": "src", "g": "a"}), "src").join(ends_of.withColumnsRenamed({"id": "dst", "g": "b"}), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
        least = cut(group.groupBy(F.col("g").alias("id")).agg(F.max("layer").alias("layer")))
        core = ends_of.join(_layers(dag, least, most_edges).withColumnRenamed("id", "g"), "g").select("id", "layer")
    if not settled:
        return core
    known = reduce(DataFrame.unionByName, settled, cut(core))
    for starts, on in reversed(waiting):
        below = on.join(known.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg((F.max("layer") + 1).alias("l2"))
        known = known.unionByName(cut(starts.join(below, "id", "left").select("id", F.greatest("layer", F.coalesce("l2", F.lit(0))).alias("layer"))))
    return known


def _longest():
    """A task's function: ``id, layer`` of edges (src, dst) and nodes (src = dst, with
    their least layer) by Tarjan's walk, which leaves a component after all those it
    leads to."""

    def walk(parts):
        from array import array

        import numpy as np
        import pandas as pd

        src, dst, least = (np.concatenate(c) for c in zip((np.zeros(0, "int64"),) * 3, *((p["src"].to_numpy(), p["dst"].to_numpy(), p["layer"].to_numpy()) for p in parts)))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        a, b = at[: len(src)], at[len(src) :]
        base = np.zeros(len(ids), "int64")
        np.maximum.at(base, a, least)
        a, b = a[a != b], b[a != b]
        ints = lambda x: array("q", x.astype("int64").tobytes())
        ends = np.cumsum(np.bincount(a, minlength=len(ids)))
        out, to, end, layer = ints(b[np.argsort(a, kind="stable")]), ints(np.concatenate([[0], ends])), ints(ends), ints(base)
        begin = to[:]
        num, low = ints(np.zeros(len(ids))), ints(np.zeros(len(ids)))
        over = len(ids) + 1  # the number of those that have been left
        count, held = 0, []
        for root in range(len(ids)):
            way = [] if num[root] else [root]
            while way:
                v = way[-1]
                if not num[v]:
                    count += 1
                    num[v] = low[v] = count
                    held.append(v)
                k = to[v]
                if k < end[v]:
                    to[v] = k + 1
                    if not num[out[k]]:
                        way.append(out[k])
                    elif num[out[k]] < low[v]:
                        low[v] = num[out[k]]
                    continue
                way.pop()
                if way and low[v] < low[way[-1]]:
                    low[way[-1]] = low[v]
                if low[v] == num[v]:
                    i = len(held) - 1
                    while held[i] != v:
                        i -= 1
                    members, far = held[i:], 0
                    del held[i:]
                    for m in members:
                        far = max(far, layer[m])
                        for k in range(begin[m], end[m]):
                            if num[out[k]] == over and layer[out[k]] >= far:
                                far = layer[out[k]] + 1
                    for m in members:
                        num[m], layer[m] = over, far
        yield pd.DataFrame({"id": ids, "layer": np.array(layer, dtype="int32")})

    return walk


def neighbor_files(edges: DataFrame, symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """``path, reason``: files of direct callers, then callees, of the seeds (id, rank);
    the first reason in seed order stands, callers before callees."""
    s = symbols.select("id", "file", "name")
    e = edges.where("kind = 'call'").select("src", "dst").distinct()
    one = lambda a, b, verb, k: (
        e.join(seeds.select(F.col("id").alias(a), "rank"), a)
        .join(s.select(F.col("id").alias(b), "file", "name"), b)
        .join(s.select(F.col("id").alias(a), F.col("name").alias("seed")), a)
        .select("file", F.struct(F.lit(k).alias("k"), "rank", F.concat_ws(" ", "name", F.lit(verb), "seed").alias("reason")).alias("r"))
    )
    both = one("dst", "src", "calls", 0).unionByName(one("src", "dst", "called-by", 1))
    return both.groupBy(F.col("file").alias("path")).agg(F.min("r").alias("r")).select("path", "r.reason")


def co_members(clusters_: DataFrame, seeds: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with a symbol in a seed's cluster; ``misc`` (-1) links nothing."""
    of = clusters_.join(seeds.select("id"), "id", "left_semi").where("cluster <> -1").select("cluster").distinct()
    ids = clusters_.join(of, "cluster", "left_semi").select("id")
    return symbols.join(ids, "id", "left_semi").select(F.col("file").alias("path")).distinct()


def tree_delta(now: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """``key, change``: added, removed or changed by content hash."""
    j = now.select(key, F.col(value).alias("_n"), F.lit(True).alias("_hn")).join(stored.select(key, F.col(value).alias("_o"), F.lit(True).alias("_ho")), key, "full")
    change = F.when(F.col("_ho").isNull(), "added").when(F.col("_hn").isNull(), "removed").when(~F.col("_n").eqNullSafe(F.col("_o")), "changed")
    return j.select(key, change.alias("change")).where("change IS NOT NULL")


def signature(df: DataFrame, key: str, value: str, slices: int = 4096) -> str:
    """One hash over all (key, value) pairs, whatever their order: pairs are hashed into
    slices whose sorted lists are hashed apart, then the slices' hashes in turn."""
    line = F.concat_ws("\0", key, F.coalesce(F.col(value).cast("string"), F.lit("")))
    part = df.groupBy(F.pmod(F.xxhash64(key), F.lit(slices)).alias("s")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(line, 256))), "\n"), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "h"))), lambda x: x["h"]), "\n"), 256)).first()[0]


def rename_plan(symbols: DataFrame, edges_with_sites: DataFrame, ident: int, new_name: str) -> DataFrame:
    """``file, line, role, old, new``: the definition and every referring site."""
    s = symbols.where(F.col("id") == ident).select("id", "file", "line", "leaf")
    sites = edges_with_sites.where(F.col("dst") == ident).join(symbols.select(F.col("id").alias("src"), F.col("file").alias("f")), "src")
    uses = sites.join(s.select(F.col("id").alias("dst"), "leaf"), "dst").select(F.col("f").alias("file"), sites["line"], F.col("kind").alias("role"), F.col("leaf").alias("old"))
    every = s.select("file", "line", F.lit("definition").alias("role"), F.col("leaf").alias("old")).unionByName(uses)
    return every.distinct().withColumn("new", F.lit(new_name))
