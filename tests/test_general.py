"""Hierarchies, change capture, orphan state, ordering."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.operators import activity, changes, hierarchy, orphans, rank
from tracewell.operators.ordering import numbered
from tracewell.session import standing
from tracewell.streaming.feed import ChangeFeed, DeltaSink, Store


def plain_tree(parents):
    out = {}
    for i in parents:
        seen, at = [], i
        while True:
            seen.append(at)
            up = parents[at]
            if not up or up not in parents:
                out[i] = (at, len(seen) - 1)
                break
            if up in seen:
                out[i] = (min(seen[seen.index(up) :]), -1)
                break
            at = up
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_against_walking(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(60)]
    parents = {i: rng.choice([None, "", "gone", *ids]) if rng.random() < 0.9 else None for i in ids}
    parents |= {f"d{k}": f"d{k - 1}" if k else None for k in range(20)}  # deeper than a batch of levels
    parents["self"] = "self"
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in parents.items()], "id string, parent string, depth int, path string")
    got = hierarchy.hierarchy(df, "id", "parent").collect()
    want = plain_tree(parents)
    assert {r["id"]: (r["root_id"], r["depth"]) for r in got} == want
    for r in got:
        assert (r["path"] is None) == (r["depth"] < 0)
        if r["path"]:
            assert len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root_id"] and r["path"][-1] == r["id"]
    tree = hierarchy.hierarchy(df, "id", "parent")
    pairs = {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(tree).collect()}
    assert pairs == {(a, r["id"], r["depth"] - k) for r in got if r["path"] for k, a in enumerate(r["path"][:-1])}


@pytest.mark.parametrize("seed", range(3))
def test_descendants_through_circles(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:02d}" for i in range(30)]
    parents = {i: rng.choice([None, "gone", *ids]) for i in ids}
    parents |= {f"r{k}": f"r{(k + 1) % 5}" for k in range(5)} | {"h0": "r3", "h1": "h0", "self": "self", "leaf": "self"}
    df = spark.createDataFrame(list(parents.items()), "id string, parent string")
    tree = hierarchy.hierarchy(df, "id", "parent")
    got = [tuple(r) for r in hierarchy.descendants(tree).unionByName(hierarchy.caught_descendants(tree, df, "id", "parent")).collect()]
    want = set()
    for i in parents:
        at, seen = parents[i], [i]
        while at in parents and at not in seen:
            want.add((at, i, len(seen)))
            seen.append(at)
            at = parents[at]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("r2", "h1", 6) in want and ("self", "leaf", 1) in want


def test_a_hot_parent_is_met_in_pieces(spark):
    rows = [("top", None), *[(f"k{i}", "top") for i in range(200)], *[(f"g{i}", f"k{i % 3}") for i in range(60)], ("deep", "g7")]
    got = {r["id"]: (r["root_id"], r["depth"], tuple(r["path"])) for r in hierarchy.hierarchy(spark.createDataFrame(rows, "id string, parent string"), "id", "parent").collect()}
    assert len(got) == len(rows) and got["k150"] == ("top", 1, ("top", "k150")) and got["g7"] == ("top", 2, ("top", "k1", "g7")) and got["deep"] == ("top", 3, ("top", "k1", "g7", "deep"))


def test_hierarchy_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, parent string")
    assert hierarchy.hierarchy(empty, "id", "parent").collect() == []
    one = spark.createDataFrame([(None, "a"), ("a", None)], "id string, parent string")
    assert [(r["id"], r["depth"]) for r in hierarchy.hierarchy(one, "id", "parent").collect()] == [("a", 0)]


def test_standing_takes_the_greatest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 3, None), ("b", None, "y"), (None, 9, "z")], "k string, t int, v string")
    assert sorted((r["k"], r["t"], r["v"]) for r in standing(df, "k", ["t"]).collect()) == [("a", 3, None), ("b", None, "y")]


def test_changes_against_simulation(spark, tmp_path):
    rng = random.Random(5)
    paths = [f"p{i}" for i in range(12)]
    log = [(i, rng.choice(paths), rng.choice([None, "A", "a", "b", "c"]), rng.randrange(100), rng.randrange(100)) for i in range(300)]
    log += log[:20]  # repeated rows
    base = [(p, "a", -1) for p in paths[::2]]
    runs = [(r, r * 12, r % 3 != 0) for r in range(1, 9)]
    df = spark.createDataFrame(log, "scan_id long, path string, hash string, seen long, landed long")
    part = df.select(
        changes.log_partition(["path", "scan_id"], 4).alias("part"), "landed", "scan_id", F.struct("landed", "scan_id").alias("offset"), "path",
        F.struct("seen", "scan_id").alias("version"), F.lower("hash").alias("value"),
    )
    plan = changes.batch_plan(part, runs, "part", "offset", "landed", 4)
    b = spark.createDataFrame(base, "path string, value string, seen long").select("path", F.struct("seen", F.lit(-1).cast("long").alias("scan_id")).alias("version"), "value")
    feed, sink = ChangeFeed(spark, f"file://{tmp_path}/feed", "part", ("landed", "scan_id")), DeltaSink(spark, f"file://{tmp_path}/sink", "path", ["version"])
    for run, started, ok in runs:

        def apply(batch, n):
            sink.append(batch.select("path", "version", "value"), n)
            if not ok:
                raise RuntimeError("lost")

        try:
            feed.run(part.where(F.col("landed") <= started), apply, str(run))
        except RuntimeError:
            assert not ok
    done = feed.commits()
    of = spark.createDataFrame([(c["batch"], int(c["label"]), int(c["label"])) for c in done], "batch int, run_id int, seq int")
    batches = sink.deltas([c["batch"] for c in done]).join(of, "batch").drop("batch")
    got = {(x["run_id"], x["path"]) for x in changes.changed(batches, b, "path", "version", "value").collect()}
    want, last = set(), {p: v for p, v, _ in base}
    for run, started, ok in runs:
        if not ok:
            continue
        state = {}
        for p in paths:
            cand = [((s, i), h and h.lower()) for i, q, h, s, l in log if q == p and l <= started]
            cand += [((-1, -1), v) for q, v, _ in base if q == p]
            state[p] = max(cand, key=lambda c: c[0])[1] if cand else None
            if state[p] and state[p] != last.get(p):
                want.add((run, p))
        last = state
    assert got == want
    # a failed run's records are planned again by the next one
    per = defaultdict(int)
    for x in plan.collect():
        per[x["run_id"], x["committed"]] += x["records"]
    assert sum(n for (_, ok), n in per.items() if ok) == sum(1 for *_, l in log if l <= 96)


class Crash(Exception):
    pass


def test_feed_ends_alike_wherever_it_crashes(spark, tmp_path, monkeypatch):
    """One crash before or after every step of every run: each small file (written, renamed),
    each delta and each compaction."""
    log = [(i % 3, i, f"k{i % 7}", f"v{i}") for i in range(40)]
    want = {k: v for _, _, k, v in log}
    steps = {"at": 0, "crash": None}

    def step(name):
        steps["at"] += 1
        if steps["at"] == steps["crash"]:
            raise Crash(name)

    write, folded = Store.write, DeltaSink._folded

    def stepping(self, name, value):
        step(f"before {name}")
        write(self, name, value)
        step(f"after {name}")

    def half(self, rows, *also):
        step("before data")
        return folded(self, rows, *also)

    monkeypatch.setattr(Store, "write", stepping)
    monkeypatch.setattr(DeltaSink, "_folded", half)

    def history(root):
        for upto in (10, 25, 40):
            df = spark.createDataFrame(log[:upto], "part int, offset long, key string, value string")
            for _ in range(3):
                try:  # a new process each time
                    feed, sink = ChangeFeed(spark, f"{root}/feed"), DeltaSink(spark, f"{root}/sink", "key", ["offset"], 4)
                    feed.run(df, lambda b, n: sink.append(b.select("key", "offset", "value"), n))
                    if upto == 25:
                        sink.compact([c["batch"] for c in feed.commits()])
                    break
                except Crash:
                    continue
        done = [c["batch"] for c in feed.commits()]
        assert done == [1, 2, 3]
        assert sum(r["n"] for r in sink.deltas(done).groupBy("batch").agg(F.count("*").alias("n")).collect()) == 21  # seven keys each, no record twice
        monkeypatch.setattr(DeltaSink, "_folded", folded)
        got = {r["key"]: r["value"] for r in sink.table(done).collect()}
        monkeypatch.setattr(DeltaSink, "_folded", half)
        assert got == want

    history(f"file://{tmp_path}/whole")
    total = steps["at"]
    assert total >= 20
    for k in range(1, total + 1):
        steps.update(at=0, crash=k)
        history(f"file://{tmp_path}/{k}")


def test_store_replaces_in_one_step(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("x", {"n": 1})

    class Broken:
        def rename(self, *_):
            raise Crash

    monkeypatch.setattr(store, "context", Broken())
    with pytest.raises(Crash):
        store.write("x", {"n": 2})
    assert store.read("x") == {"n": 1} and store.read("y") is None


def test_feed_of_nothing(spark, tmp_path):
    feed = ChangeFeed(spark, f"file://{tmp_path}/f")
    empty = spark.createDataFrame([], "part int, offset long, key string")
    assert feed.run(empty, lambda b, n: 1 / 0) == 0 and feed.commits() == []
    sink = DeltaSink(spark, f"file://{tmp_path}/s", "key", ["offset"])
    assert sink.table([]) is None and sink.deltas([3]) is None
    nulls = spark.createDataFrame([(0, 1, None), (0, 2, None), (0, 2, None)], "part int, offset long, key string")
    assert feed.run(nulls, lambda b, n: sink.append(b.select("key", "offset"), n)) == 1
    assert feed.run(nulls, lambda b, n: 1 / 0) == 0  # nothing new
    assert [tuple(r) for r in sink.table([1]).collect()] == [(None, 2)]


@pytest.mark.parametrize("seed,size", [(1, 1), (2, 3), (3, 99)])
def test_orphan_replay_against_simulation(spark, seed, size):
    """References, arrivals and drops month by month: every snapshot and the last state."""
    rng = random.Random(seed)
    months = [f"2025-{m:02d}" for m in range(1, 8)]
    refs = [(f"r{i}", "t" if i % 2 else None, rng.choice([*months, None]), "hot" if i % 3 == 0 else rng.choice([*"abcdef", None])) for i in range(150)]
    rows = []
    for k in ["hot", *"abcde"]:
        for _ in range(rng.randrange(1, 4)):
            came = rng.choice([None, *months])
            went = rng.choice([None, *[m for m in months if m > (came or "")]])
            rows.append((k, came, went))
    r = spark.createDataFrame([(i, t, s, k) for i, t, s, k in refs], "id string, kind string, step string, key string")
    e = spark.createDataFrame([x for k, a, b in rows for x in ([(k, a, 1)] + ([(k, b, -1)] if b else []))], "key string, step string, delta int")
    replay = orphans.OrphanReplay(r, e, ["id", "kind"])
    steps = replay.steps()
    replay.run([steps[i : i + size] for i in range(0, len(steps), size)])
    alive = lambda k, m: any((a or "") <= m and (b is None or b > m) for q, a, b in rows if q == k)
    known = [x for x in refs if x[3] is not None]
    assert {(x["id"], x["kind"]) for x in replay.pending().collect()} == {(i, t) for i, t, s, k in known if not alive(k, "9")}
    got = {(x["step"], x["kind"]): x["orphans"] for x in replay.snapshots("kind").collect()}
    want = defaultdict(int)
    for m in steps:
        for i, t, s, k in known:
            if (s or orphans.FIRST) <= m and not alive(k, "" if m == orphans.FIRST else m):
                want[m, t] += 1
    assert got == dict(want)
    assert replay.log().groupBy("id", "step").count().where("count > 1").isEmpty()


def test_orphan_replay_of_nothing(spark):
    r, e = spark.createDataFrame([], "id string, step string, key string"), spark.createDataFrame([], "key string, step string, delta int")
    replay = orphans.OrphanReplay(r, e, ["id"]).run([])
    assert replay.steps() == [] and replay.pending().collect() == [] and replay.snapshots("id").collect() == []


def test_leaf(spark):
    names = ["A::b#c.d", "x", "a.b?", "", None, "A::B"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(orphans.leaf(F.col("n")).alias("l")).collect()
    assert [r["l"] for r in got] == ["d", "x", "b?", "", None, "B"]


def test_positions_and_totals(spark):
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else "big" if i % 3 else rng.choice("ab"), rng.randrange(20), i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, id int, w long")
    got = numbered(df, ["g"], ["o", "id"], "p", F.col("w"), "t").collect()
    by = defaultdict(list)
    for g, o, i, w in rows:
        by[g].append((o, i, w))
    for g, mine in by.items():
        total = 0
        have = {r["id"]: (r["p"], r["t"]) for r in got if r["g"] == g}
        for k, (o, i, w) in enumerate(sorted(mine), 1):
            total += w
            assert have[i] == (k, total)
    assert numbered(df.limit(0), ["g"], ["o"]).collect() == []


def test_eviction_and_retention(spark):
    df = spark.createDataFrame([(i, 10, i % 4 == 0, i * 5) for i in range(20)], "k long, size long, rescue boolean, at long")
    kept = {r["k"] for r in activity.evict(df, "size", "rescue", "at", "k", 80).collect()}
    assert kept == {0, 4, 8, 12, 16, 19, 18, 17}
    assert {r["k"] for r in activity.retain(df, "at", "k", 100, 50, 5).collect()} == {15, 16, 17, 18, 19}
    assert activity.retain(df.limit(0), "at", "k", 100, 50, 5).count() == 0


def test_tiers_fill_in_order(spark):
    rows = [(f"p{i:02d}", 1.0 - i / 100, i % 2 == 0, i % 3, 0) for i in range(40)]
    got = rank.tiered(spark.createDataFrame(rows, "path string, score double, exact boolean, lexical int, graph int"), 12).orderBy("position").collect()
    strong = [r for r in rows if r[2] or r[3] >= 2]
    p0 = [r[0] for r in strong[:5]]
    p1 = sorted([r[0] for r in strong[5:]] + [r[0] for r in rows if not (r[2] or r[3] >= 2) and r[3] >= 1])
    p2 = [r[0] for r in rows if not r[2] and r[3] == 0][:3]
    assert [r["path"] for r in got] == (p0 + p1[:12] + p2)[:12]


def test_budget_fit(spark):
    items = spark.createDataFrame([(0, i, 10 * (i + 1), 30 * (i + 1), 90 * (i + 1)) for i in range(5)], "g int, n int, l0 long, l1 long, l2 long")
    for budget in (3, 10, 40, 60, 1000):
        got = {r["n"]: r["level"] for r in rank.fit_budget(items, "g", "n", budget, ["l0", "l1", "l2"]).collect()}
        level, used, stop = dict.fromkeys(range(5), -1), 0, False
        for k, f in enumerate((10, 30, 90)):
            for i in range(5):
                grow = (f - (0, 10, 30)[k]) * (i + 1)
                if stop or -(-(used + grow) // 4) > budget:
                    stop = True
                    continue
                used, level[i] = used + grow, k
        assert got == level


def test_what_falls_off_after_the_best(spark):
    mk = lambda rows: spark.createDataFrame([(p, t, i, s) for i, (p, t, s) in enumerate(rows, 1)], "path string, tier string, position int, score double")
    kept = lambda rows, **k: [r["path"] for r in rank.precise(mk(rows), **k).orderBy("position").collect()]
    with_p0 = [("a", "P0", 1.0), ("b", "P0", 0.8), ("c", "P1", 0.4), ("d", "P1", 0.39), ("e", "P2", 0.5)]
    assert kept(with_p0) == ["a", "b", "c", "e"] and kept(with_p0, max_tier="P1") == ["a", "b", "c"] and kept(with_p0, gap=False, max_tier="P0") == ["a", "b"]
    assert kept([("a", "P1", 1.0), ("b", "P1", 0.6), ("c", "P1", 0.3)]) == ["a"]
    assert kept([("a", "P1", 1.0), ("b", "P1", 0.9), ("c", "P1", 0.3)]) == ["a", "b", "c"]
    assert kept([("a", "P2", 1.0)]) == ["a"] and kept([]) == []
