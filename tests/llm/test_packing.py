import random
from collections import defaultdict

from tracewell.llm import mixing as M
from tracewell.llm import packing as P


def naive(sizes, capacity):
    room, out = [], []
    for s in sizes:
        fit = [i for i, r in enumerate(room) if r >= s]
        i = min(fit, key=lambda i: room[i]) if fit else len(room)
        if not fit:
            room.append(capacity)
        room[i] -= s
        out.append(i)
    return sorted(room)


def test_tree_finds_the_tightest_bin():
    rng = random.Random(0)
    for capacity in (1, 2, 7, 8, 100, 513):
        for _ in range(20):
            sizes = sorted((rng.randint(0, capacity) for _ in range(60)), reverse=True)
            got = defaultdict(int)
            for b, s in zip(P.best_fit_decreasing(sizes, capacity), sizes):
                got[b] += s
            assert sorted(capacity - v for v in got.values()) == naive(sizes, capacity)


def test_every_item_is_packed_whole(spark, monkeypatch):
    rng = random.Random(1)
    for shard in (10**6, 40):
        monkeypatch.setattr(P, "SHARD_ITEMS", shard)
        items = [(i, rng.choice([None, 0, 5, 50, 99, 100, 101, 250, 300, rng.randrange(400)])) for i in range(300)]
        df = spark.createDataFrame([(i, n, "x") for i, n in items], "doc_id long, tokens long, room string")
        specs = spark.createDataFrame([(1, 100), (1, 100), (2, 300), (3, 0), (4, None)], "spec_id int, capacity int")
        rows = P.pack(df, specs).collect()
        for spec, cap in ((1, 100), (2, 300)):
            mine = [r for r in rows if r["spec_id"] == spec]
            pieces, bins = defaultdict(list), defaultdict(int)
            for r in mine:
                pieces[r["doc_id"]].append((r["piece_no"], r["from_token"], r["tokens"]))
                bins[r["container"]] += r["tokens"]
            assert max(bins.values()) <= cap and set(pieces) == {i for i, _ in items}
            for i, n in items:
                got, at = sorted(pieces[i]), 0
                assert len(got) == max(1, -(-(n or 0) // cap))
                for k, (no, start, size) in enumerate(got):
                    assert (no, start) == (k, at)
                    at += size
                assert at == (n or 0)
            assert len(bins) <= 1.1 * -(-sum(n or 0 for _, n in items) // cap) + 3
        assert {r["spec_id"] for r in rows} == {1, 2}
    assert P.pack(df.limit(0), specs).collect() == [] and P.pack(df, specs.limit(0)).collect() == []


def sized(spark, rng, sources):
    rows = [(10_000 * k + i, s, rng.randrange(1, 200)) for k, (s, n) in enumerate(sources.items()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_shares_repeats_and_order(spark):
    rows, df = sized(spark, random.Random(2), {"a": 300, "b": 60, "c": 40, "other": 50})
    targets = spark.createDataFrame([(" A ", 0.5, 1), ("b", 0.3, 2), ("C", 0.15, 4), ("gone", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    plan = M.plan(df, targets)
    out = M.mix(df, plan).orderBy("position").collect()
    total = sum(r["tokens"] for r in out)
    share, most = defaultdict(int), defaultdict(int)
    for r in out:
        share[r["source"]] += r["tokens"]
        most[r["source"]] = max(most[r["source"]], r["copy_no"])
    for s, aim in {"a": 0.5, "b": 0.3, "c": 0.15}.items():
        assert abs(share[s] / total - aim / 0.95) < 0.004
    assert most["a"] <= 1 and most["b"] <= 2 and most["c"] <= 4 and set(share) == {"a", "b", "c"}
    assert [r["position"] for r in out] == list(range(1, len(out) + 1)) and all(x["moment"] <= y["moment"] for x, y in zip(out, out[1:]))
    assert len({(r["doc_id"], r["copy_no"]) for r in out}) == len(out)
    # the weight of a source moves as its slope says: demand up to t is D (t + slope (t^2 - t))
    for s in plan:
        if s.demand:
            for t in (0.25, 0.5, 0.75):
                got = sum(r["tokens"] for r in out if r["source"] == s.name and r["moment"] <= t)
                assert abs(got - s.demand * (t + s.slope * (t * t - t))) <= 400
    told = {r["source"]: r for r in M.shares(M.mix(df, plan), plan).collect()}
    assert told["gone"]["tokens"] == 0 and abs(sum(r["reached_share"] for r in told.values()) - 1) < 1e-4


def test_a_source_that_falls_short(spark):
    _, df = sized(spark, random.Random(3), {"a": 50, "b": 5})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    plan = {s.name: s for s in M.plan(df, targets, total=10**6)}
    assert plan["a"].demand == plan["a"].supply and plan["b"].demand == 2 * plan["b"].supply
    assert M.mix(df, list(plan.values())).count() == 60
    assert M.mix(df.limit(0), M.plan(df.limit(0), targets)).collect() == []


def test_source_names(spark):
    from pyspark.sql import functions as F

    names = {" Commit-Messages": "commit_messages", "commit  messages\t": "commit_messages", "": "", None: None}
    assert {r["n"]: r["s"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", M.source_name(F.col("n")).alias("s")).collect()} == names
