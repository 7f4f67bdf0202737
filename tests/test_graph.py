import random
from collections import Counter, defaultdict

import pytest

from tracewell.operators import graph as G
from tracewell.operators import joins as J
from tracewell.session import cut


def edges(spark, pairs, tier="exact"):
    return spark.createDataFrame([(a, b, "call", tier) for a, b in pairs], "src long, dst long, kind string, tier string")


def reaches(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    far = {}
    for v in {x for p in pairs for x in p}:
        seen, todo = set(), [v]
        while todo:
            for n in out[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        far[v] = seen
    return far


HAND = {
    "self-loop": ([(1, 1)], {1: 1}),
    "two": ([(1, 2), (2, 1)], {1: 1, 2: 1}),
    "three": ([(1, 2), (2, 3), (3, 1), (3, 4)], {1: 1, 2: 1, 3: 1}),
    "acyclic": ([(1, 2), (2, 3), (1, 3)], {}),
    "diamond": ([(1, 2), (1, 3), (2, 4), (3, 4)], {}),
    "diamond-back": ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1)], {1: 1, 2: 1, 3: 1, 4: 1}),
    "bridge": ([(5, 4), (4, 5), (5, 1), (1, 2), (2, 1), (2, 9)], {5: 4, 4: 4, 1: 1, 2: 1}),
}


@pytest.mark.parametrize("name", HAND)
def test_components_of_hand_graphs(spark, name):
    pairs, want = HAND[name]
    assert {r["id"]: r["component"] for r in G.components(edges(spark, pairs)).collect()} == want


def test_components_and_walks_at_random(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    far = reaches(pairs)
    want = {v: min([v, *(u for u in far[v] if v in far[u])]) for v in far if v in far[v]}
    e = edges(spark, pairs)
    comps = G.components(e)
    assert {r["id"]: r["component"] for r in comps.collect()} == want
    have = set(pairs)
    for r in G.witness(e, comps).collect():
        walk = r["walk"]
        assert walk[0] == walk[-1] == r["component"] and all(p in have for p in zip(walk, walk[1:]))
    assert G.components(edges(spark, [])).collect() == []


def test_every_component_has_a_shortest_walk(spark):
    rng = random.Random(11)
    ring = [(i, i % 30 + 1) for i in range(1, 31)]  # 30 steps around
    pairs = [*ring, (40, 41), (41, 40), (50, 50), (50, 51), (51, 50), *((rng.randrange(60, 90), rng.randrange(60, 90)) for _ in range(80))]
    e = edges(spark, pairs)
    comps = G.components(e)
    want = {r["component"]: len(r["walk"]) for r in G.witness(e, comps).collect()}
    have = set(pairs)
    for bound in (0, 3, 30):
        got = {r["component"]: r["walk"] for r in G.witness(e, comps, bound).collect()}
        assert {c: len(w) for c, w in got.items()} == want
        assert all(w[0] == w[-1] == c and all(p in have for p in zip(w, w[1:])) for c, w in got.items())
    assert want[1] == 31 and want[40] == 3 and want[50] == 2


def test_hops_keep_least_depth_and_best_tier(spark):
    rows = [(1, 2, "call", "probable"), (1, 2, "call", "exact"), (2, 3, "call", "exact"), (1, 3, "call", "probable"), (3, 4, "call", "exact"), (4, 1, "call", "exact")]
    e = spark.createDataFrame(rows, "src long, dst long, kind string, tier string")
    seeds = spark.createDataFrame([(4,), (4,)], "id long")
    got = {(r["id"], r["depth"], r["tier"]) for r in G.hops(e, seeds, 3).collect()}
    assert got == {(3, 1, "exact"), (2, 2, "exact"), (1, 2, "probable")}


def test_reach_and_trace(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)])
    one = lambda i: spark.range(i, i + 1)
    assert G.reach(e, one(1), one(5), 9)[0] == "established" and G.reach(e, one(5), one(1), 9)[0] == "absent"
    assert G.reach(e, one(1), one(5), 2)[0] == "unknown" and G.reach(e, one(1), one(1), 0)[0] == "established"
    assert [r["id"] for r in G.trace(e, 1, 5, 9).orderBy("step").collect()] == [1, 2, 3, 5]
    assert G.trace(e, 5, 1, 9).collect() == []


def test_label_propagation_in_place(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(40)]
    adj = defaultdict(list)
    for a, b in pairs:
        adj[a].append(b)
        adj[b].append(a)
    label = {v: v for v in adj}
    for _ in range(10):
        for v in sorted(adj):
            c = Counter(label[u] for u in adj[v])
            label[v] = min(c, key=lambda k: (-c[k], k))
    assert {r["id"]: r["label"] for r in G.label_propagation_in_place(edges(spark, pairs)).collect()} == label
    with pytest.raises(ValueError):
        G.label_propagation_in_place(edges(spark, pairs), most_edges=3)


def test_layers_condense_cycles(spark):
    got = {r["id"]: r["layer"] for r in G.layers(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (1, 4), (9, 9)])).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 4: 0, 9: 0}


def test_layers_of_a_long_way_take_few_tables(spark, monkeypatch):
    """As many layers as nodes, above a ring as long: no table may be written for each."""
    made = []

    def few(df):
        made.append(df)
        assert len(made) < 10
        return cut(df)

    monkeypatch.setattr(G, "cut", few)
    pairs = [*((i, i + 1) for i in range(300, 600)), *((i, i % 100 + 1) for i in range(1, 101)), (40, 300), *((i, i + 1) for i in range(1000, 1200)), (1200, 7)]
    got = {r["id"]: r["layer"] for r in G.layers(edges(spark, pairs)).collect()}
    assert got == {i: 600 - i for i in range(300, 601)} | {i: 301 for i in range(1, 101)} | {i: 1502 - i for i in range(1000, 1201)}


@pytest.mark.parametrize("most_edges", [0, 8, 1000])
def test_layers_of_graphs_beyond_a_task(spark, most_edges):
    rng = random.Random(6)
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (4, 7), (6, 8), (8, 9), (10, 11), (11, 2), (11, 9), (12, 12), *((rng.randrange(8, 20), rng.randrange(14, 26)) for _ in range(14))]
    far, out = reaches(pairs), defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    layer = dict.fromkeys(far, 0)
    for _ in far:
        layer = {v: max((1 + layer[w] for u in {v, *(x for x in far[v] if v in far[x])} for w in out[u] if u not in far[w]), default=0) for v in far}
    assert {r["id"]: r["layer"] for r in G.layers(edges(spark, pairs), most_edges).collect()} == layer


def test_flows_dedup_equal_sets(spark):
    e = edges(spark, [(1, 2), (2, 3), (4, 2), (5, 6)])
    s = spark.createDataFrame([(i, f"n{i}", "src/a.rb") for i in range(1, 7)], "id long, name string, file string")
    entries = G.entry_points(e, s)
    assert {r["id"] for r in entries.collect()} == {1, 4, 5}
    assert sorted(tuple(r["members"]) for r in G.flows(e, entries, 3, 2).collect()) == [(1, 2, 3), (2, 3, 4)]


def test_flows_offer_what_a_full_node_leaves(spark):
    e = edges(spark, [(0, 1), (0, 2), (1, 10), (1, 11), (1, 12), (1, 13), (2, 13), (13, 14)])
    s = spark.createDataFrame([(i, f"n{i}", "src/a.rb") for i in range(20)], "id long, name string, file string")
    got = [tuple(r["members"]) for r in G.flows(e, G.entry_points(e, s), 4, 3).collect()]
    assert got == [(0, 1, 2, 10, 11, 12, 13, 14)]


@pytest.mark.parametrize("branching", [1, 2, 3])
def test_flows_against_a_queue(spark, branching):
    rng = random.Random(branching)
    rows = [(a, rng.randrange(10, 60), "call", rng.choice(["exact", "probable"])) for a in range(50) for _ in range(rng.randrange(7))]
    e = spark.createDataFrame(rows, "src long, dst long, kind string, tier string")
    best = defaultdict(dict)
    for a, b, _, t in rows:
        best[a][b] = min(best[a].get(b, 1), t != "exact")
    want = {}
    for entry in range(10):
        seen, queue = {entry}, [(entry, 0)]
        for at, d in queue:
            room = branching if d < 4 else 0
            for b in sorted(best[at], key=lambda b: (best[at][b], b)):
                if room and b not in seen:
                    seen.add(b)
                    queue.append((b, d + 1))
                    room -= 1
        if len(seen) >= 3:
            want.setdefault(tuple(sorted(seen)), entry)
    got = {tuple(r["members"]): r["entry"] for r in G.flows(e, spark.range(10), 4, branching).collect()}
    assert got == want


def test_clusters_have_folders_and_words(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 5)])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, label long")
    names = [(1, "load_user_file", "b/x/a.rb"), (2, "load_user_q", "b/x/b.rb"), (3, "save_user", "a/c.rb"), (4, "z_main", "m.rb"), (5, "main", "a/m.rb")]
    s = spark.createDataFrame(names, "id long, name string, file string")
    got = {r["cluster"]: (r["size"], r["cohesion"], r["dir"], r["words"]) for r in G.clusters(e, labels, s).collect()}
    assert got == {1: (3, 1.0, "b/x", "user,load,file,save"), -1: (2, 1.0, "a", "main")}


def test_signature_ignores_order(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "p string, h string")
    assert G.signature(a, "p", "h") == G.signature(a.orderBy("p", ascending=False), "p", "h") != G.signature(a.where("p <> 'z'"), "p", "h")


def test_residues_and_bands(spark):
    spans = spark.createDataFrame([("f", 1, 10), ("g", 1, 3)], "file string, a int, b int")
    covers = spark.createDataFrame([("f", 0, 2), ("f", 4, 6), ("f", 5, 5), ("f", 9, 20), ("g", 1, 3)], "file string, a int, b int")
    assert sorted((r["start"], r["end"]) for r in J.residues(spans, covers, ["file"], "a", "b").collect()) == [(3, 3), (7, 8)]
    rng = random.Random(6)
    l = [(i, rng.randrange(200)) for i in range(40)]
    r = [(i, rng.randrange(200)) for i in range(40)]
    got = J.within(spark.createDataFrame(l, "a long, x long"), spark.createDataFrame(r, "b long, y long"), "x", "y", 7).collect()
    assert sorted((g["a"], g["b"]) for g in got) == sorted((i, j) for i, x in l for j, y in r if abs(x - y) <= 7)
