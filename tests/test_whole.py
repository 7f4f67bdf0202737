"""Queries over their whole tables, against plain Python on the smallest tables."""

from collections import defaultdict
from functools import cache
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracewell.plans import graphs
from tracewell.sources import relations as R

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


def query(spark, name):
    return entry.queries()[name](spark, DATA)


def test_cluster_co_files_of_every_symbol(spark):
    files = {r["id"]: r["file"] for r in R.symbols(spark, DATA).collect()}
    called = {x for r in graphs._calls(spark, DATA).collect() for x in (r["src"], r["dst"])}
    assert {r["path"] for r in query(spark, "cluster_co_files").collect()} == {files[i] for i in called if i in files}


def test_every_repository_fans_out(spark):
    paths = [r["file"] for r in R.symbols(spark, DATA).collect()]
    assert all("/" in p for p in paths)
    assert {r["repo"] for r in query(spark, "workspace_fan_out").collect()} == {p.split("/")[0] for p in paths}


def test_layers_of_all_calls(spark, monkeypatch):
    base = [(r["src"], r["dst"]) for r in graphs._calls(spark, DATA).collect()]
    top = max(x for p in base for x in p)
    pairs = [*base, *((b, a) for a, b in base[::7]), (top, top + 1), (top + 1, top + 2), (top + 2, top + 1), (top + 2, top + 2)]  # cycles, whatever the tables hold
    monkeypatch.setattr(graphs, "_calls", lambda *_: spark.createDataFrame(pairs, "src long, dst long"))
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)

    @cache
    def far(v):
        seen, todo = {v}, [v]
        while todo:
            new = out[todo.pop()] - seen
            seen |= new
            todo += new
        return frozenset(seen)

    nodes = {x for p in pairs for x in p}

    @cache
    def layer(v):
        return max((1 + layer(w) for u in far(v) if v in far(u) for w in out[u] if v not in far(w)), default=0)

    assert any(v in far(u) for v in nodes for u in far(v) - {v})
    assert {r["id"]: r["layer"] for r in query(spark, "layers_longest_path").collect()} == {v: layer(v) for v in nodes}


def test_conflict_classes_name_every_pair(spark):
    """Two regions are in a class of one another exactly if they share a file, a name, a call or an import."""
    import random

    from tracewell.operators import joins

    rng = random.Random(3)
    regions = [(f"r{i}", rng.choice("ABCD"), rng.choice("xyz")) for i in range(25)]
    calls = [(rng.choice(regions)[0], rng.choice([*regions, ("gone",)])[0]) for _ in range(12)]
    imports = [(rng.choice("ABCDE"), rng.choice("ABCDE")) for _ in range(5)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = joins.conflicts(df(regions, "uid string, file string, name string"), df(calls, "caller string, callee string"), df(imports, "importer string, imported string")).collect()
    by = {"same-file": lambda r, w: r[1] == w, "same-name": lambda r, w: r[2] == w, "call-edge": lambda r, w: r[0] == w, "import-adjacency": lambda r, w: r[1] == w}
    pairs = {(g["reason"], frozenset((g["uid"], r[0]))) for g in got for r in regions if r[0] != g["uid"] and by[g["reason"]](r, g["with"])}
    want = set()
    for a in regions:
        for b in regions:
            if a[0] != b[0]:
                p = frozenset((a[0], b[0]))
                want |= {("same-file", p)} if a[1] == b[1] else set()
                want |= {("same-name", p)} if a[2] == b[2] else set()
                want |= {("call-edge", p)} if (a[0], b[0]) in calls else set()
                want |= {("import-adjacency", p)} if (a[1], b[1]) in imports and a[1] != b[1] else set()
    assert pairs == want
    assert all(g["others"] == sum(1 for r in regions if r[0] != g["uid"] and by[g["reason"]](r, g["with"])) for g in got)


def test_spans_meet_in_buckets(spark):
    import random

    from tracewell.operators import joins

    rng = random.Random(6)
    span = lambda n, p: [(f"{p}{i}", rng.choice("FG"), lo := rng.randrange(300), lo + rng.choice([0, 3, 90, 250])) for i in range(n)]
    a, b = span(30, "a"), span(30, "b")
    da, db = spark.createDataFrame(a, "a string, file string, alo int, ahi int"), spark.createDataFrame(b, "b string, file string, blo int, bhi int")
    got = [(r["a"], r["b"]) for r in joins.overlapping(da, db, ["file"], ("alo", "ahi"), ("blo", "bhi")).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])


def test_ranks_with_nulls_and_no_group(spark):
    from tracewell.operators import rank

    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None), (5, None), (6, 1)], "id int, v int")
    assert {r["id"]: r["rank"] for r in rank.competition_ranks(df, "v").collect()} == {3: 1, 1: 2, 2: 2, 6: 4, 4: 5, 5: 5}


def test_neighbours_in_several_passes(spark, monkeypatch):
    import numpy as np

    from tracewell.operators import vectors as V

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    monkeypatch.setattr(V, "PASS_BYTES", 1)
    got = V.neighbours(df.where("k < 60"), df, "k", "v", 3, block=7).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    for i in range(60):
        want = sorted((j for j in range(60) if j != i), key=lambda j: (-sims[i, j], j))[:3]
        assert [r["k"] for r in sorted((r for r in got if r["query"] == i), key=lambda r: (-r["score"], r["k"]))] == want
