import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import tasks
from tracewell.functions import text as T
from tracewell.functions.paths import glob_regex
from tracewell.operators import search as S


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60))
def test_sparse_spans_by_brute_force(data):
    w = [S.pair_weight(data[i : i + 2]) for i in range(len(data) - 1)]
    want = [(i, j + 2) for i in range(len(w)) for j in range(i + 1, len(w)) if 3 <= j + 2 - i <= 100 and all(x < min(w[i], w[j]) for x in w[i + 1 : j])]
    assert S.sparse_spans(data) == sorted(want)
    assert all(any(g in data[a:b] for a, b in want) for g in S.covering(data))


ATOMS = ["abc", "cursor", "a", "[ab]", "[a-z]", ".", "x*", "x+", "(?:foo|bar)", "(?:ab)?", "d{2}", r"\d", "^", "$", "(q|r)s"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), min_size=1, max_size=6), st.lists(st.sampled_from(["abc", "cursor", "foo", "bar", "ab", "x", "dd", "q", "s", "r", " ", "7", "z"]), max_size=10))
def test_plans_are_sound(parts, words):
    pattern, text = "".join(parts), "".join(words)
    plan = S.plan_pattern(pattern)
    have = {text.lower()[i : i + 3] for i in range(len(text) - 2)}

    def holds(p):
        if p.op == "gram":
            return p.gram in have
        return True if p.op == "all" else (all if p.op == "and" else any)(map(holds, p.parts))

    if re.search(pattern, text):
        assert holds(plan), (pattern, text, plan)


def test_plans_require_something():
    assert S.plan_pattern("cursor").grams() == ["cur", "rso", "sor", "urs"]
    assert S.plan_pattern("(?:foo|bar)baz").op == "or"
    assert S.plan_pattern("a.b").op == "all" and S.plan_pattern("").op == "all"


def test_index_round_trip_equals_scan(spark, tmp_path):
    rng = random.Random(3)
    words = ["cursor", "daemon", "Stale", "postings", "x", "größe", "", "漢字テキスト"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(8))) + "\n" + rng.choice(words)) for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    docs = spark.createDataFrame(rows, "id long, body string")
    S.write_index(docs, "id", "body", f"{tmp_path}/i", 4)
    for pattern in ("cursor daemon", "Stale|größe", "漢字テ", "x$", "(?:post|dae)[a-z]+ x"):
        plan = S.plan_pattern(pattern)
        post = S.read_postings(spark, f"{tmp_path}/i", plan.grams(), 4) if plan.grams() else None
        got = sorted(tuple(r) for r in S.search(docs, "id", "body", pattern, post).collect())
        want = sorted((i, n, s) for i, t in rows if t for n, s in enumerate(t.split("\n"), 1) if re.search(pattern, s))
        assert got == want, pattern
    assert S.postings(docs.limit(0), "id", "body").count() == 0
    assert S.candidate_count(S.postings(docs, "id", "body"), []) is None


def test_pages_tell_truncation_exactly(spark):
    m = spark.createDataFrame([(i, i % 3) for i in range(10)], "k long, line int")
    assert [r["k"] for r in S.page(m, ["k"], 2, 3).collect()] == [2, 3, 4]
    assert {r["truncated"] for r in S.page(m, ["k"], 5, 5).collect()} == {False}
    assert {r["truncated"] for r in S.page(m, ["k"], 4, 5).collect()} == {True}
    assert S.page(m, ["k"], 50, 5).collect() == []


def test_layers_newest_wins(spark):
    mk = lambda rows: spark.createDataFrame(rows, "k string, v string")
    out = S.layered(mk([("a", "0"), ("b", "0"), ("c", "0")]), mk([("b", "1"), ("d", "1")]), mk([("c", ""), ("d", ""), ("e", "")]), mk([("e", "2"), ("b", None)]), "k")
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [("a", "0"), ("b", None), ("e", "2")]


def test_globs():
    ok = lambda g, p: bool(re.search(glob_regex(g), p))
    assert ok("*.rs", "a/b/c.rs") and ok("src/*.rs", "src/a.rs") and not ok("src/*.rs", "src/b/a.rs") and ok("src", "x/src/y") and ok("/src/**", "src/a/b")
    assert ok("**/b/*.py", "a/b/c.py") and ok("{a,b}.md", "x/a.md") and not ok("[!a].c", "a.c") and ok("?.c", "a.c")


MESSAGES = {
    "see https://x.io/a?b=1, now": "see <url>, now", "at 2026-01-02T03:04:05Z ok": "at <ts> ok", "id deadbeef42 gone": "id <hex> gone", "row 12345678 of 1234567": "row <hex> of <num>",
    "n 1234 12345": "n 1234 <num>", "deadbeefcafeX stays": "deadbeefcafeX stays", "  a \n b ": "a b", "": "",
}


def test_text_functions(spark):
    got = spark.createDataFrame([(m,) for m in MESSAGES], "m string").select("m", T.normalize_message(F.col("m")).alias("n")).collect()
    assert {r["m"]: r["n"] for r in got} == MESSAGES
    names = {"fooBarHTTPServer": ["foo", "bar", "http", "server"], "snake_case::X#y.z-q": ["snake", "case", "x", "y", "z", "q"], "": [], "A": ["a"]}
    got = spark.createDataFrame([(n,) for n in [*names, None]], "n string").select("n", T.split_ident_words(F.col("n")).alias("w")).collect()
    assert {r["n"]: r["w"] for r in got} == {**names, None: None}
    assert all(tasks.ident_words(n) == w for n, w in names.items())
    fnv = spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(T.fnv1a64(F.col("s")).alias("h")).collect()
    assert [r["h"] & (2**64 - 1) for r in fnv] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    c = spark.createDataFrame([("größe" * 3,)], "s string").select(T.cap_text(F.col("s"), 4).alias("c"), T.nfc(F.lit("é")).alias("n")).first()
    assert c["c"]["text"] == "grö" and c["c"]["truncated"] and c["n"] == "é"
    fr = spark.createDataFrame([([("node_modules/x.js", 1), ("a.rb", 2), ("node:fs", 3), ("b.rb", 4), ("c.rb", 5), ("d.rb", 6)],), (None,)], "f array<struct<file string, line int>>")
    assert [r["t"] for r in fr.select(T.top_app_frames(F.col("f")).alias("t")).collect()] == [["a.rb:2", "b.rb:4", "c.rb:5"], []]
    w = spark.range(1).select(T.wilson(F.lit(0), F.lit(0)).alias("w"), T.savings_ratio(F.lit(3), F.lit(0)).alias("r"), T.saved_percent(F.lit(0), F.lit(0)).alias("p")).first()
    assert tuple(w["w"]) == (0.0, 1.0) and w["r"] is None and w["p"] is None


def test_tasks():
    t = tasks.read_task("Fix `retryLoop` in src/net/cursor_store.rs when the daemon drops HTTPServer frames")
    assert t.paths == ["src/net/cursor_store.rs"] and {"retryLoop", "cursor_store"} <= set(t.exact) and {"daemon", "http", "server", "cursor", "store"} <= set(t.keywords) and "rs" not in t.keywords
    assert tasks.read_task("pourquoi la déconnexion échoue dans le serveur").language == "fr"
    assert len(tasks.read_task(" ".join(f"word{chr(97 + i)}x" for i in range(20))).keywords) == 12
    with pytest.raises(ValueError):
        tasks.read_task("the and of")
    assert tasks.compile_query("show impact of x")[1] == [("impact.v1", ["impact"])] and len(tasks.compile_query("hm")[1]) == 2
    assert tasks.split_budget(1000, 3) == [600, 150, 150] and tasks.prompt_terms("renaming shipped sounds") == ["renam", "ship", "sound"]
    assert T.sanitize_query('lost "kept phrase" x ab') == ["kept phrase", "lost", "ab"] and T.sanitize_query('gone "open end') == ["open", "end"]
    assert T.window_ms("24h") == 86_400_000 and T.window_ms("all") is None
    out = tasks.bundle({"a": lambda: 1, "b": lambda: 1 / 0})
    assert out["a"] == 1 and isinstance(out["b"], ZeroDivisionError)


def test_anchors_of_the_text_hold_per_line(spark):
    docs = spark.createDataFrame([(1, "x\nfoo bar"), (2, "foo\nx"), (3, "no")], "id long, body string")
    for pattern in (r"\Afoo", r"^foo", r"foo(?=\z| bar)", r"(?<!x)foo"):
        got = {(r["id"], r["line"]) for r in S.lines_matching(docs, "id", "body", pattern).collect()}
        assert got == {(1, 2), (2, 1)}, pattern


def test_segments_append_and_merge(spark, tmp_path):
    rows = [(i, f"turn {i} " + ("stale cursor" if i % 3 else "warm shard")) for i in range(40)]
    df = lambda part: spark.createDataFrame(part, "id long, body string")
    index = S.Segments(spark, f"file://{tmp_path}/i")
    assert index.postings() is None and index.merge(10) == 0
    for lo, hi in ((0, 25), (25, 30), (30, 33), (33, 40)):
        index.append(df(rows[lo:hi]), "id", "body")
    want = {(r["gram"], d) for r in S.postings(df(rows), "id", "body").collect() for d in r["docs"]}
    held = lambda: [(r["gram"], d) for r in index.postings().collect() for d in r["docs"]]
    assert len(held()) == len(set(held())) and set(held()) == want
    assert index.merge(10) == 3 and index.merge(10) == 0
    assert len(held()) == len(set(held())) and set(held()) == want
    assert not S.overlay_full(df(rows), df([])) and S.overlay_full(df(rows), df([]), files=39) and S.overlay_full(df([]), df(rows), dead=39)


def test_lookups_in_a_small_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd"), (2, "bcde"), (3, None), (4, "")], "id long, body string")
    S.write_index(docs, "id", "body", f"file://{tmp_path}/i")
    find = lambda *g: {r["gram"]: r["docs"] for r in S.read_postings(spark, f"file://{tmp_path}/i", list(g)).collect()}
    assert find("bcd", "zzz") == {"bcd": [1, 2]} and find("zzz") == {} and find() == {}
    long = "|".join(f"x{i:03d}yz" for i in range(80)) + "|abcd"  # more grams than a long has bits
    assert len(S.plan_pattern(long).grams()) > S.MASK
    got = S.search(docs, "id", "body", long, f"file://{tmp_path}/i").collect()
    assert [(r["id"], r["line"]) for r in got] == [(1, 1)]
