import json

from pyspark.sql import functions as F

from tracewell.sources import extract as E
from tracewell.sources import files as S
from tracewell.sources import transcripts as R
from tracewell.streaming import events as V


def test_walk_leaves_out_what_it_must(spark, tmp_path):
    for name, text in {"src/a.rs": "fn x() {}", ".git/config": "x", "node_modules/p/i.js": "x", "conf/secrets/k": "x", "id_rsa": "x", "big.txt": "y" * 50, "docs/b.md": "hé", "skip/me.py": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    w = S.walk(spark, f"file://{tmp_path}", ["skip"], 40)
    assert {r["path"] for r in w.collect()} == {"src/a.rs", "docs/b.md", "bin.dat"}
    assert {r["path"]: r["text"] for r in S.texts(w).collect()}["docs/b.md"] == "hé"


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"\x01aa\x02p1 p2\x02Ann\x022026-01-02T03:04:05+01:00\x02Subject\n\nBody\x02\n\x00M\x00src/a.rs\x00A\x00b c.md\x00\x01bb\x02\x02Bo\x02bad\x02x\x02")
    rows = {r["oid"]: r for r in S.git_log(spark, f"file://{tmp_path}/log").collect()}
    assert rows["aa"]["parents"] == ["p1", "p2"] and [tuple(f) for f in rows["aa"]["files"]] == [("M", "src/a.rs"), ("A", "b c.md")]
    assert rows["aa"]["committed_at"].hour == 2 and rows["bb"]["committed_at"] is None and rows["bb"]["parents"] == [] and rows["bb"]["files"] == []


def test_pack_refuses_a_changed_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    S.pack(df, f"file://{tmp_path}/x")
    assert S.unpack(spark, f"file://{tmp_path}/x").count() == 2
    victim = next((tmp_path / "x/data").glob("*.parquet"))
    victim.rename(tmp_path / "x/data/other.parquet")
    try:
        S.unpack(spark, f"file://{tmp_path}/x")
        raise AssertionError("accepted")
    except ValueError:
        pass


def test_actions_and_export(spark, tmp_path):
    row = spark.createDataFrame([(1, "i", "search", 5, "v1", "full", (10, 2))], S.ACTION)
    S.append_actions(row, f"file://{tmp_path}/log")
    S.append_actions(row, f"file://{tmp_path}/log")
    assert S.read_actions(spark, f"file://{tmp_path}/log").select(F.sum("saved.bytes")).first()[0] == 20
    turns = spark.createDataFrame([("s1", "a", 5, "x"), ("s1", "a", 9, "y"), ("s2", "a", 50, "z"), ("s3", "b", None, "w")], "session_id string, agent string, ts long, text string")
    lost = S.export_sessions(turns, f"file://{tmp_path}/out", 6, 20)
    assert [r[0] for r in lost.collect()] == ["s3"] and spark.read.json(f"file://{tmp_path}/out").count() == 2


def test_transcript_source(spark, tmp_path):
    spark.dataSource.register(R.TranscriptSource)
    good = [{"session": "s", "role": "user", "ts": 5, "text": "hi"}, {"role": "assistant", "text": 7}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(good[0]), "{broken", "[1]", json.dumps(good[1])]))
    rows = spark.read.format("transcripts").load(str(tmp_path)).orderBy("seq").collect()
    assert [(r["session"], r["seq"], r["role"], r["ts"], r["text"]) for r in rows] == [("s", 0, "user", 5, "hi"), ("a", 1, "assistant", None, None)]


def test_unit_changes(spark):
    now = spark.createDataFrame([("n", 1, 1, "p"), ("u", 5, 5, "p"), ("a", 9, 6, "p"), ("r", 9, 6, "q"), ("s", 3, 6, "p")], "unit string, size long, mtime long, prefix string")
    state = spark.createDataFrame([(u, 5, 5, 5, "p") for u in "uars"], "unit string, size long, mtime long, bytes long, prefix string")
    got = {r["unit"]: (r["change"], r["from_byte"]) for r in R.classify_units(now, state).collect()}
    assert got == {"n": ("new", 0), "u": ("unchanged", 0), "a": ("appended", 5), "r": ("rewritten", 0), "s": ("rewritten", 0)}
    assert [r["unit"] for r in R.recent(now, 7, 1).orderBy("unit").collect()] == ["a", "r", "s"]


PY = "import os\n\nclass Store:\n    def load(self, key):\n        return fetch(key)\n\ndef main():\n    s = Store()\n    s.load(os.environ['HOME_DIR'])\n"


def test_symbols_and_chunks():
    assert [s[:4] for s in E.symbols_of("a.py", PY)] == [("class", "Store", 3, 5), ("function", "load", 4, 5), ("function", "main", 7, 9)]
    assert E.symbols_of("a.py", PY)[1][4] == ["fetch"] and E.symbols_of("a.txt", PY) == [] and E.symbols_of("a.py", "") == []
    assert E.symbols_of("a.rs", "pub fn go(x: u8) -> u8 {\n    step(x)\n}\nstruct S;\n")[0][:4] == ("function", "go", 1, 3)
    for text in (PY, PY * 40, "", "x" * 5000, "no symbols\nat all"):
        chunks = E.code_chunks("a.py", text)
        held = set()
        for a, b, _ in chunks:
            held |= set(range(a, b))
        assert held >= {i for i, c in enumerate(text) if not c.isspace()}


def test_concepts():
    got = {(k, t) for k, t, _, _ in E.concepts_of("a.ts", "app.get('/v1/users'); res.status(404); const x = process.env.API_KEY; throw 'the cursor moved too far'")}
    assert got == {("route", "GET /v1/users"), ("status", "404"), ("env_read", "API_KEY"), ("string", "the cursor moved too far")}
    assert {(k, t) for k, t, _, _ in E.concepts_of("c.json", '{"a": {"b": "v w"}, "n": [1]}')} == {("config_key", "a.b"), ("string", "v w"), ("config_key", "n")}
    html = {(k, t) for k, t, _, _ in E.concepts_of("a.tsx", '<Panel><input placeholder="Name"/>Sign in</Panel>')}
    assert {("component", "Panel"), ("attr_text", "Name"), ("ui_text", "Sign in")} <= html and E.concepts_of("a.py", "") == []


def test_extraction_over_rows(spark):
    df = spark.createDataFrame([("a.py", PY), ("b.py", None), (None, "x"), ("c.py", "")], "path string, text string")
    assert E.extract_symbols(df).count() == 3 and E.extract_concepts(df).where("kind = 'env_read'").first()["norm"] == "home_dir"


def test_published_generations(spark, tmp_path):
    p = V.Published(spark, f"file://{tmp_path}/t")
    for g in (1, 2):
        p.publish(spark.range(g), g, 1000 * g)
    df, generation, stale = p.read(2500)
    assert (df.count(), generation, stale) == (2, 2, 500)


def test_debounce_and_late_first_sightings(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "path string, at int, what string")
    last, over = V.latest_per_path(rows, "path", "at")
    assert sorted((r["path"], r["what"]) for r in last.collect()) == [("a", "y"), ("b", None)] and not over
    assert V.latest_per_path(rows, "path", "at", 1)[1]
    src = f"file://{tmp_path}/in"
    ev = spark.sql("SELECT * FROM VALUES ('k', TIMESTAMP'2026-01-01 00:00:00'), ('k', TIMESTAMP'2026-01-01 00:05:00'), ('j', TIMESTAMP'2026-01-01 00:01:00') AS t(key, ts)")
    ev.write.parquet(src)
    s = V.first_seen(V.source(spark, src, ev.schema), ["key"], "ts")
    V.run_available(s, f"file://{tmp_path}/cp", lambda b, n: b.write.mode("append").parquet(f"file://{tmp_path}/out"))
    assert sorted(r["key"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["j", "k"]


def test_relations_of_source_text():
    from tracewell.sources import extract as E

    py = "import os\nfrom a.b import c\n\nclass Store(Base, Mixin):\n    def load(self, key):\n        x = Config.default  # not Here\n        return fetch(key)\n\ndef main():\n    run(Store, \"Quoted name()\")\n"
    assert E.relations_of("m.py", py) == [
        ("import", None, "os", 1), ("import", None, "a.b", 2), ("mixin", "Store", "Base", 4), ("mixin", "Store", "Mixin", 4), ("reference", "load", "Config", 6), ("reference", "load", "Here", 6),
        ("call", "load", "fetch", 7), ("call", "main", "run", 10), ("reference", "main", "Store", 10),
    ]
    tsx = "import X from './x'\nconst y = require('./y')\nexport class App extends Page {\n  view() {\n    return <Panel title=\"a\"><X/></Panel>\n  }\n}\n"
    got = E.relations_of("a.tsx", tsx)
    assert {r[:3:2] for r in got} >= {("import", "./x"), ("import", "./y"), ("mixin", "Page"), ("component", "Panel"), ("component", "X")}
    assert ("import", None, "stdio.h", 1) in E.relations_of("a.c", "#include <stdio.h>\nint main(void) {\n  return add(1);\n}\n")
    assert ("import", None, "fmt", 2) in E.relations_of("a.go", 'import (\n  "fmt"\n)\n')
    assert E.relations_of("a.txt", py) == [] and E.relations_of("a.py", "") == []


def test_symbols_of_more_languages():
    from tracewell.sources import extract as E

    cases = {
        "A.java": ("public class A {\n  private int count(List<String> x) {\n    return 1;\n  }\n}\n", [("class", "A"), ("function", "count")]),
        "a.kt": ("data class A(val x: Int)\nfun go(x: Int) {\n}\n", [("class", "A"), ("function", "go")]),
        "a.c": ("struct node {\n  int x;\n};\nstatic int add(int a) {\n  if (a) {\n  }\n}\n", [("struct", "node"), ("function", "add")]),
        "a.php": ("class A {\n  public static function go() {\n  }\n}\n", [("class", "A"), ("function", "go")]),
        "a.swift": ("struct S {\n  func go() {\n  }\n}\n", [("struct", "S"), ("function", "go")]),
        "a.sh": ("build() {\n  make\n}\nfunction test {\n  x\n}\n", [("function", "build"), ("function", "test")]),
        "a.ex": ("defmodule My.App do\n  def run(x), do: x\nend\n", [("module", "My.App"), ("function", "run")]),
        "a.lua": ("local function f(x)\nend\n", [("function", "f")]),
        "a.scala": ("object O {\n  def go(x: Int) = x\n}\n", [("class", "O"), ("function", "go")]),
        "a.cs": ("public sealed class A\n{\n}\n", [("class", "A")]),
    }
    for path, (text, want) in cases.items():
        assert [s[:2] for s in E.symbols_of(path, text)] == want, path


def test_yaml_leaves():
    from tracewell.sources import extract as E

    assert E.yaml_leaves("a:\n  b: 1\n  c:\n    - x\n    - y: 'two'\n# n\nd: \"e f\" # why\n---\nurl: http://x:1/y\n") == [("a.b", "1"), ("a.c", "x"), ("a.c.y", "two"), ("d", "e f"), ("url", "http://x:1/y")]
    assert E.yaml_leaves("") == []
    assert ("config_key", "a.b", 0, 0) in E.concepts_of("x.yml", "a:\n  b: some words here to index\n")


def test_concepts_have_owners(spark):
    from tracewell.sources import extract as E

    text = "TOP = 'three words up here'\ndef a():\n    x = 'three words in a'\n    def b():\n        return 'three words in b'\n"
    f = spark.createDataFrame([("m.py", text), ("n.py", None)], "path string, text string")
    got = {r["raw"]: (r["line"], r["owner"]) for r in E.own_concepts(E.extract_concepts(f), E.extract_symbols(f), f).collect()}
    assert got == {"three words up here": (1, None), "three words in a": (3, "a"), "three words in b": (5, "b")}


def test_binary_files_are_no_texts(spark):
    from tracewell.sources import files as S

    rows = [("a", b"x \ny\x00z"), ("b", b"x \ny"), ("c", b""), ("d", b"\x00"), ("e", "é\u0100".encode())]
    df = spark.createDataFrame([(p, len(c), None, bytearray(c)) for p, c in rows], "path string, size long, modified timestamp, content binary")
    assert {r["path"] for r in S.texts(df).collect()} == {"b", "c", "e"}


def test_history_is_taken_in_by_ticks(spark, tmp_path):
    from tracewell.sources import files as S

    for name in ("log", "patch"):
        (tmp_path / name).mkdir()
    commit = lambda oid, msg, files: f"\x01{oid}\x02p\x02ann\x022026-05-01T10:00:00Z\x02{msg}\x02\n" + "\x00".join(files) + "\x00"
    patch = lambda oid: f"\x01{oid}\x02\n\ndiff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n a\n@@ -9 +10,0 @@\n-b\ndiff --git a/y b/y\nBinary files differ\ndiff --git a/z b/z\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n-c\n"
    (tmp_path / "log" / "1").write_text(commit("a1", "first", ["M", "x.py"]))
    (tmp_path / "patch" / "1").write_text(patch("a1"))
    (tmp_path / "sizes").write_text("b1 blob 12\nb2 missing\nt1 tree 3\n")
    where = [f"file://{tmp_path}/{n}" for n in ("log", "patch", "sizes", "state", "sink")]
    assert S.ingest_history(spark, *where) == 1
    assert S.ingest_history(spark, *where) == 0  # nothing new
    (tmp_path / "log" / "2").write_text(commit("a2", "second", ["A", "y", "D", "z"]) + commit("a3", "third", []))
    (tmp_path / "patch" / "2").write_text(patch("a2"))
    assert S.ingest_history(spark, *where) == 2
    got = spark.read.parquet(f"{where[-1]}/commits")
    assert {r["oid"]: [tuple(f) for f in r["files"]] for r in got.collect()} == {"a1": [("M", "x.py")], "a2": [("A", "y"), ("D", "z")], "a3": []}
    hunks = [(r["oid"], r["path"], r["n"], r["old_start"], r["old_lines"], r["new_start"], r["new_lines"]) for r in spark.read.parquet(f"{where[-1]}/hunks").where("oid = 'a2'").collect()]
    assert sorted(hunks) == [("a2", "x.py", 0, 1, 2, 1, 3), ("a2", "x.py", 1, 9, 1, 10, 0), ("a2", "z", 0, 1, 1, 0, 0)]
    assert [tuple(r) for r in spark.read.parquet(f"{where[-1]}/sizes").collect()] == [("b1", 12)]


def test_a_cursor_outlives_its_reader(spark, tmp_path):
    from tracewell.streaming import events as V

    rows = spark.createDataFrame([(i,) for i in (5, 1, 3, 9, 7)], "id long")
    cursor = V.Cursor(spark, f"file://{tmp_path}/c", 2)
    first = [r["id"] for r in cursor.page(rows, "id", 2).collect()]
    assert first == [3, 5]
    assert [r["id"] for r in V.Cursor(spark, f"file://{tmp_path}/c", 2).page(rows, "id", 2).collect()] == [3, 5]  # not moved: read again
    cursor.advance(5)
    cursor.advance(4)  # never back
    cursor.advance(None)
    again = V.Cursor(spark, f"file://{tmp_path}/c", 2)
    assert again.value() == 5 and sorted(r["id"] for r in again.page(rows, "id").collect()) == [7, 9]


def test_overflow_gives_way_to_a_rescan(spark):
    from tracewell.streaming import events as V

    whole = spark.createDataFrame([("a", 9, "x"), ("b", 1, "y"), ("c", 5, "z")], "path string, at int, v string")
    tick = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "y")], "path string, at int, v string")
    last, full = V.reconciled(tick, "path", "at", lambda: whole, cap=2)
    assert not full and {(r["path"], r["v"]) for r in last.collect()} == {("a", "new"), ("b", "y")}
    last, full = V.reconciled(tick, "path", "at", lambda: whole, cap=1)
    assert full and {(r["path"], r["v"]) for r in last.collect()} == {("a", "x"), ("b", "y"), ("c", "z")}
