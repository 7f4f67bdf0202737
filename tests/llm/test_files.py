from tracewell.llm import sources as S

HAND = "class Store\n  # Keys here are generated by the daemon, not by this file; edit freely.\n  def load(key)\n    raise ArgumentError if key.nil?\n    @store.fetch(key, 42)\n  end\nend\n"
UPSTREAM = "# Acme 1.2\n" + "\n".join(f"def step_{w}(item)\n  item.{w} unless item.nil?\n  keep_{w}(item, :{w})\nend" for w in "alpha beta gamma delta omega sigma kappa".split())
NUMBERED = "\n".join(f"  CODE_{i} = [:name, {i}, {i + 2}].freeze" for i in range(9))
MINIFIED = "!function(n){y&&b(m.x)}(c);function b(o,v){return y.split(l)||8}r.y='m';for(i=0;q<n.length;l++)n[m]^=209;" * 4
B64 = 'DATA = "' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9w" * 6 + '"'
CASES = {
    "r/app/hand.rb": (HAND, None),
    "r/app/banner.rb": ('BANNER = "Code generated by stub. DO NOT EDIT."\n' + HAND, None),
    "r/app/long_line.rb": (HAND + '\n  NOTE = "' + "words of a long note " * 40 + '"\n', None),
    "r/lib/vendor_portal/min.rb": (HAND, None),
    "r/app/marked.rb": ("# Code generated by stub. DO NOT EDIT.\n" + HAND, "generated"),
    "r/app/late.rb": (HAND + "\n# @generated by tool 1.0\n", "generated"),
    "r/app/gen/x.rb": (HAND, "generated"),
    "r/app/x.pb.rb": (HAND, "generated"),
    "r/app/numbered.rb": (NUMBERED, "generated"),
    "r/app/mini.js": (MINIFIED, "minified"),
    "r/public/a.min.js": (HAND, "minified"),
    "r/vendor/z/a.rb": (HAND, "vendored"),
    "r/app/copied.rb": ("# local header\n" + UPSTREAM.replace("keep_gamma", "hold_gamma") + "\ndef extra(x)\n  x\nend\n", "vendored"),
    "r/app/table.rb": ("id,when,name,amount\n" + "\n".join(f"{i},2025-09-1{i % 9},part,{i * 7}.10" for i in range(20)), "data"),
    "r/app/blob.py": (B64, "data"),
    "r/app/cells.ts": ("{\n" + ' "cells": [\n  {\n   "kind": "code",\n   "n": 0\n  }\n ]\n' * 5 + "}\n", "data"),
    "r/app/empty.rb": ("", None),
    "r/app/null.rb": (None, None),
}


def test_kinds_of_files(spark):
    rows = [(p, "ruby", None, t, "clash") for p, (t, _) in CASES.items()] + [("r/app/hash.rb", None, "AB12", HAND, "clash")]
    files = spark.createDataFrame(rows, "path string, lang string, hash string, head string, language string")
    up = spark.createDataFrame([("ab12", "acme", "1.2", "ruby", "acme.rb", UPSTREAM), (None, None, None, None, None, None)], "hash string, package string, version string, lang string, file_name string, head string")
    got = {r["path"]: r for r in S.classify(files, up).collect()}
    assert len(got) == len(rows) and got["r/app/hash.rb"]["vendored"]
    for p, (_, kind) in CASES.items():
        assert got[p]["by_hand"] == (kind is None), (p, got[p])
        assert kind is None or got[p][kind], (p, got[p])
    assert S.classify(files.limit(0), up).collect() == [] and S.classify(files, up.limit(0)).count() == len(rows)


def test_very_long_text(spark):
    rows = [("r/a.rb", None, None, HAND * 3000)]
    files = spark.createDataFrame(rows, "path string, lang string, hash string, head string")
    up = spark.createDataFrame([("h", "p", "v", "ruby", "f", UPSTREAM)], "hash string, package string, version string, lang string, file_name string, head string")
    assert S.classify(files, up).first()["by_hand"]


def kinds(spark, rows, upstream=()):
    files = spark.createDataFrame([(p, None, None, t) for p, t in rows.items()], "path string, lang string, hash string, head string")
    up = spark.createDataFrame([("h", "p", "1", "ruby", f"f{i}.rb", t) for i, t in enumerate(upstream)], "hash string, package string, version string, lang string, file_name string, head string")
    return {r["path"]: [k for k in ("generated", "minified", "vendored", "data") if r[k]] for r in S.classify(files, up).collect()}


def test_a_shared_licence_line_is_no_copy(spark):
    line = "# Copyright the authors of this"
    got = kinds(spark, {"r/a.rb": f"{line}\n{HAND}", "r/b.rb": line}, [f"{line}\n"])
    assert got == {"r/a.rb": [], "r/b.rb": []}


def test_provenance_is_read_as_a_sentence(spark):
    made = ["Code generated by x. DO NOT EDIT.", "This file was automatically generated from a.idl", "AUTO-GENERATED FILE", "File emitted by the x compiler", "THIS IS A MACHINE-WRITTEN FILE", "Automatisch erzeugt mit x",
            "Generado automáticamente", "Généré par x", "Erzeugt von x", "Generated with x, do not modify", "Do not edit: generated", "Dieser Code wurde automatisch generiert", "@generated"]
    told = ["Written by Ada in May", "Generated ids are unique", "Keys here are generated by the daemon; edit freely", "Created from the form below", "The file is read by the daemon", "Do not edit the lock by hand", "emit generated code"]
    rows = {f"r/m{i}.rb": f"# {t}\n{HAND}" for i, t in enumerate(made)} | {f"r/t{i}.rb": f"# {t}\n{HAND}" for i, t in enumerate(told)}
    got = kinds(spark, rows)
    assert {p for p, k in got.items() if k} == {f"r/m{i}.rb" for i in range(len(made))}


def test_layout_statistics_decide(spark):
    few = HAND + "\n".join(f"x_{i} = load(:a{i})" for i in range(5)) + "\n" + HAND * 5  # five numbered names in hand-written text
    long_line = HAND * 3 + "  # " + "a plain remark " * 100 + "\n"
    odd = "\n".join("((;;" + "[]{}<>" * 6 for _ in range(10))
    got = kinds(spark, {"r/few.rb": few, "r/long.rb": long_line, "r/odd.rb": odd})
    assert got == {"r/few.rb": [], "r/long.rb": ["minified"], "r/odd.rb": ["data"]}


def test_real_files_held_out(spark):
    """pandas and numpy, looked at by nobody who set a limit: almost all by hand."""
    from pathlib import Path

    import numpy
    import pandas

    paths = [p for m in (pandas, numpy) for p in sorted(Path(m.__file__).parent.rglob("*.py")) if "tests" not in p.parts]
    texts = {f"r/{i}.py": p.read_text(encoding="utf-8", errors="replace")[:4096] for i, p in enumerate(paths)}
    got = kinds(spark, {p: t for p, t in texts.items() if t.strip()})
    assert len(got) > 300 and sum(1 for k in got.values() if not k) / len(got) > 0.95
