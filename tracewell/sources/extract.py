"""Symbols, calls and concepts from source text by regular expressions.

No grammar library is at hand, so this reads declarations line by line: it knows the
declaring keywords of fifteen languages, takes a symbol to end before the next one of no
deeper indent, and does not follow macros, nested strings or multi-line signatures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import joins
from tracewell.session import cut

#: per language: pattern with groups kind and name
DECLARES = {
    "rb": r"^(?P<i>\s*)(?P<k>def|class|module)\s+(?:self\.)?(?P<n>[A-Za-z_][\w:]*[?!]?)",
    "py": r"^(?P<i>\s*)(?:async\s+)?(?P<k>def|class)\s+(?P<n>[A-Za-z_]\w*)",
    "rs": r"^(?P<i>\s*)(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?P<k>fn|struct|enum|trait|mod|const|static)\s+(?P<n>[A-Za-z_]\w*)",
    "go": r"^(?P<i>\s*)(?P<k>func|type)\s+(?:\([^)]*\)\s*)?(?P<n>[A-Za-z_]\w*)",
    "js": r"^(?P<i>\s*)(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<k>function|class|interface|const)\s+(?P<n>[A-Za-z_$][\w$]*)",
}
DECLARES["ts"] = DECLARES["tsx"] = DECLARES["jsx"] = DECLARES["mjs"] = DECLARES["js"]
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|open|virtual|async|inline|suspend|data|partial|case|implicit|lazy|export)\s+)*"
DECLARES |= {
    "java": rf"^(?P<i>\s*){_MODIFIERS}(?P<k>class|interface|enum|record)\s+(?P<n>[A-Za-z_]\w*)|^(?P<i2>\s+){_MODIFIERS}[\w<>\[\],.? ]+\s+(?P<n2>[a-z_]\w*)\s*\([^;]*\)[^;]*\{{\s*$",
    "kt": rf"^(?P<i>\s*){_MODIFIERS}(?P<k>class|interface|object|fun)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>[A-Za-z_]\w*)",
    "scala": rf"^(?P<i>\s*){_MODIFIERS}(?P<k>class|object|trait|def)\s+(?P<n>[A-Za-z_]\w*)",
    "c": r"^(?P<i>\s*)(?:typedef\s+)?(?P<k>struct|enum|class|namespace)\s+(?P<n>[A-Za-z_]\w*)[^;]*\{|^(?P<i2>)[A-Za-z_][\w\s*&<>:,]*?[\s*&](?P<n2>[A-Za-z_]\w*(?:::~?\w+)?)\s*\([^;]*\)[^;]*\{?\s*$",
    "php": rf"^(?P<i>\s*){_MODIFIERS}(?P<k>function|class|interface|trait|enum)\s+&?(?P<n>[A-Za-z_]\w*)",
    "swift": rf"^(?P<i>\s*){_MODIFIERS}(?P<k>func|class|struct|enum|protocol)\s+(?P<n>[A-Za-z_]\w*)",
    "sh": r"^(?P<i>\s*)(?:(?P<k>function)\s+(?P<n>[A-Za-z_][\w-]*)|(?P<n2>[A-Za-z_][\w-]*)\s*\(\)\s*\{)",
    "lua": r"^(?P<i>\s*)(?:local\s+)?(?P<k>function)\s+(?P<n>[A-Za-z_][\w.:]*)",
    "ex": r"^(?P<i>\s*)(?P<k>defmodule|defp?|defmacro)\s+(?P<n>[A-Za-z_][\w.]*[?!]?)",
}
DECLARES["cs"], DECLARES["h"], DECLARES["cpp"], DECLARES["hpp"], DECLARES["cc"], DECLARES["bash"], DECLARES["exs"] = DECLARES["java"], *[DECLARES["c"]] * 4, DECLARES["sh"], DECLARES["ex"]
#: The engine's symbol kinds by keyword.
KINDS = {"def": "function", "fn": "function", "func": "function", "function": "function", "class": "class", "module": "module", "mod": "module", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface", "type": "struct", "const": "const", "static": "const", "record": "class", "object": "class", "fun": "function", "namespace": "module", "protocol": "interface", "defmodule": "module", "defp": "function", "defmacro": "function"}
_CALL = re.compile(r"(?<![\w.])(?:[A-Za-z_]\w*(?:\.|::))*([a-z_]\w*)\s*\(")
_WORDS = {"if", "for", "while", "return", "def", "fn", "func", "function", "match", "switch", "catch", "print", "and", "or", "not", "in"}


def symbols_of(path: str, text: str) -> list[tuple[str, str, int, int, list[str]]]:
    """(kind, name, line, end_line, called names) of one file; none for other languages."""
    pattern = DECLARES.get(path.rsplit(".", 1)[-1])
    if not pattern or not text:
        return []
    lines = text.split("\n")
    found = []
    for n, line in enumerate(lines, 1):
        if m := re.match(pattern, line):
            g = m.groupdict()
            name, kind = g["n"] or g.get("n2"), KINDS[g["k"]] if g.get("k") else "function"
            if name not in _WORDS:
                found.append((len((g.get("i") or g.get("i2") or "").expandtabs(4)), kind, name, n))
    out = []
    for at, (indent, kind, name, line) in enumerate(found):
        end = next((l - 1 for i, _, _, l in found[at + 1 :] if i <= indent), len(lines))
        while end > line and not lines[end - 1].strip():
            end -= 1
        calls = [c for x in lines[line:end] for c in _CALL.findall(x) if c not in _WORDS]
        out.append((kind, name, line, end, list(dict.fromkeys(calls))))
    return out


def extract_symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, kind, name, line, end_line, calls`` over any number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(f, *s) for f, t in zip(p[path], p[text]) for s in symbols_of(f or "", t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "line", "end_line", "calls"])

    return files.select(path, text).mapInPandas(run, "path string, kind string, name string, line int, end_line int, calls array<string>")


#: per language: what an import names
IMPORTS = {
    "py": r"^\s*(?:from\s+([\w.]+)\s+import\b|import\s+([\w.]+))",
    "js": r"(?:^\s*(?:import|export)\b[^'\"]*|\brequire\(\s*|\bimport\(\s*)['\"]([^'\"]+)['\"]",
    "rb": r"^\s*(?:require|require_relative|load)\s*\(?\s*['\"]([^'\"]+)['\"]",
    "rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:use\s+([\w:]+)|mod\s+(\w+)\s*;)",
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)", "cs": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "swift": r"^\s*import\s+(?:\w+\s+)?([\w.]+)",
    "c": r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", "php": r"^\s*(?:use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+))",
    "lua": r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", "ex": r"^\s*(?:alias|import|use|require)\s+([A-Z][\w.]*)", "sh": r"^\s*(?:source|\.)\s+([\w./-]+)",
}
IMPORTS |= {e: IMPORTS[k] for e, k in {"jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "kt": "java", "scala": "java", "h": "c", "cpp": "c", "hpp": "c", "cc": "c", "bash": "sh", "exs": "ex"}.items()}
_MIXIN = {
    "rb": r"^\s*(?:include|extend|prepend)\s+([A-Z][\w:]*)|^\s*class\s+\S+\s*<\s*([A-Z][\w:]*)", "py": r"^\s*class\s+\w+\(([^)]*)\)", "js": r"\bclass\s+\w+(?:<[^>]*>)?\s+(?:extends|implements)\s+([\w., ]+)",
    "rs": r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\b", "java": r"\b(?:extends|implements)\s+([\w., ]+)", "php": r"\b(?:extends|implements)\s+([\w\\, ]+)|^\s+use\s+([A-Z]\w*)\s*;",
}
_MIXIN |= {e: _MIXIN["js"] for e in ("jsx", "ts", "tsx", "mjs")} | {e: _MIXIN["java"] for e in ("kt", "scala", "cs", "swift")}
_REFERENCE = re.compile(r"(?<![\w.\"'])([A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*)\b(?!\s*\()")
_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'")
_REMARK = re.compile(r"^\s*(?://|#(?!\s*include)|\*|--)")


def relations_of(path: str, text: str) -> list[tuple[str, str | None, str, int]]:
    """(kind, innermost symbol or None, target, line): ``call``, ``import``, ``mixin``,
    ``reference`` (a capitalised name that is not called) and ``component`` (markup)."""
    ext = path.rsplit(".", 1)[-1]
    if ext not in DECLARES or not text:
        return []
    symbols = symbols_of(path, text)
    out: dict[tuple, None] = {}
    for n, line in enumerate(text.split("\n"), 1):
        if _REMARK.match(line):
            continue
        inside = [s for s in symbols if s[2] <= n <= s[3]]
        owner = min(inside, key=lambda s: (s[3] - s[2], -s[2]))[1] if inside else None
        if (m := re.search(IMPORTS[ext], line)) if ext in IMPORTS else None:
            out[("import", owner, next(g for g in m.groups() if g), n)] = None
            continue
        declared = {s[1] for s in symbols if s[2] == n}
        bare = _QUOTED.sub('""', line)
        mixed = set()
        if m := re.search(_MIXIN[ext], bare) if ext in _MIXIN else None:
            for t in re.split(r"[,\s]+", next((g for g in m.groups() if g), "")):
                if t and t not in ("implements", "extends") and "=" not in t:
                    mixed.add(t)
                    out[("mixin", owner, t, n)] = None
        if ext in ("jsx", "tsx"):
            for m in _COMPONENT.finditer(bare):
                mixed.add(m[1])
                out[("component", owner, m[1], n)] = None
        for c in _CALL.findall(bare):
            if c not in _WORDS and c not in declared:
                out[("call", owner, c, n)] = None
        for m in _REFERENCE.finditer(bare):
            if m[1] not in declared and m[1] not in mixed:
                out[("reference", owner, m[1], n)] = None
    return list(out)


def extract_relations(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, kind, owner, target, line`` over any number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(f, *r) for f, t in zip(p[path], p[text]) for r in relations_of(f or "", t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "owner", "target", "line"])

    return files.select(path, text).mapInPandas(run, "path string, kind string, owner string, target string, line int")


def yaml_leaves(text: str) -> list[tuple[str, str]]:
    """(dotted key, value) of the scalars of plain block YAML; flow values, anchors and
    block scalars count as their first line."""
    out, stack = [], []
    for line in text.split("\n"):
        body = line.split(" #", 1)[0].rstrip()
        if not body.strip() or body.lstrip().startswith(("#", "---", "...")):
            continue
        indent = len(body) - len(body.lstrip())
        item = body.lstrip()
        while item.startswith("- ") or item == "-":
            indent += 2
            item = item[1:].lstrip()
        while stack and stack[-1][0] >= indent:
            stack.pop()
        m = re.match(r"(\"[^\"]+\"|'[^']+'|[^\s:#][^:#]*?)\s*:(?:\s+(.*))?$", item)
        prefix = ".".join(k for _, k in stack)
        if m:
            key = m[1].strip("\"'")
            full = f"{prefix}.{key}" if prefix else key
            if m[2]:
                out.append((full, m[2].strip().strip("\"'")))
            stack.append((indent, key))
        elif item:
            out.append((prefix, item.strip("\"'")))
    return out


def code_chunks(path: str, text: str, pack: int = 400, window: int = 1500, overlap: int = 200) -> list[tuple[int, int, str | None]]:
    """(start, end, symbol) in characters: whole symbols packed up to ``pack``, larger
    pieces windowed; together they cover every line."""
    if not text:
        return []
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    marks = sorted({1, *(s[2] for s in symbols_of(path, text))})
    names = {s[2]: s[1] for s in reversed(symbols_of(path, text))}
    last = text.count("\n") + 2
    pieces = [(starts[a - 1], min(starts[b - 1], len(text)), names.get(a)) for a, b in zip(marks, [*marks[1:], last])]
    out: list[tuple[int, int, str | None]] = []
    for a, b, n in pieces:
        if b <= a:
            continue
        if out and b - out[-1][0] <= pack and out[-1][1] == a:
            out[-1] = (out[-1][0], b, out[-1][2] or n)
        elif b - a <= window:
            out.append((a, b, n))
        else:
            out += [(x, min(x + window, b), n) for x in range(a, max(b - overlap, a + 1), window - overlap)]
    return out


_STATUS = re.compile(r"\b(?:status|code)\W{1,4}([1-5]\d\d)\b")
_ENV = re.compile(r"(?:env(?:::var)?!?\(|ENV\[|process\.env\.|os\.environ(?:\.get\(|\[)|getenv\()\s*[\"']?([A-Z][A-Z0-9_]+)")
_ROUTE = re.compile(r"\b(get|post|put|patch|delete|head|options)\b\W{1,3}[\"'](/[^\"']*)[\"']")
_ATTR = re.compile(r"\b(placeholder|label|aria-label|title|alt|name|data-testid)=\"([^\"]+)\"")
_TEXT = re.compile(r">([^<>{}\n]*[A-Za-z][^<>{}\n]*)<")
_COMPONENT = re.compile(r"<([A-Z]\w*)")
_FORM = re.compile(r"<[Ff]orm\b|\b(?:useForm|useFormik|createForm)\(")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)'")


def concepts_of(path: str, text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of one file: routes, statuses, environment reads,
    attributes, markup text, components, forms, strings worth indexing, and the keys and
    leaves of JSON."""
    import json

    out: list[tuple[str, str, int, int]] = []
    if not text:
        return out
    ext = path.rsplit(".", 1)[-1]
    if ext in ("yaml", "yml"):
        for key, value in yaml_leaves(text):
            out += [("config_key", key, 0, 0)] * bool(key) + [("string", value, 0, 0)] * bool(value)
        return sorted(set(out))
    if ext == "json":
        try:
            todo = [("", json.loads(text))]
        except ValueError:
            return out
        while todo:
            key, v = todo.pop()
            if isinstance(v, dict):
                todo += [(f"{key}.{k}" if key else k, x) for k, x in v.items()]
            elif isinstance(v, list):
                todo += [(key, x) for x in v]
            else:
                out.append(("config_key", key, 0, 0))
                if isinstance(v, str) and v:
                    out.append(("string", v, 0, 0))
        return sorted(set(out))
    add = lambda kind, m, g: out.append((kind, m[g], m.start(g), m.end(g)))
    for m in _STATUS.finditer(text):
        add("status", m, 1)
    for m in _ENV.finditer(text):
        add("env_read", m, 1)
    for m in _ROUTE.finditer(text):
        out.append(("route", f"{m[1].upper()} {m[2]}", m.start(), m.end()))
    if ext in ("jsx", "tsx", "html", "vue", "svelte"):
        for kind, rx, g in (("attr_text", _ATTR, 2), ("ui_text", _TEXT, 1), ("component", _COMPONENT, 1)):
            for m in rx.finditer(text):
                add(kind, m, g)
        for m in _FORM.finditer(text):
            add("form", m, 0)
    if not re.search(r"(?:^|/)(?:tests?|__tests__)/|[._](?:test|spec)\.", path):
        for m in _STRING.finditer(text):
            s = m[1] or m[2]
            if len(s.split()) >= 3 and len(s) >= 12:
                out.append(("string", s, m.start(), m.end()))
    return out


def extract_concepts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, kind, raw, norm, start, end`` over any number of files."""
    from tracewell.functions.text import normalize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(f, *c) for f, t in zip(p[path], p[text]) for c in concepts_of(f or "", t or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "raw", "start", "end"])

    raw = files.select(path, text).mapInPandas(run, "path string, kind string, raw string, start int, end int")
    return raw.withColumn("norm", normalize(F.col("raw"))).where("norm <> ''")


def own_concepts(concepts: DataFrame, symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """``concepts`` (from :func:`extract_concepts`) with the line they start on and
    ``owner``: the smallest symbol around it, null at the top of a file.

    ``symbols``: path, name, line, end_line; ``texts``: path, text.
    """
    line = F.length(F.regexp_replace(F.substring("text", 1, F.col("start")), r"[^\n]", "")) + 1
    at = concepts.join(texts.select("path", "text"), "path").withColumn("line", line).drop("text").withColumn("_k", F.monotonically_increasing_id())
    at = cut(at)
    named = symbols.select("path", F.col("line").alias("_from"), F.col("end_line").alias("_to"), "name")
    best = joins.innermost(at.select("_k", "path", F.col("line").alias("_at")), named, ["path"], "_at", "_from", "_to", "name", ["_k"])
    return at.join(best.select("_k", F.col("name").alias("owner")), "_k", "left").drop("_k")
