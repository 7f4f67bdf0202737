"""Predicates and weights on repository-relative paths, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file extensions a type name selects.
TYPES = {
    "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "css": ["css", "scss"], "go": ["go"],
    "html": ["html", "htm"], "java": ["java"], "js": ["js", "mjs", "cjs", "jsx"], "json": ["json"],
    "kotlin": ["kt", "kts"], "markdown": ["md", "markdown"], "md": ["md", "markdown"], "py": ["py", "pyi"],
    "python": ["py", "pyi"], "rb": ["rb"], "ruby": ["rb"], "rust": ["rs"], "sh": ["sh", "bash", "zsh"],
    "swift": ["swift"], "toml": ["toml"], "ts": ["ts", "tsx", "mts", "cts"], "typescript": ["ts", "tsx", "mts", "cts"],
    "yaml": ["yml", "yaml"],
}
#: Directories and extensions that are not implementation.
NON_CODE_EXT = ["md", "mdx", "txt", "rst", "adoc", "html", "json", "yaml", "yml", "toml", "lock", "svg", "css", "scss"]
NON_CODE_DIRS = ["docs", "doc", "specs", "spec", "public", "vendor", "third_party"]
#: Lock files whose text is never indexed.
LOCK_FILES = ["bun.lock", "bun.lockb", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "composer.lock", "Gemfile.lock", "poetry.lock", "uv.lock"]
#: Words of a query that name a kind of file.
KIND_WORDS = {
    "test": ["test", "tests", "testing", "spec", "specs"],
    "config": ["config", "configs", "configuration", "settings", "json", "yaml", "yml", "toml", "locale", "locales", "translation", "translations", "i18n"],
    "docs": ["readme", "doc", "docs", "documentation", "markdown", "md", "changelog"],
}


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


#: Names, beginnings, ends and parts of names that credentials go by, and
#: folders that hold them.
CREDENTIAL_NAMES = [".netrc", "_netrc", ".git-credentials", "credentials", "serviceaccountkey.json"]
CREDENTIAL_BEGINNINGS = [".env", "credentials."]
CREDENTIAL_ENDS = [".env", "-credentials.json", ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".truststore", "_rsa", "_dsa", "_ecdsa", "_ed25519"]
CREDENTIAL_PARTS = ["secret"]
CREDENTIAL_DIRS = ["secrets"]


def credential_path(path: Column) -> Column:
    """Whether a path looks like it holds secrets."""
    p = F.lower(path)
    rest = "[^/]*"
    name = "|".join([_any(CREDENTIAL_NAMES), f"(?:{_any(CREDENTIAL_BEGINNINGS)}){rest}", f"{rest}(?:{_any(CREDENTIAL_ENDS)})", f"{rest}(?:{_any(CREDENTIAL_PARTS)}){rest}"])
    return p.rlike(rf"(?:^|/)(?:{_any(CREDENTIAL_DIRS)})(?:/|$)") | p.rlike(rf"(?:^|/)(?:{name})$")


def glob_regex(glob: str) -> str:
    """A path glob as one anchored regex; without a slash it matches a name at any
    depth, with one from the root, and a matched directory keeps what lies under it."""
    inner = glob.strip("/")
    if "/" not in glob.rstrip("/"):
        inner = "**/" + inner
    out, i = "", 0
    while i < len(inner):
        if inner.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif inner.startswith("/**", i) and i + 3 == len(inner):
            out, i = out + "/.+", i + 3
        elif inner.startswith("**", i):
            out, i = out + ".*", i + 2
        elif inner[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif inner[i] == "?":
            out, i = out + "[^/]", i + 1
        elif inner[i] == "[" and "]" in inner[i + 1 :]:
            j = inner.index("]", i + 1)
            out, i = out + "[" + inner[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        elif inner[i] == "{" and "}" in inner[i:]:
            j = inner.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x).replace(r"\*", "[^/]*") for x in inner[i + 1 : j].split(",")) + ")", j + 1
        else:
            out, i = out + re.escape(inner[i]), i + 1
    return f"^{out}(?:/.*)?$"


def keeps(path: Column, globs: list[str], types: list[str] = []) -> Column:  # noqa: B006
    """The last glob that matches decides (``!`` excludes); with any including glob
    the rest is dropped; and the extension is one of the types'."""
    p = F.regexp_replace(path, r"^(?:\./)+", "")
    verdict = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:  # each later rule wraps the ones before it
        verdict = F.when(p.rlike(glob_regex(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(verdict)
    if types:
        unknown = [t for t in types if t not in TYPES]
        if unknown:
            raise ValueError(f"unknown file types: {unknown}")
        ext = sorted({e for t in types for e in TYPES[t]})
        verdict = verdict & p.contains(".") & F.substring_index(p, ".", -1).isin(ext)
    return verdict


def under(path: Column, prefixes: list[str]) -> Column:
    """Component-wise prefix: ``src/foo`` is not above ``src/foobar``."""
    out = F.lit(False)
    for x in prefixes:
        x = x.rstrip("/")
        out = out | (path == x) | path.startswith(x + "/")
    return out


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(?:^|/)(?:test|tests|__tests__)(?:/|$)") | p.rlike(r"(?:^|/)[^/.]*_test(?:\.[^/]*)?$") | p.rlike(r"(?:^|[/.])(?:spec|test)\.[^/.]*$")


def role_weight(path: Column) -> Column:
    """1 for source, one half for prose, data and vendored files."""
    p = F.lower(path)
    return F.when(p.rlike(rf"(?:^|/)(?:{_any(NON_CODE_DIRS)})/") | F.substring_index(p, ".", -1).isin(NON_CODE_EXT), 0.5).otherwise(1.0)


def file_kind(path: Column) -> Column:
    """test, config or docs; null for code."""
    p = F.lower(path)
    ext = F.when(F.substring_index(p, "/", -1).contains("."), F.substring_index(p, ".", -1)).otherwise("")
    test = p.rlike(r"(?:^|/)(?:test|__tests__|spec|specs)/") | p.rlike(r"(?:_test\.|\.test\.|\.spec\.|_spec\.)[^/]*$")
    config = ext.isin("json", "yaml", "yml", "toml") | p.rlike(r"(?:^|/)(?:locales|locale|i18n)/")
    return F.when(test, "test").when(config, "config").when(ext == "md", "docs")


def demotion(path: Column, terms: list[str], factor: float = 0.8) -> Column:
    """The factor for kinds of file the query's terms do not name."""
    named = [k for k, words in KIND_WORDS.items() if set(terms) & set(words)]
    kind = file_kind(path)
    return F.when(kind.isNull() | kind.isin(named), 1.0).otherwise(factor) if named else F.when(kind.isNull(), 1.0).otherwise(factor)


def skip_path(path: Column) -> Column:
    """Paths whose text is machine noise."""
    name = F.substring_index(path, "/", -1)
    return (
        path.rlike(r"(?:^|/)(?:node_modules|vendor|dist)(?:/|$)")
        | name.isin(LOCK_FILES)
        | F.lower(name).contains(".min.")
        | name.rlike(r"\.(?:map|snap)$")
        | path.contains("generated")
        | path.contains("codegen")
        | ((F.length(name) > 80) & F.lower(name).endswith(".svg"))
    )
