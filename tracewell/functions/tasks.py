"""Reading one task or query on the driver: words, language, recipes, budgets."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

#: English words a task does not search for.
STOPWORDS = [
    "the", "and", "for", "with", "that", "this", "its", "it", "a", "an", "to", "in", "of", "on", "at", "by", "is", "are", "be", "was", "were", "or",
    "as", "so", "we", "our", "my", "your", "into", "from", "when", "then", "than", "them", "they", "there", "all", "any", "can", "will", "should",
    "must", "not", "but", "without", "how", "what", "why", "fix", "add", "implement", "support", "make", "create", "update", "remove", "change",
    "refactor", "improve", "ensure", "allow", "use", "need", "want", "please", "new", "also", "file", "files", "code", "feature", "bug", "task",
    "issue", "explain", "describe", "where", "lives", "live", "located", "locate", "happens", "happen", "walk", "through", "repository", "repo",
    "codebase", "checked", "does", "question", "simple", "which", "who", "whose", "about", "between", "tell", "show", "give",
]
#: French function words, dropped from French tasks only.
FRENCH_STOPWORDS = [
    "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "ne", "pas", "que", "qui", "dans", "pour", "sur", "avec", "sans", "ce", "cette",
    "ces", "son", "sa", "ses", "mon", "ma", "mes", "ton", "ta", "tes", "notre", "nos", "votre", "vos", "leur", "leurs", "il", "elle", "ils", "elles",
    "nous", "vous", "je", "tu", "se", "lui", "en", "y", "tout", "tous", "toute", "toutes", "rien", "personne", "chaque", "quelque", "tres", "plus",
    "moins", "aussi", "comme", "si", "alors", "donc", "mais", "car", "parce", "est", "sont", "etre", "ete", "avoir", "ont", "faire", "fait", "peut",
    "doit", "faut", "comment", "pourquoi", "quand", "quel", "quelle", "quels", "quelles", "dont", "ca", "cela", "meme", "bien", "encore", "deja",
    "jamais", "toujours", "ici", "ensuite", "puis", "quoi",
]
#: French words no English task uses; two distinct ones make a task French.
FRENCH_MARKERS = [
    "le", "les", "une", "des", "du", "et", "pas", "que", "qui", "dans", "pour", "sur", "avec", "cette", "ces", "est", "sont", "nous", "vous", "je",
    "ils", "elles", "mais", "donc", "pourquoi", "quand", "quelle", "quels", "quelles", "dont", "cela", "deja", "toujours", "jamais", "peut", "doit",
    "faut", "etre", "avoir", "ne", "au", "aux",
]
MAX_KEYWORDS, MIN_LENGTH = 12, 3
SOURCE_EXT = {"rs", "py", "rb", "js", "ts", "tsx", "jsx", "go", "java", "kt", "c", "h", "cpp", "hpp", "md", "json", "yaml", "yml", "toml", "html", "css", "sh", "sql"}


def fold(text: str) -> str:
    """Accented letters as their base letters."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def ident_words(name: str) -> list[str]:
    """The driver's counterpart of :func:`tracewell.functions.text.split_ident_words`."""
    humps = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[^_\-.:#])(?=[A-Z][a-z])", "_", name)
    return [w.lower() for w in re.split(r"[_\-.:#]+", humps) if w]


def task_language(folded: str) -> str:
    words = {w.lower() for w in re.split(r"[^A-Za-z0-9]+", folded)}
    return "fr" if len(words & set(FRENCH_MARKERS)) >= 2 else "en"


@dataclass
class Task:
    exact: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    truncated: bool = False
    language: str = "en"


def read_task(text: str, short: frozenset[str] = frozenset({"ui", "db", "ci", "id", "io", "os", "js", "ts", "go"})) -> Task:
    """Exact names, paths and keywords of a task.

    Accents are folded first.  A path gives its stem as a word, quoted names and
    words joined by underscores are exact, stopwords of the task's language are
    dropped and twelve keywords kept.  A task with nothing to search raises.
    """
    task = Task()

    def path(m: re.Match) -> str:
        run = m[0].strip("./-")
        stem, dot, ext = run.rpartition(".")
        base = stem.rsplit("/", 1)[-1]
        if not dot or not base or ext.lower() not in SOURCE_EXT:
            return m[0]
        if run not in task.paths:
            task.paths.append(run)
        return base

    body = re.sub(r"[A-Za-z0-9_./-]+", path, fold(text))
    task.language = task_language(body)
    stop = set(STOPWORDS) | (set(FRENCH_STOPWORDS) if task.language == "fr" else set())
    for m in re.finditer(r"([`\"'])(.*?)\1", body):
        if re.fullmatch(r"[A-Za-z_]\w*", m[2]) and m[2] not in task.exact:
            task.exact.append(m[2])
    for chunk in re.split(r"[^A-Za-z0-9_]+", body):
        if "_" in chunk and re.fullmatch(r"[A-Za-z_]\w*", chunk) and chunk not in task.exact:
            task.exact.append(chunk)
        for w in ident_words(chunk):
            if (len(w) < MIN_LENGTH and w not in short) or w in stop or w in task.keywords:
                continue
            if len(task.keywords) >= MAX_KEYWORDS:
                task.truncated = True
            else:
                task.keywords.append(w)
    if not task.exact and not task.keywords:
        raise ValueError("nothing to search for in this task")
    return task


def expand(word: str, thesaurus: dict[str, list[str]]) -> list[str]:
    """Words that stand for one in a thesaurus the caller brings."""
    return thesaurus.get(word.lower(), [])


def stem(word: str) -> str:
    """A light stem: plural, past and progressive endings, doubled consonants undone."""
    for end, least in (("ing", 3), ("ed", 3), ("es", 3), ("s", 3)):
        if word.endswith(end) and len(word) - len(end) >= least and not (end in ("s", "es") and word.endswith("ss")):
            base = word[: -len(end)]
            if end in ("ing", "ed") and len(base) > 3 and base[-1] == base[-2] and base[-1] not in "lsz":
                base = base[:-1]
            return base
    return word


def prompt_terms(text: str, lexicon: dict[str, list[str]] | None = None) -> list[str]:
    """Stemmed terms of a prompt; French words are mapped by a lexicon where it knows them."""
    folded = fold(text)
    french = task_language(folded) == "fr"
    stop = set(STOPWORDS) | (set(FRENCH_STOPWORDS) if french else set())
    out: list[str] = []
    for chunk in re.split(r"[^A-Za-z0-9_]+", folded):
        for w in ident_words(chunk):
            targets = (lexicon or {}).get(w, [w]) if french else [w]
            out += [stem(t) for t in targets if t not in stop and len(t) >= MIN_LENGTH]
    return list(dict.fromkeys(out))


#: recipe and operations by the kind of question
RECIPES = {
    "locate": ("locate.v2", ["resolve", "search", "symbol"]), "scope": ("scope.v1", ["targets"]), "impact": ("impact.v1", ["impact"]),
    "history": ("history_recovery.v1", ["excavate"]), "status": ("status.v1", ["inspect", "review", "changes"]),
}


def compile_query(intent: str, kind: str = "auto") -> tuple[str, list[tuple[str, list[str]]]]:
    """``(status, plans)``: one plan for a recognised phrase, two ranked ones otherwise."""
    q = intent.strip()
    if kind == "auto":
        if q.startswith("where is `") and q.endswith("`"):
            kind = "locate"
        elif q.startswith("what files implement "):
            kind = "scope"
        elif q.startswith("show impact of "):
            kind = "impact"
        elif q.startswith("restore ") or "working before" in q:
            kind = "history"
        elif q in ("status", "what changed"):
            kind = "status"
    if kind in RECIPES:
        return "resolved", [RECIPES[kind]]
    return "ranked", [RECIPES["locate"], RECIPES["scope"]]


def split_budget(budget: int, targets: int, best: int = 60, other: int = 15) -> list[int]:
    """Token budgets of a query's targets, best first, in percent of the whole."""
    return [budget * (best if i == 0 else other) // 100 for i in range(targets)]


def bundle(queries: dict[str, object], most: int = 8) -> dict[str, object]:
    """One to ``most`` lazy answers evaluated on one snapshot: callables without
    arguments, a failing one kept as its error."""
    if not 1 <= len(queries) <= most:
        raise ValueError(f"a bundle holds 1 to {most} queries")
    out: dict[str, object] = {}
    for name, q in queries.items():
        try:
            out[name] = q()
        except Exception as e:  # one member's failure is an answer of its own
            out[name] = e
    return out
