"""The languages of documents and of their segments, by a byte convolutional network.

The network is trained in numpy on a bounded sample of labelled documents: byte
embeddings, filters of several widths, max pooling and softmax over windows of
fixed length.  Sentences of labelled text carry wrong labels too, so a first
network drops the sentences it contradicts and a second learns from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes and English names of the languages told apart.
NAMES = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german"], "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish"], "pt": ["pt", "por", "portuguese"], "nl": ["nl", "nld", "dut", "dutch"],
    "ru": ["ru", "rus", "russian"], "ja": ["ja", "jpn", "japanese"],
}
LANGUAGES = sorted(NAMES)
WINDOW, DIM, WIDTHS, FILTERS = 96, 8, (2, 3, 4, 5), 12
WIDE = max(WIDTHS)
#: Bounds of the training sample: documents and sentences per language, sentences per document.
SAMPLE_DOCUMENTS, SAMPLE_SENTENCES, PER_DOCUMENT = 400, 4500, 40
AGREE = 0.8  # share of a document's sentences that must agree with its label for it to teach
SURE = 0.9  # least confidence at which a sentence counts
CACHE = 200_000  # sentences a worker remembers

_FENCE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"[«“„‹「『\"]\s?[^«»“”„‹›「」『』\"\n]{0,80}[»”“›」』\"]")
_SCOPED = r"[A-Za-z0-9_]+(?:::[A-Za-z0-9_]+)+"
_PATH = r"[A-Za-z0-9.+-]*[/_\\@#][A-Za-z0-9_./\\:@#?=&%+-]*[A-Za-z0-9_/]"
_CAMEL = r"(?<![A-Za-z])[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+"
_NOISE = re.compile("|".join([_SCOPED, _PATH, _CAMEL, r"[0-9]+(?:\.[0-9]+)*"]))
_SPEAKER = re.compile(r"[ \t>*-]*(?:[A-Za-z][A-Za-z ]{0,15})?:[ \t]")
_END = re.compile(r"[.!?。！？]+")
_AFTER = set(" \t\r\f\v\u00a0\u202f\"')»]")
_CODE = re.compile(r"[{}=;<>|\[\]$]|^\s*#")


def _blank(m: re.Match) -> str:
    return " " * len(m[0])


class _Tokens(dict):
    """Tokens with paths, identifiers and numbers blanked, at the same length."""

    def __missing__(self, token: str) -> str:
        clean = _NOISE.sub(_blank, token)
        if clean == token and len(token) < 30:
            if len(self) > 50_000:
                self.clear()
            self[token] = clean
        return clean


_TOKENS = _Tokens()


def sentences(text: str) -> list[tuple[int, int, str]]:
    """The full sentences of a text: start, end and cleaned lower-case text of each.

    Fenced and inline code, quoted phrases, speaker names, identifiers, paths and
    numbers are blanked; a sentence ends with a terminal mark and has four words
    (or six letters of a script without blanks).  Blanking keeps lengths, so the
    offsets hold in ``text``.  Null and blank texts have none.
    """
    if not text or text.isspace():
        return []
    t = _FENCE.sub(_blank, text) if "`" in text else text
    t = _QUOTED.sub(_blank, t)
    get, out, at = _TOKENS.__getitem__, [], 0
    for line in t.split("\n"):
        begin, size = 0, len(line)
        if ":" in line and (m := _SPEAKER.match(line)):
            begin = m.end()
            line = " " * begin + line[begin:]
        line = " ".join(map(get, line.split(" ")))
        for m in _END.finditer(line):
            end = m.end()
            if end < size and line[end - 1] in ".!?" and line[end] not in _AFTER:
                continue
            words = line[begin:end].split()
            s = " ".join(words).lstrip(":,;.!?-–—*>() ")
            if len(s) >= 8 and (len(words) >= 4 or not s.isascii() and sum(map("\u3040".__le__, s)) >= 6) and not _CODE.search(s):
                out.append((at + begin, at + end, s.lower()))
            begin = end
        at += size + 1
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows of fixed length over whole texts, and the text of each window.

    The last window of a longer text is drawn back to be full, so no window holds
    a stray rest; a shorter text is padded.
    """
    flat, owner = [], []
    for i, s in enumerate(texts):
        b = s.encode()
        if len(b) <= WINDOW:
            flat.append(b.ljust(WINDOW, b"\0"))
            owner.append(i)
            continue
        for k in range(0, len(b), WINDOW):
            flat.append(b[k : k + WINDOW] if k + WINDOW <= len(b) else b[-WINDOW:])
            owner.append(i)
    return np.frombuffer(b"".join(flat), dtype=np.uint8).reshape(-1, WINDOW), np.array(owner, dtype=int)


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # WIDE * DIM x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        f = FILTERS * len(WIDTHS)
        x = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = Network(x(256, DIM, scale=0.5), x(WIDE * DIM, f, scale=0.15), np.zeros(f, np.float32), x(f, len(LANGUAGES), scale=0.2), np.zeros(len(LANGUAGES), np.float32))
        net.embed[0] = 0
        net.kernel *= Network.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """Filters narrower than the widest see the first bytes of the window only."""
        return np.concatenate([np.repeat((np.arange(WIDE * DIM) < w * DIM)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), WINDOW + WIDE - 1, DIM), np.float32)
        padded[:, :WINDOW] = self.embed[x]
        s = padded.strides
        return np.lib.stride_tricks.as_strided(padded, (len(x), WINDOW, WIDE * DIM), (s[0], s[1], s[2]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cols = self.columns(x)
        return cols, np.ascontiguousarray(cols).reshape(-1, WIDE * DIM).dot(self.kernel).reshape(len(x), WINDOW, -1)

    def log_probs(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        done = []
        for i in range(0, len(x), batch):
            top = np.maximum(self.pooled(x[i : i + batch])[1].max(1) + self.bias, 0)
            z = top.dot(self.out) + self.out_bias
            z -= z.max(1, keepdims=True)
            done.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(done) if done else np.zeros((0, len(LANGUAGES)), np.float32)

    def classify(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language index and confidence of each text: its windows' evidence, summed."""
        if not texts:
            return np.zeros(0, int), np.zeros(0, np.float32)
        x, owner = windows(texts)
        lp = self.log_probs(x)
        total = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(total, owner, lp)
        total = np.exp(total - total.max(1, keepdims=True))
        total /= total.sum(1, keepdims=True)
        return total.argmax(1), total.max(1)


def train(texts: list[str], labels: np.ndarray, epochs: int = 8, seed: int = 7, rate: float = 0.006, steps: int = 500) -> Network:
    """Adam on cross-entropy over the windows of ``texts``: ``epochs`` passes, more of
    them where the sample is so small that they would make fewer than ``steps`` steps."""
    rng = np.random.default_rng(seed)
    net, mask = Network.fresh(rng), Network.mask()
    x, owner = windows(texts)
    y = labels[owner]
    names = ["embed", "kernel", "bias", "out", "out_bias"]
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(max(epochs, -(-steps * 128 // max(1, len(x))))):
        order = rng.permutation(len(x))
        for i in range(0, len(order), 128):
            at = order[i : i + 128]
            bx, n = x[at], len(at)
            cols, act = net.pooled(bx)
            where = act.argmax(1)
            top = np.maximum(np.take_along_axis(act, where[:, None], 1)[:, 0] + net.bias, 0)
            z = top.dot(net.out) + net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(n), y[at]] -= 1
            d /= n
            g = d.dot(net.out.T) * (top > 0)
            seen = cols[np.arange(n)[:, None], where]
            back = g[:, :, None] * net.kernel.T[None]
            grad = {"out": top.T.dot(d), "out_bias": d.sum(0), "bias": g.sum(0), "kernel": np.einsum("nf,nfk->kf", g, seen) * mask}
            pos = where[:, :, None] + np.arange(WIDE)
            byte = np.where(pos < WINDOW, bx[np.arange(n)[:, None, None], np.minimum(pos, WINDOW - 1)], 0)
            e = np.zeros_like(net.embed)
            for k in range(DIM):
                e[:, k] = np.bincount(byte.ravel(), weights=back.reshape(n, -1, WIDE, DIM)[..., k].ravel(), minlength=256)
            e[0] = 0
            grad["embed"] = e
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                w = getattr(net, k)
                w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def label_language(label: Column) -> Column:
    """The language a label names: a two- or three-letter code, with or without
    region, or an English name, in any case; null for anything else."""
    known = F.create_map(*[F.lit(x) for k, names in NAMES.items() for n in names for x in (n, k)])
    plain = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    code = F.regexp_extract(plain, r"^([a-z]{2,3})[-_][a-z0-9]{2,8}$", 1)
    return F.coalesce(F.try_element_at(known, plain), F.when(code != "", F.try_element_at(known, code)))


def fit(documents: DataFrame) -> Network:
    """A network from at most ``SAMPLE_DOCUMENTS`` labelled documents per language,
    drawn by a hash of their ids from all of them."""
    labelled = documents.select("doc_id", "text", label_language(F.col("lang")).alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # one row per language
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.try_element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, SAMPLE_DOCUMENTS / n) * (1 << 30))))]), F.col("label")) if counts else F.lit(0)
    sample = labelled.where(bucket < share).limit(2 * SAMPLE_DOCUMENTS * len(LANGUAGES)).collect()
    return learn([(r["doc_id"], r["label"], r["text"]) for r in sample])


def _examples(docs: list[tuple[int, list[str]]], most: int, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Sentences with the label most of their documents give them (by the label's
    size), what stands in many documents first and more than once."""
    votes: dict[str, np.ndarray] = {}
    size = np.ones(len(LANGUAGES))
    for k, found in docs:
        size[k] += 1
        for s in found:
            votes.setdefault(s, np.zeros(len(LANGUAGES)))[k] += 1
    held: list[list[tuple[str, int]]] = [[] for _ in LANGUAGES]
    for s in sorted(votes):
        v = votes[s] / size
        if v.max() > 0.6 * v.sum():
            held[int(v.argmax())].append((s, int(votes[s].max())))
    texts, labels = [], []
    for i, mine in enumerate(held):
        mine = [mine[j] for j in rng.permutation(len(mine))]
        for s, n in sorted(mine, key=lambda x: -min(x[1], 3))[:most]:
            times = 1 + int(np.log2(n))
            texts += [s] * times
            labels += [i] * times
    return texts, np.array(labels, dtype=int)


def learn(sample: list[tuple[int, str, str]]) -> Network:
    """A network from (document id, label, text) rows, some of them labelled wrongly.

    A first, short training reads every sampled document; those whose sentences
    contradict their label (wrong or mixed) are left out of the second.
    """
    rng = np.random.default_rng(11)
    docs = []
    for _, label, text in sorted(sample):
        found = list(dict.fromkeys(s for _, _, s in sentences(text)))
        docs.append((LANGUAGES.index(label), [found[i] for i in rng.permutation(len(found))[:PER_DOCUMENT]]))
    texts, labels = _examples(docs, SAMPLE_SENTENCES // 3, rng)
    if not texts:
        return Network.fresh(rng)
    every = sorted({s for _, found in docs for s in found})
    guess = dict(zip(every, train(texts, labels, epochs=3, steps=200).classify(every)[0].tolist()))
    agree = [(k, [s for s in found if guess[s] == k]) for k, found in docs if found and sum(guess[s] == k for s in found) >= AGREE * len(found)]
    again, more = _examples(agree, SAMPLE_SENTENCES, rng)
    known = set(more.tolist())
    # a language whose documents were all doubted keeps its first examples
    extra = [i for i, k in enumerate(labels) if k not in known]
    return train(again + [texts[i] for i in extra], np.concatenate([more, labels[extra]]))


class Reader:
    """Classifies sentences in batches, each distinct cleaned sentence once."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}

    def __call__(self, found: list[str]) -> list[tuple[int, float]]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(dict.fromkeys(s for s in found if s not in self.known))
        lang, sure = self.net.classify(new)
        self.known.update(zip(new, zip(lang.tolist(), sure.tolist())))
        return [self.known[s] for s in found]


def _batches(batches: Iterator[pd.DataFrame]):
    """Batches of about a thousand documents with their sentences."""
    for batch in batches:
        for i in range(0, len(batch), 1000):
            part = batch.iloc[i : i + 1000]
            yield part, [sentences(t) for t in part["text"]]


def document_languages(documents: DataFrame, net: Network, *keep: str) -> DataFrame:
    """``doc_id, [keep...], found``: the languages with a full sentence in each
    document, as ``array<struct<lang, confidence, sentences>>``; empty where there
    is none.  ``keep`` names string columns to carry along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(net)
        for part, found in _batches(batches):
            known = iter(read([s for f in found for _, _, s in f]))
            rows = []
            for f in found:
                seen: dict[int, list[float]] = {}
                for _ in f:
                    lang, sure = next(known)
                    if sure >= SURE:
                        seen.setdefault(lang, []).append(sure)
                rows.append([{"lang": LANGUAGES[k], "confidence": round(float(np.mean(c)), 4), "sentences": len(c)} for k, c in sorted(seen.items())])
            yield part[["doc_id", *keep]].assign(found=rows)

    kept = "".join(f"{c} string, " for c in keep)
    return documents.select("doc_id", "text", *keep).mapInPandas(run, f"doc_id long, {kept}found array<struct<lang string, confidence double, sentences int>>")


def segments(documents: DataFrame, net: Network) -> DataFrame:
    """``doc_id, segment, start, end, lang, confidence``: each stretch of full
    sentences in one language, with offsets into the text; unsure sentences belong
    to the stretch they lie in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = Reader(net)
        for part, found in _batches(batches):
            known = iter(read([s for f in found for _, _, s in f]))
            rows = []
            for doc, f in zip(part["doc_id"].tolist(), found):
                open_: list | None = None
                number = 0
                for start, end, _ in f:
                    lang, sure = next(known)
                    if open_ and (lang == open_[2] or sure < SURE):
                        open_[1] = end
                        open_[3] += [sure] if lang == open_[2] else []
                        continue
                    if sure < SURE:
                        continue
                    if open_:
                        rows.append((doc, number, open_[0], open_[1], LANGUAGES[open_[2]], round(float(np.mean(open_[3])), 4)))
                    number, open_ = number + 1, [start, end, lang, [sure]]
                if open_:
                    rows.append((doc, number, open_[0], open_[1], LANGUAGES[open_[2]], round(float(np.mean(open_[3])), 4)))
            yield pd.DataFrame(rows, columns=["doc_id", "segment", "start", "end", "lang", "confidence"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, segment int, start int, end int, lang string, confidence double")
