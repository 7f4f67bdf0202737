import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import languages as L
from tracewell.llm import tokens

SAY = {
    "en": ["the reader skips every renamed file", "nobody noticed that the lock was free", "why would this happen when there is only one writer", "please look at the table again before the next commit"],
    "de": ["der leser überspringt jede umbenannte datei", "niemand hat bemerkt dass die sperre frei war", "warum sollte das bei nur einem schreiber geschehen", "bitte sieh dir die tabelle vor der übergabe noch einmal an"],
    "fr": ["le lecteur saute chaque fichier renommé", "personne n'a remarqué que le verrou était libre", "pourquoi cela arriverait-il avec un seul auteur", "merci de regarder encore la table avant la validation"],
    "es": ["el lector omite cada archivo renombrado", "nadie notó que el bloqueo estaba libre", "por qué pasaría esto con un solo escritor", "por favor mira la tabla otra vez antes de la entrega"],
    "ru": ["читатель пропускает каждый переименованный файл", "никто не заметил что блокировка свободна", "почему так бывает если пишет только один", "посмотри таблицу ещё раз перед фиксацией"],
    "ja": ["読み取り部は名前を変えたファイルを読み飛ばします", "誰もロックが空いたことに気づきませんでした", "書き込みが一つだけなのになぜこうなりますか", "次の確定の前にもう一度表を見てください"],
}


def text(rng, lang, n):
    end = "。" if lang == "ja" else ". "
    return "".join(rng.choice(SAY[lang]).capitalize() + end for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(0)
    rows = []
    for i in range(240):
        lang = rng.choice(list(SAY))
        label = rng.choice(list(SAY)) if rng.random() < 0.15 else lang  # some labels lie
        rows.append((i, label, text(rng, lang, 5)))
    return L.learn(rows)


def test_held_out_accuracy_despite_wrong_labels(net):
    rng = random.Random(1)
    pairs = [(lang, s[0].upper() + s[1:]) for lang in SAY for s in SAY[lang] for _ in range(3)]
    rng.shuffle(pairs)
    got, sure = net.classify([s.lower() for _, s in pairs])
    assert np.mean([L.LANGUAGES[g] == lang for g, (lang, _) in zip(got, pairs)]) >= 0.98 and 0 < sure.min() <= sure.max() <= 1
    assert len(net.classify([])[0]) == 0


def test_sentences_leave_code_out():
    t = "user: The reader skips src/a/b.rs and Foo::bar 12 times.\n```\nthis is code. it does not count.\n```\n# A heading here\nerror[E1]: no such value\nDer Leser («the quoted words here») überspringt jede Datei. Yes.\n誰もそのことに気づきませんでした。"
    found = L.sentences(t)
    assert [s for _, _, s in found] == ["the reader skips and times.", "der leser ( ) überspringt jede datei.", "誰もそのことに気づきませんでした。"]
    for a, b, s in found:
        assert t[a:b].lower().strip().endswith(s[-6:])
    assert L.sentences("") == L.sentences(None) == L.sentences("  \n ") == L.sentences("```\nopen fence. never closed here at all.") == []


def test_documents_and_segments(spark, net):
    rng = random.Random(2)
    mixed = text(rng, "en", 6) + "\n\n" + text(rng, "ja", 4) + "\n" + text(rng, "en", 3)
    rows = [(1, text(rng, "de", 6), "de"), (2, mixed, None), (3, "", "en"), (4, None, "en"), (5, "fn main() { x(); }", "en"), (6, text(rng, "ru", 3000), "ru")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r["doc_id"]: {f["lang"] for f in r["found"]} for r in L.document_languages(df, net, "label").collect()}
    assert got == {1: {"de"}, 2: {"en", "ja"}, 3: set(), 4: set(), 5: set(), 6: {"ru"}}
    seg = [(r["segment"], r["lang"]) for r in L.segments(df.where("doc_id = 2"), net).orderBy("segment").collect()]
    assert seg == [(1, "en"), (2, "ja"), (3, "en")]
    r = L.segments(df.where("doc_id = 2"), net).where("segment = 2").first()
    assert mixed[r["start"] : r["end"]].strip().endswith("。") and 0.9 <= r["confidence"] <= 1
    assert L.document_languages(df.limit(0), net).collect() == []


def test_labels(spark):
    names = {"en-US": "en", " ENG ": "en", "German": "de", "pt_BR": "pt", "jpn": "ja", "dut": "nl", "mul": None, "und": None, "unknown": None, "n/a": None, "": None, None: None, "xx": None, "english text": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["l"] for r in df.select("n", L.label_language(F.col("n")).alias("l")).collect()} == names


def test_fit_without_labels(spark):
    df = spark.createDataFrame([(1, "Some text here with no label at all.", None)], "doc_id long, text string, lang string")
    assert L.document_languages(df, L.fit(df)).count() == 1


@pytest.mark.skipif(not Path(tokens.TOKENIZERS).exists(), reason="no vocabulary files here")
def test_token_counts_round_trip(spark):
    texts = ["", None, "The daemon, 12 times.", "größe 漢字 🙂", "a" * 20_000, "<|endoftext|>"]
    e = tokens.encoder()
    got = [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.token_count(F.col("t")).alias("n")).collect()]
    assert got == [len(e.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts if t)
