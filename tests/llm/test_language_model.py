"""The word-first backoff model against plain counting, and a prediction from it by hand."""

import math
import re
from collections import Counter

import pytest

from stratagram.llm import langid

ROWS = [
    (1, "the cat sat on the mat 12 _x", "en"),
    (2, "the dog", "en"),
    (3, "Der Hund, der Hund!", "de"),
    (4, None, "de"),
    (5, "ignored", None),
    (6, "ÉTÉ été", "fr"),
    (6, "ÉTÉ été", "fr"),
]
TEXTS = [None, "", "12 !", "the hund", "mattress", "der der der dog", "été", "zzz", "ͅ", "a" * 300, "kat " * 5000]


def words_of(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def grams_of(word):
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w)) for n in range(1, 5) if i + n <= len(w)]


def plain_model():
    words, grams = {}, {}
    for _, text, lang in ROWS:
        if lang and text is not None:
            words.setdefault(lang, Counter()).update(words_of(text))
            grams.setdefault(lang, Counter()).update(g for w in words_of(text) for g in grams_of(w))
    langs = sorted(words)

    def logs(counts):
        terms = set().union(*counts.values())
        total = {x: sum(counts[x].values()) + 0.5 * len(terms) for x in langs}
        out = {}
        for t in terms:
            row = [math.log((counts[x][t] + 0.5) / total[x]) for x in langs]
            out[t] = [v - sum(row) / len(row) for v in row]
        return out

    return langs, logs(words), logs(grams)


def plain_predict(model, text):
    langs, words, grams = model
    total, n = [0.0] * len(langs), 0
    for w in words_of(text):
        if not any(c.isalpha() for c in w):
            continue
        n += 1
        if w in words:
            total = [a + b for a, b in zip(total, words[w])]
            continue
        marked = f"^{w}$"
        for i in range(len(marked)):
            for k in (4, 3, 2, 1):
                if marked[i : i + k] in grams:
                    total = [a + b / 4 for a, b in zip(total, grams[marked[i : i + k]])]
                    break
    if not n:
        return "und", 0.0
    best = max(range(len(langs)), key=lambda i: (total[i], -i))
    e = [math.exp((t - total[best]) * min(1, 20 / n)) for t in total]
    return langs[best], e[best] / sum(e)


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))


def test_every_term_counts(model):
    langs, words, grams = plain_model()
    assert model.languages == langs
    for (terms, scores), want in zip(model.tables, (words, grams)):
        assert set(terms) == set(want)
        for term, row in zip(terms, scores):
            assert row.tolist() == pytest.approx(want[term], abs=1e-5)


def test_predictions(spark, model):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plain = plain_model()
    for r in langid.predict(docs, model, "doc_id").collect():
        lang, score = plain_predict(plain, TEXTS[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-4)


def test_too_many_languages(spark):
    rows = spark.createDataFrame([(i, "x", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(rows, languages=4)


def test_query_against_the_plain_model(spark, sf):
    """The whole query: the model of its own sample, every text."""
    import zlib

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    global ROWS
    kept = ROWS
    try:
        ROWS = [r for r in docs if zlib.crc32(str(r[0]).encode()) % 3 != 1]
        plain = plain_model()
    finally:
        ROWS = kept
    texts = {r[0]: r[1] for r in docs}
    for r in langid.op2_word_backoff(spark, sf).collect():
        lang, score = plain_predict(plain, texts[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == lang or abs(score - 0.5) < 0.01) and r["score"] == pytest.approx(score, abs=1e-3)
