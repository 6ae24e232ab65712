"""Language identification by words first, then shorter and shorter n-grams.

A word that the model knows adds its log frequency in each language.  An
unseen word backs off: at each of its positions the longest known character
n-gram (of 4, 3, 2, 1, with word ends marked) adds its log frequency.  The
language of the highest sum wins; the score is its share of a softmax over
the sums, taken as the evidence of at most ``EVIDENCE`` words.

The model is fitted on a bounded sample: about ``SAMPLE_ROWS`` labelled rows
of each of at most ``LANGUAGES`` languages (an error beyond), chosen by a hash
of doc_id.  It keeps every word and n-gram of the sample.  Prediction covers
every whole text.

Text that is null or holds no letter is ``und`` with score 0.  Rows of null
lang or text teach nothing; without any labelled row all texts are ``und``.
Ties go to the language that sorts first.  Very long texts are read whole, one
at a time.  Repeated rows are kept.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, id_remainder, table

SAMPLE_ROWS = 2000
LANGUAGES = 2000
LONGEST_NGRAM = 4
EVIDENCE = 20
#: Added to every count.
SMOOTHING = 0.5
UNKNOWN = "und"
#: Words whose scores a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000

_WORDS = re.compile(r"[^\W\d_]+").findall


def ngrams(word: str):
    """(position's longest first) n-grams of a word with its ends marked."""
    w = f"^{word}$"
    return [[w[i : i + n] for n in range(min(LONGEST_NGRAM, len(w) - i), 0, -1)] for i in range(len(w))]


def _count(batches):
    """(lang, text) -> counts of words (kind 0) and n-grams (kind 1) by language."""
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(_WORDS(text.lower()))
        for lang, words in counts.items():
            grams: Counter = Counter()
            for word, n in words.items():
                for row in ngrams(word):
                    for g in row:
                        grams[g] += n
            for kind, c in ((0, words), (1, grams)):
                keys = list(c)
                for i in range(0, len(keys), 20_000):
                    k = keys[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array([kind] * len(k), pa.int32()), pa.array(k), pa.array([c[x] for x in k], pa.int64())], names=["lang", "kind", "term", "n"])


class Model:
    """Log frequencies by language, less their mean over the languages."""

    def __init__(self, languages: list[str], known: list[tuple[list[str], np.ndarray]]):
        """``known``: words, then n-grams, each with counts (terms, languages)."""
        self.languages, self.tables = languages, []
        for terms, counts in known:
            logs = np.asarray(counts, float).reshape(len(terms), len(languages)) + SMOOTHING
            if logs.size:
                logs = np.log(logs / logs.sum(axis=0, keepdims=True))
                logs -= logs.mean(axis=1, keepdims=True)
            self.tables.append((terms, logs.astype(np.float32)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "own"}

    def scorer(self) -> Scorer:
        """This worker's scorer; the model lives as long as its broadcast, so tasks share it."""
        if not hasattr(self, "own"):
            self.own = Scorer(self)
        return self.own


class Scorer:
    """A worker's model: rows of word scores, learnt as words turn up."""

    def __init__(self, model: Model):
        self.languages = model.languages
        (words, self.word_scores), (grams, self.gram_scores) = model.tables
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = {g: i for i, g in enumerate(grams)}
        self.forget()

    def forget(self):
        self.rows = np.zeros((1 << 12, len(self.languages)), dtype=np.float32)
        self.index: dict[str, int] = {}
        self.n = 1  # row 0: no letter

    def word(self, word: str) -> np.ndarray | None:
        """Scores of a word; None without a letter."""
        if not any(map(str.isalpha, word)):
            return None
        i = self.words.get(word)
        if i is not None:
            return self.word_scores[i]
        get, hits = self.grams.get, []
        w = f"^{word}$"
        for i in range(len(w)):
            for n in range(LONGEST_NGRAM, 0, -1):
                if (g := get(w[i : i + n])) is not None:
                    hits.append(g)
                    break
        return self.gram_scores[hits].sum(axis=0) / LONGEST_NGRAM if hits else np.zeros(len(self.languages), np.float32)

    def learn(self, words) -> None:
        for w in words:
            scores = self.word(w)
            if scores is None:
                self.index[w] = 0
                continue
            if self.n == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n] = scores
            self.index[w] = self.n
            self.n += 1

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORDS((text or "").lower())
        if not words or not self.languages:
            return UNKNOWN, 0.0
        try:
            ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            if len(self.index) > REMEMBERED:
                self.forget()
            self.learn(set(words).difference(self.index))
            ids = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        n = int(np.count_nonzero(ids))
        if not n:
            return UNKNOWN, 0.0
        total = self.rows[ids].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        p = np.exp((total - total[best]) * min(1.0, EVIDENCE / n))
        return self.languages[best], float(p[best] / p.sum())


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, languages: int = LANGUAGES) -> Model:
    """``labelled``: doc_id, text, lang."""
    rows = documents_only(labelled, "doc_id", "text", "lang").where("lang IS NOT NULL")
    # A row per language, at most; texts aren't read for it.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(languages + 1).collect()}
    if len(sizes) > languages:
        raise ValueError(f"over {languages} languages")
    names = sorted(sizes)
    if not names:
        return Model([], [([], np.zeros((0, 0)))] * 2)
    share = F.create_map(*[F.lit(x) for lang in names for x in (lang, min(1.0, sample_rows / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1_000_000)) / 1e6
    sample = rows.where("text IS NOT NULL").where(draw < share[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, kind int, term string, n long")
    by = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(names)]
    terms = counts.groupBy("kind", "term").agg(*by)
    terms = WorkFolder(labelled.sparkSession, "language").materialise(terms, "terms")  # of the sample alone
    known = []
    for kind in (0, 1):
        own = terms.where(F.col("kind") == kind).drop("kind").toPandas().sort_values("term")
        known.append((own["term"].tolist(), own.drop(columns="term").to_numpy(np.int64)))
    return Model(names, known)


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` plus lang_pred and score."""
    b = docs.sparkSession.sparkContext.broadcast(model)  # the terms of the bounded sample
    rows = docs.select(docs["text"].alias("__text"), *[docs[c] for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        scorer = b.value.scorer()
        for batch in batches:
            lang, score = zip(*[scorer.predict(t.as_py()) for t in batch.column(0)]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def op2_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(docs["doc_id"], 3) == 1
    model = fit(docs.where(~held_out))
    return predict(docs, model, "doc_id").select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
