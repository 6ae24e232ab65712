"""Quality classifier: random-indexing word vectors, a two-layer network.

A text is a stream of words: its tokens, after each token that isn't plain
lower case a word for its shape (capitals, digits, doubled marks, ...), after a
token that was said just before, or with one between, a word for that, and at
the end a word for lines said before, as often as their share of the lines in
tokens.  Words get vectors by random indexing: every word has a sparse random
index vector, and its context vector is the sum of its neighbours' index
vectors over the whole corpus.  Words are hashed into ``BUCKETS`` buckets, so
the table of vectors has a fixed size however large the corpus; each task adds
up its own and the sums are added by key.  A document is the mean of its
stream's vectors.  A two-layer numpy network gives the probability of label 1;
a temperature fitted on rows that it wasn't trained on calibrates it.

The network is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first by a
hash of doc_id; of a labelled doc_id with several texts the least text counts.
Word statistics and scores cover all rows and whole texts.

Null text counts as empty; an empty text has the zero vector and a score like
any other.  Very long texts are read whole, one at a time.  Labels that are
null are left out; without labels of both kinds the score is the share of
label 1 (0.5 without any).  A doc_id with both labels teaches both.  Repeated
rows are kept, and equal texts have equal scores.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, give_back, id_remainder, table

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Entries of an index vector that are not zero, and neighbours on each side.
NONZERO = 2
NEIGHBOURS = 2
SAMPLE_ROWS = 20_000
HIDDEN = 32
EPOCHS = 60
#: The least score of predicted 1.
ACCEPT = 0.7
SEED = 20240607
#: Rows of the table that one key of the sum holds.
CHUNK = 256
REMEMBERED = 200_000
#: Words of streams that are added up at once.
AT_ONCE = 1 << 18

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_SHAPE_BITS = 20
_BUCKET = (1 << _SHAPE_BITS) - 1


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


#: Words that no token can be: one for each shape (none for plain lower case and single marks), repeats and lines.
_SHAPES = ("", "capital", "upper", "digits", "mixed", "marks", "symbol")
_SHAPE_AT = np.array([-1] + [bucket(f" {name}") for name in _SHAPES[1:]])
_AGAIN, _AFTER_ONE, _LINE = bucket(" again"), bucket(" after one"), bucket(" line")


def shape(token: str) -> int:
    """An index of _SHAPES; 0 for lower case and the common single marks."""
    if token[0].isalnum() or token[0] == "_":
        return 3 if token.isdigit() else 2 if token.isupper() and len(token) > 1 else 0 if token.islower() else 1 if token[0].isupper() and token[1:].islower() or token.isupper() else 4
    return 5 if len(token) > 1 else 0 if token in ".,;:!?|\"'" else 6


class _Codes(dict):
    """token -> shape and bucket in one number."""

    def __missing__(self, token):
        code = shape(token) << _SHAPE_BITS | bucket(token.lower())
        if len(token) <= 32:
            self[token] = code
        return code


def stream(known: _Codes, text: str | None) -> np.ndarray:
    """The buckets of a text's words in order."""
    tokens = _TOKENS(text) if text else ()
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.int64)
    codes = np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=n)
    words = np.full((n, 3), -1, dtype=np.int64)
    words[:, 0] = codes & _BUCKET
    words[:, 1] = _SHAPE_AT[codes >> _SHAPE_BITS]
    same = codes & _BUCKET
    words[2:, 2] = np.where(same[2:] == same[:-2], _AFTER_ONE, -1)
    words[1:, 2] = np.where(same[1:] == same[:-1], _AGAIN, words[1:, 2])
    words = words.ravel()
    words = words[words >= 0]
    lines = text.split("\n")
    said = len(lines) - len(set(lines))
    return np.concatenate([words, np.full(max(1, round(said / len(lines) * n)), _LINE)]) if said else words


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, NONZERO) places and signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (n, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (n, NONZERO))


def _dense(places, signs) -> np.ndarray:
    out = np.zeros((len(places), DIMENSIONS), dtype=np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(len(places)), places[:, k]), signs[:, k])
    return out


def add_contexts(streams: list[np.ndarray], sums: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Counts of the words and index vectors of their neighbours, added to ``sums``."""
    # Documents are set apart by as many gaps as a window is wide.
    gap = np.full(NEIGHBOURS, -1, dtype=np.int64)
    w = np.concatenate([x for s in streams for x in (s, gap)])
    sums[:, 0] += np.bincount(w[w >= 0], minlength=BUCKETS)
    for d in range(1, NEIGHBOURS + 1):
        a, b = w[:-d], w[d:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok] * DIMENSIONS, b[ok] * DIMENSIONS
        for word, other in ((a, b // DIMENSIONS), (b, a // DIMENSIONS)):
            for k in range(NONZERO):
                sums[:, 1:] += np.bincount(word + places[other, k], signs[other, k], minlength=BUCKETS * DIMENSIONS).reshape(BUCKETS, DIMENSIONS)


def _contexts(batches):
    """text -> this task's sums, CHUNK buckets to a row: counts, then context vectors."""
    places, signs = index_vectors(BUCKETS, SEED)
    sums = np.zeros((BUCKETS, DIMENSIONS + 1))
    known, held, size = _Codes(), [], 0
    for batch in batches:
        for text in batch.column(0):
            held.append(stream(known, text.as_py()))
            size += len(held[-1])
            if size >= AT_ONCE:
                add_contexts(held, sums, places, signs)
                held, size = [], 0
                if len(known) > REMEMBERED:
                    known = _Codes()
    if held:
        add_contexts(held, sums, places, signs)
    parts = sums.astype("<f4").reshape(-1, CHUNK * (DIMENSIONS + 1))
    if sums[:, 0].any():
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "sums"])


def _adder(kind: str):
    """Rows of any order, numbers of ``kind`` -> one row a chunk, doubles; memory for the table at most."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(raw, kind).astype(np.float64)
                total[chunk] = total[chunk] + v if chunk in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())], names=["chunk", "sums"])

    return run


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors by bucket, from all documents.  The table's size is fixed: BUCKETS rows."""
    schema = "chunk int, sums binary"
    parts = docs.select(docs["text"]).mapInArrow(_contexts, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    # In two steps, so that no task adds up the sums of all tasks.
    some = parts.repartition("chunk", "salt").select("chunk", "sums").mapInArrow(_adder("<f4"), schema)
    sums = np.zeros((BUCKETS, DIMENSIONS + 1))
    for r in some.repartition("chunk").mapInArrow(_adder("<f8"), schema).collect():  # BUCKETS / CHUNK rows
        sums[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["sums"], "<f8").reshape(CHUNK, -1)
    return finish_vectors(sums)


def finish_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors less what chance would give, at length 1, plus half a word's own index vector."""
    counts, contexts = sums[:, 0], sums[:, 1:]
    mean = contexts.sum(axis=0) / max(1.0, counts.sum())
    vectors = contexts - counts[:, None] * mean
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors += 0.5 * _dense(*index_vectors(BUCKETS, SEED))
    return vectors.astype(np.float32)


def pool(texts: list[str | None], vectors: np.ndarray, known: _Codes) -> np.ndarray:
    """A row per text: the mean of its stream's vectors."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        words = stream(known, text)
        if len(words) > BUCKETS:
            out[i] = np.bincount(words, minlength=BUCKETS) @ vectors / len(words)
        elif len(words):
            out[i] = vectors[words].mean(axis=0, dtype=np.float64)
    return out


class Network:
    """Two layers; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, seed: int = SEED):
        self.constant = float(y.mean()) if len(y) else 0.5
        self.trained = len(np.unique(y)) == 2
        if not self.trained:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(seed)
        train = ~apart if len(np.unique(y[~apart])) == 2 else np.ones(len(y), dtype=bool)
        self.w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        zt, yt = z[train], y[train]
        size = min(256, len(yt))
        for _ in range(max(EPOCHS, 2000 * size // max(1, len(yt)) // 2)):
            order = rng.permutation(len(yt))
            for at in range(0, len(yt), size):
                b = order[at : at + size]
                h = np.maximum(0, zt[b] @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -40, 40)))
                g = (p - yt[b]) / len(b)
                gh = np.outer(g, self.w[2]) * (h > 0)
                step += 1
                for k, d in enumerate((zt[b].T @ gh + 1e-4 * self.w[0], gh.sum(axis=0), h.T @ g + 1e-4 * self.w[2], np.array([g.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.w[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits, truth = (self.logit(x[apart]), y[apart]) if len(np.unique(y[apart])) == 2 else (self.logit(x), y)
        grid = np.geomspace(0.25, 16, 61)
        loss = [np.logaddexp(0, np.where(truth == 1, -1, 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


class Classifier:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def scores(self, texts: pa.Array, known: _Codes) -> np.ndarray:
        """A score per text; few texts are Python objects at a time."""
        if len(known) > REMEMBERED:
            known.clear()
        parts = [self.network.predict(pool(texts.slice(at, 64).to_pylist(), self.vectors, known)) for at in range(0, len(texts), 64)]
        return np.concatenate(parts) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """``labels``: doc_id, quality, of the rows to learn from."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    first = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "quality").limit(sample_rows)
    # At most sample_rows pairs.
    picked = spark.createDataFrame([tuple(r) for r in first.collect()], "id long, quality int")
    b = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIMENSIONS numbers
    rows = documents_only(docs, "doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        known = _Codes()
        for batch in batches:
            x = pool(batch.column(2).to_pylist(), b.value, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    got = sorted(tuple(r) for r in rows.mapInArrow(run, "doc_id long, quality int, x binary").collect())
    x = np.array([np.frombuffer(r[2], np.float32) for r in got], dtype=np.float64).reshape(len(got), DIMENSIONS)
    y = np.array([r[1] == 1 for r in got], dtype=np.float64)
    apart = np.array([zlib.crc32(f"apart {r[0]}".encode()) % 5 == 0 for r in got], dtype=bool)
    return Classifier(vectors, Network(x, y, apart))


def score(docs: DataFrame, model: Classifier, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs`` plus score."""
    b = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIMENSIONS numbers
    rows = docs.select(docs["text"].alias("__text"), *[docs[c] for c in keep])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])

    def run(batches):
        known = _Codes()
        give_back()
        for batch in batches:
            scores = b.value.scores(batch.column(0), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return rows.mapInArrow(run, f"{kept}, score double")


def accepted(docs: DataFrame, model: Classifier, least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` or more."""
    b = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _Codes()
        give_back()
        for batch in batches:
            scores = b.value.scores(batch.column(batch.schema.names.index("text")), known)
            yield batch.filter(pa.array(scores >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Classifier:
    labels = table(spark, sf_dir, "labels")
    return fit(docs, labels.where(id_remainder(labels["doc_id"], 4) != 2))


def op1_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, _model(spark, docs, sf_dir), "doc_id")
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with a score under ACCEPT go; an empty or null text stays or goes by its score.

    Repeated rows share their fate, other columns stay as they are, an empty table gives an empty one.
    """
    return accepted(docs, _model(spark, docs, sf_dir))
