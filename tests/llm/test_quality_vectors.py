"""Word vectors and pooling of the quality classifier against plain loops."""

import re

import numpy as np

from stratagram.llm import quality

TEXTS = [None, "", "One two two THREE x1 42 !! # one", "a b a b a\na b a b a\nlast Line.", "solo", "ß É É 日本"]


def plain_stream(text):
    tokens = re.findall(r"\w+|[^\w\s]+", text or "")
    out = []
    for i, token in enumerate(tokens):
        out.append(quality.bucket(token.lower()))
        name = quality._SHAPES[quality.shape(token)]
        if name:
            out.append(quality.bucket(f" {name}"))
        if i and tokens[i - 1].lower() == token.lower():
            out.append(quality.bucket(" again"))
        elif i > 1 and tokens[i - 2].lower() == token.lower():
            out.append(quality.bucket(" after one"))
    lines = (text or "").split("\n")
    said = len(lines) - len(set(lines))
    if said and tokens:
        out += [quality.bucket(" line")] * max(1, round(said / len(lines) * len(tokens)))
    return out


def plain_sums(texts):
    places, signs = quality.index_vectors(quality.BUCKETS, quality.SEED)
    sums = np.zeros((quality.BUCKETS, quality.DIMENSIONS + 1))
    for words in map(plain_stream, texts):
        for i, w in enumerate(words):
            sums[w, 0] += 1
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if i != j:
                    for place, sign in zip(places[words[j]], signs[words[j]]):
                        sums[w, 1 + place] += sign
    return sums


def test_stream():
    known = quality._Codes()
    assert [quality.stream(known, t).tolist() for t in TEXTS] == [plain_stream(t) for t in TEXTS]


def test_table_and_pooling(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").repartition(3)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, quality.finish_vectors(plain_sums(TEXTS * 3)), atol=1e-5)
    want = [np.mean([vectors[w] for w in plain_stream(t)], axis=0) if plain_stream(t) else np.zeros(quality.DIMENSIONS) for t in TEXTS]
    assert np.allclose(quality.pool(TEXTS, vectors, quality._Codes()), want, atol=1e-5)


def test_long_text_pools_like_a_short_one(spark):
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    text = "Many words and 7 marks !! " * 4000
    want = np.mean([vectors[w] for w in plain_stream(text)], axis=0)
    assert np.allclose(quality.pool([text], vectors, quality._Codes())[0], want, atol=1e-4)


def test_both_halves_of_the_marks(spark):
    """Shapes and repeats change a stream only by their own words."""
    known = quality._Codes()
    assert set(quality.stream(known, "ONE one")) - set(quality.stream(known, "one")) == {quality.bucket(" upper"), quality.bucket(" again")}
