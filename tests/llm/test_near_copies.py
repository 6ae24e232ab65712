"""The pipeline's near-duplicate stage against brute force on five-word sets."""

from itertools import combinations

import numpy as np
import pytest

from stratagram.llm import jaccard
from stratagram.llm.common import WorkFolder


def near_texts():
    """Copies with ever more words changed, a hub whose spokes are near it only, and unlike texts."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = [None, "", "  ", "one two", "One  two", "one three"]
    for length in (30, 120, 300):
        for _ in range(8):
            base = word(length)
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.04):
                texts.append(" ".join(w if rng.random() > share else word(1)[0] for w in base))
    hub = word(200)
    texts += [" ".join(hub)] + [" ".join(hub[:k] + word(2) + hub[k + 2 :]) for k in range(10, 190, 9)]
    texts += [" ".join(hub[:k] + word(1) + hub[k + 1 : k + 60] + word(1) + hub[k + 61 : k + 90] + word(1) + hub[k + 91 :]) for k in range(5, 100, 4)]
    return texts


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_least(texts):
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    least = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if near(sets[i], sets[j]) and least[i] != least[j]:
            low, high = sorted((least[i], least[j]))
            least = [low if x == high else x for x in least]
    return least


@pytest.mark.parametrize("hot", [500, 10])
def test_near_copies(spark, hot):
    texts = near_texts()
    docs = WorkFolder(spark, "test").materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "in")
    found = {r["doc_id"]: r["first"]["doc_id"] for r in jaccard.near_copies(docs, hot=hot).collect()}
    assert [found[i] for i in range(len(texts))] == brute_least(texts)


def test_stage_similarity(spark):
    texts = near_texts()
    docs = WorkFolder(spark, "test").materialise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "in")
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(brute_least(texts)))


def test_spanning_is_exact_at_the_bound():
    sets = [np.arange(k, k + 9, dtype=np.uint64) for k in (0, 1, 3)]
    assert jaccard.spanning(sets, np.array([True] * 3)) == [(0, 1)]


def test_rows_keep_their_names_however_a_table_is_split(spark, tmp_path):
    """The stage reads its table several times; other splits and cores give the same rows."""
    texts = near_texts()
    path = f"file://{tmp_path}/docs"
    rows = list(enumerate(texts)) + [(None, texts[10]), (None, "apart from all the others"), (3, texts[3]), (3, texts[3]), (400, "said twice by one row"), (400, "said twice by one row")]
    frame = spark.createDataFrame([(*r, 7, [1]) for r in rows], "doc_id long, text string, fp int, `first` array<int>")
    frame.repartition(5).write.parquet(path)
    kept = []
    try:
        for parts in ("1", "16"):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            out = jaccard.near_dedup_stage(spark, spark.read.parquet(path), "")
            spark.conf.set("spark.sql.files.minPartitionNum", "3")
            assert out.columns == frame.columns
            kept.append(sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "", r["fp"], tuple(r["first"])) for r in out.collect()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert kept[0] == kept[1]
    want = sorted(set(brute_least(texts)) | {400})
    assert [k[1] for k in kept[0] if not k[0]] == want and [k[2] for k in kept[0] if k[0]] == ["apart from all the others"]


def test_large_groups_of_repeats(spark):
    """Thousands of equal rows, of equal texts, and none at all."""
    docs = spark.createDataFrame([(1, "the same row again and again")] * 3000 + [(i, "the same text in other rows") for i in range(5, 3005)] + [(9000, None), (9001, "")], "doc_id long, text string")
    folder = WorkFolder(spark, "test")
    docs = folder.materialise(docs, "in")
    assert sorted(r["doc_id"] for r in jaccard.near_dedup_stage(spark, docs, "").collect()) == [1, 5, 9000]
    assert jaccard.near_dedup_stage(spark, docs.limit(0), "").count() == 0
