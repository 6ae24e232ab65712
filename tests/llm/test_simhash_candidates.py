"""The pipeline's near-duplicate stage takes SimHash's components as candidates."""

from itertools import combinations

from stratagram.llm import jaccard, simhash
from stratagram.llm.common import WorkFolder

from .test_near_copies import near_texts


def test_components_are_candidates(spark):
    texts = near_texts()
    rows = [(i, simhash.fingerprint((t or "").encode())) for i, t in enumerate(texts)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    folder = WorkFolder(spark, "test")
    prints = folder.materialise(spark.createDataFrame([(i, signed(fp)) for i, fp in rows], "fp long, bits long"), "prints")
    keys = {r["fp"]: r["key"] for r in jaccard.covered(prints, folder).collect()}
    least = list(range(len(rows)))
    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= simhash.THRESHOLD and least[i] != least[j]:
            low, high = sorted((least[i], least[j]))
            least = [low if x == high else x for x in least]
    assert len(set(least)) < len(rows)
    assert [keys[i] == keys[j] for i, j in combinations(range(len(rows)), 2)] == [least[i] == least[j] for i, j in combinations(range(len(rows)), 2)]


def test_prints_have_the_operators_fingerprints():
    import pyarrow as pa

    text = "one two three four five six"
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([3]), pa.array([text])], names=["doc_id", "h1", "h2", "text"])
    (out,) = jaccard._prints([batch])
    assert out.column("bits")[0].as_py() & ((1 << 64) - 1) == simhash.fingerprint(text.encode())
