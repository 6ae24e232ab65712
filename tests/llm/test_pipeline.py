"""The pipeline's stages, each on its own input, against plain versions."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from stratagram.llm import secrets
from stratagram.llm.common import WorkFolder, table

from .test_near_copies import brute_least
from .test_operators import brute_hits, library_ids


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    folder = WorkFolder(spark, "test")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        docs = folder.materialise(stage(spark, docs, sf), name)
        after = [r.asDict() for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "quality_classifier":
            assert 0.5 * len(before) < len(after) <= len(before) and all(r in before for r in after)
        elif name == "simhash_near_dedup":
            rows = sorted(before, key=lambda r: r["doc_id"])
            assert sorted(r["doc_id"] for r in after) == sorted({rows[k]["doc_id"] for k in brute_least([r["text"] for r in rows])})
        elif name == "benchmark_decontamination":
            items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not brute_hits(r["text"], items)[1])
        elif name == "secret_scans":
            novelty = secrets.Novelty()
            want = {r["doc_id"]: secrets.redact(r["text"], secrets.find_spans(r["text"], novelty)) for r in before}
            assert {r["doc_id"]: r["text"] for r in after} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after if "[ASSIGN]" in r["text"])
        else:
            total = {}
            for r in after:
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
                assert len(r["ids"]) == r["length"]
            assert total == {r["doc_id"]: len(library_ids(r["text"], 0)) for r in before}


def test_awkward_stage_inputs(spark, awkward):
    docs = table(spark, awkward, "documents")
    for clash in ("rid", "score", "n_hit", "items", "secrets", "fp", "first"):
        docs = docs.withColumn(clash, F.lit(7))
    folder = WorkFolder(spark, "test")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = folder.materialise(stage(spark, docs, awkward), name)
        assert docs.columns == columns or name == "best_fit_packing"
    assert docs.count() > 0


def test_stages_of_nothing(spark, empty):
    docs = table(spark, empty, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = WorkFolder(spark, "test").materialise(stage(spark, docs, empty), "out")
        assert docs.count() == 0


def test_run_is_stages(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    digest = hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)).encode()).hexdigest()
    again = corpus_pipeline.run(spark, sf).collect()
    assert digest == hashlib.sha256(repr(sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again)).encode()).hexdigest()


from .test_operators import awkward, empty  # noqa: E402, F401
