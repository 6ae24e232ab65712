"""The corpus pipeline: quality, near duplicates, contamination, secrets, packing.

``run`` writes each stage as Parquet in the shared folder and reads it again
for the next, so a lost executor costs part of a stage at most.  The stage of
near duplicates takes SimHash's links and those of min-hash bands as candidates
and decides by the Jaccard similarity of five-word shingles; the README says why.

Null and empty texts stay or go by their score in the first stage, one of all
that are left stays in the second, and the others keep it.  Repeated rows share
their fate until near duplicates, where one stays.  Empty tables give no
pieces.  Other columns pass until packing, which drops them.
Each stage's docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagram.llm.common import WorkFolder, table
from stratagram.llm.decontaminate import decontamination_stage
from stratagram.llm.jaccard import near_dedup_stage
from stratagram.llm.packing import packing_stage
from stratagram.llm.quality import quality_stage
from stratagram.llm.secrets import secrets_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the compressor and the tokenizer have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = WorkFolder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = folder.materialise(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
