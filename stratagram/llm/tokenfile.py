"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters.

``write_tokens`` encodes whole texts and writes one row per document, in
ascending doc_id order over all files: ORC run-length encodes the ids, keeps
row-group minima and maxima of every column and a Bloom filter on doc_id.
Readers take stripes in parallel (a split per stripe) and skip files, stripes
and row groups that can't hold a wanted doc_id.

Null text counts as empty (the end id alone).  Null doc_id sorts first.  Rows
that share a doc_id are all kept, ordered by text hash and text.  Very long
texts are encoded whole.  An empty table gives files without rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, shuffle_parts, table
from .encoding import encoder

END_ID = 2
#: Bytes of a stripe, rows of a row group, and the share of false Bloom hits.
STRIPE_BYTES = 32 << 20
ROW_GROUP = 1000
BLOOM_FPP = 0.01
#: Documents that are encoded, and handed on, at once.
AT_ONCE = 128

_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path, end_id):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(i, AT_ONCE)
                raw = [ids + end for ids in enc.encode(rows.column(1).to_pylist())]
                n = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), rows.column(0), pa.array(at + offsets[:-1]), pa.array(n), ids], schema=_ARROW)
                at += int(offsets[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write them as ORC below ``path``."""
    spark = docs.sparkSession
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    dealt = documents_only(docs, "doc_id", "text").repartitionByRange(files or shuffle_parts(spark), *order[:2])
    rows = dealt.sortWithinPartitions(*order).mapInArrow(_encode(vocabulary, end_id), _SCHEMA)
    (
        rows.write.mode("overwrite")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_GROUP)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .orc(path)
    )


def starts(files: DataFrame) -> DataFrame:
    """(part, base): ids in all files before each file; one row per file."""
    totals = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids); with ``doc_ids`` only what metadata can't rule out is read."""
    files = spark.read.schema(_SCHEMA).orc(path)
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin([int(x) for x in doc_ids]))
    # One row per file: as small as the list of files that the driver holds anyway.
    base = F.broadcast(starts(files))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for b in batches:
        ids = b.column(3)
        raw, at = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")), ids.offsets.to_numpy()
        crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{WorkFolder(spark, 'tokens')}/orc"
    write_tokens(table(spark, sf_dir, "documents"), path)
    files = spark.read.schema(_SCHEMA).orc(path)
    rows = files.select("part", "doc_id", "local_start", "ids").mapInArrow(_digest, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts(files)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
