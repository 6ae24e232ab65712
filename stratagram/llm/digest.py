"""Quartile bucket digests of texts.

Every byte window of five gives hashed byte triplets; their counts in 128
buckets are coded by quartile, two bits each, in front of them a checksum, the
length's logarithm and the quartiles' ratios.  ``difference`` adds up bounded
steps between two digests and stops at ``FARTHEST``; ``likeness`` is 1 minus
its share of that.  Equal texts have equal digests.

Null text counts as empty; texts too short for a window have all counts zero.
Repeated rows are kept; ties of doc_id are ordered by text hash and text; null
doc_ids come last in descending order.  Very long texts are counted whole, a
chunk of windows at a time.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, shuffle_parts, table

BUCKETS = 128
#: Offsets of a triplet's bytes in the window, with the multipliers of its hash.
TRIPLETS = (((0, 1, 2), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), ((0, 1, 3), (0x27D4EB2F, 0x165667B1, 0xD3A2646C | 1)), ((0, 2, 4), (0xB5297A4D, 0x68E31DA4 | 1, 0x1B56C4E9)))
WINDOW = 5
#: Differences from here on count as nothing in common.
FARTHEST = 160
_CHUNK = 1 << 18


def bucket_counts(raw: bytes) -> np.ndarray:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(raw) - WINDOW + 1), _CHUNK):
        b = np.frombuffer(raw, np.uint8, count=min(_CHUNK + WINDOW - 1, len(raw) - at), offset=at).astype(np.uint32)
        n = len(b) - WINDOW + 1
        for offsets, factors in TRIPLETS:
            h = b[offsets[0] : offsets[0] + n] * np.uint32(factors[0])
            h ^= b[offsets[1] : offsets[1] + n] * np.uint32(factors[1])
            h += b[offsets[2] : offsets[2] + n] * np.uint32(factors[2])
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def digest(raw: bytes) -> bytes:
    """4 bytes of header, 32 of quartile codes."""
    counts = bucket_counts(raw)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    body = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(math.log(len(raw) + 1) * 12))
    ratio = lambda q: q * 16 // max(q3, 1) & 15
    check = hashlib.blake2b(raw, digest_size=1).digest()[0]
    return bytes([check, length, ratio(q1) << 4 | ratio(q2), 0]) + body.tobytes()


def difference(a: bytes, b: bytes) -> int:
    """0 to FARTHEST: code steps (a step over all codes counts double), length beyond a fifth, ratios."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    steps = 0
    for shift in (0, 2, 4, 6):
        d = np.abs((x[4:] >> shift & 3).astype(np.int64) - (y[4:] >> shift & 3))
        steps += int(d.sum() + 3 * (d == 3).sum())
    steps += max(0, abs(a[1] - b[1]) - 2)
    steps += abs((a[2] >> 4) - (b[2] >> 4)) + abs((a[2] & 15) - (b[2] & 15))
    return int(min(FARTHEST, steps + (a[0] != b[0])))


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / FARTHEST


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with its digest as hexadecimal text."""

    def run(batches):
        for b in batches:
            out = [digest((t or "").encode()).hex() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return documents_only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ROWS = _RESULT + ", kind int, part int, text string"
_DONE, _HEAD, _TAIL = 0, 1, 2


def _compare(text: str, own: bytes, after: str, next_: bytes) -> tuple:
    k = len(text) // 3
    raw = (text[: len(text) - k] + after[:k]).encode()
    edited = digest(raw)
    return len(text), hashlib.sha256(raw).hexdigest(), own.hex(), edited.hex(), likeness(own, edited), likeness(own, next_)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kind", "part", "text"]


def _batch(rows, n):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES[:n])], names=_NAMES[:n])


def _stream(batches):
    """Sorted rows of a partition: each with the one that follows; its first and last row besides."""
    from pyspark import TaskContext

    part, was, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            own = digest(text.encode())
            if was is None:
                out.append((doc_id, *[None] * 6, _HEAD, part, text))
            else:
                out.append((was[0], *_compare(was[1], was[2], text, own), _DONE, part, None))
            was = doc_id, text, own
            if len(out) >= 500:
                yield _batch(out, 10)
                out = []
    if was is not None:
        out.append((was[0], *[None] * 6, _TAIL, part, was[1]))
        yield _batch(out, 10)


def _pairs(batches):
    for b in batches:
        rows = [(i, *_compare(t, digest(t.encode()), u, digest(u.encode()))) for i, t, u in zip(*[c.to_pylist() for c in b.columns])]
        if rows:
            yield _batch(rows, 7)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document, doc_id descending, the last before the first."""
    spark = docs.sparkSession
    order = [F.col("doc_id").desc(), F.xxhash64("text"), F.col("text")]
    dealt = documents_only(docs, "doc_id", "text").repartitionByRange(shuffle_parts(spark), *order[:2]).sortWithinPartitions(*order)
    stored = WorkFolder(spark, "digests").materialise(dealt.mapInArrow(_stream, _ROWS), "rows")
    heads = stored.where(F.col("kind") == _HEAD).select("part", "text")
    tails = stored.where(F.col("kind") == _TAIL).select("part", "doc_id", "text")
    # One row per partition that holds rows.
    every = Window.orderBy("part")
    follows = heads.select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    seams = tails.join(follows, "part").join(heads.select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after")
    seams = seams.select("doc_id", "text", "next_text").mapInArrow(_pairs, _RESULT)
    return stored.where(F.col("kind") == _DONE).select(*_NAMES[:7]).unionByName(seams)


def op9_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
