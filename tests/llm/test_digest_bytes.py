"""The quartile digest against a version that takes one byte window after another, and ties of doc_id in the query."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stratagram.llm import digest
from stratagram.llm.queries import QUERIES

M = 1 << 32
# (offsets of the bytes in a window, their multipliers): fixed values of the format.
KINDS = [((0, 1, 2), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), ((0, 1, 3), (0x27D4EB2F, 0x165667B1, 0xD3A2646D)), ((0, 2, 4), (0xB5297A4D, 0x68E31DA5, 0x1B56C4E9))]
LAST = 0x2C1B3C6D


def plain_counts(raw):
    counts = [0] * 128
    for at in range(len(raw) - 4):
        window = raw[at : at + 5]
        for (i, j, k), (p, q, r) in KINDS:
            h = (((window[i] * p % M) ^ (window[j] * q % M)) + window[k] * r) % M
            counts[((h ^ (h >> 15)) * LAST % M) >> 25] += 1
    return counts


def plain_digest(raw):
    counts = plain_counts(raw)
    ranked = sorted(counts)
    q1, q2, q3 = ranked[31], ranked[63], ranked[95]
    head = [hashlib.blake2b(raw, digest_size=1).digest()[0], min(255, round(12 * math.log(1 + len(raw))))]
    head += [(q1 * 16 // (q3 or 1)) % 16 * 16 + (q2 * 16 // (q3 or 1)) % 16, 0]
    code = [0 if c <= q1 else 1 if c <= q2 else 2 if c <= q3 else 3 for c in counts]
    return bytes(head + [sum(code[i + k] * 4**k for k in range(4)) for i in range(0, 128, 4)])


def plain_likeness(a, b):
    apart = int(a[0] != b[0]) + max(0, abs(a[1] - b[1]) - 2) + abs(a[2] // 16 - b[2] // 16) + abs(a[2] % 16 - b[2] % 16)
    for x, y in zip(a[4:], b[4:]):
        for k in range(4):
            step = abs(x // 4**k % 4 - y // 4**k % 4)
            apart += 6 if step == 3 else step
    return 1 - min(160, apart) / 160


def texts():
    draw = random.Random(9)
    yield from (b"", b"a", b"abcd", b"abcde", b"abcdef", b"\xff" * 40, "Größe 中文".encode())
    for n in (5, 60, 700, 5000):
        yield bytes(draw.randrange(256) for _ in range(n))
        yield " ".join(draw.choice(("the", "of", "cat", "sat", "mat")) for _ in range(n // 4)).encode()


def test_digest_and_difference_byte_by_byte():
    found = [(raw, digest.digest(raw)) for raw in texts()]
    for raw, got in found:
        assert digest.bucket_counts(raw).tolist() == plain_counts(raw)
        assert got == plain_digest(raw)
    for _, a in found:
        for _, b in found:
            assert digest.likeness(a, b) == pytest.approx(plain_likeness(a, b))
            assert digest.likeness(a, b) == digest.likeness(b, a) and 0 <= digest.likeness(a, b) <= 1


@pytest.mark.parametrize("over", [-1, 0, 1, 4, 5, 4097])
def test_very_long_texts_are_counted_over_the_seams_of_chunks(over, monkeypatch):
    monkeypatch.setattr(digest, "_CHUNK", 4096)
    raw = random.Random(over).randbytes(4096 + over)
    assert digest.bucket_counts(raw).tolist() == plain_counts(raw)


def test_query_with_ties_of_doc_id(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i // 3 if i < 30 else None if i < 34 else i, None if i % 11 == 0 else "".join(draw.choice("ab é中\n") for _ in range(draw.randrange(90)))) for i in range(60)]
    rows += rows[5:9] * 2
    at = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{at}/documents.parquet")
    stored = spark.read.parquet(f"{at}/documents.parquet").withColumn("h", F.xxhash64("text")).collect()
    order = sorted(stored, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"] or ""))
    expected = []
    for r, s in zip(order, order[1:] + order[:1]):
        text, after = r["text"] or "", s["text"] or ""
        k = len(text) // 3
        edited = (text[: len(text) - k] + after[:k]).encode()
        own, changed, other = (plain_digest(x) for x in (text.encode(), edited, after.encode()))
        expected.append((r["doc_id"], len(text), hashlib.sha256(edited).hexdigest(), own.hex(), changed.hex(), round(plain_likeness(own, changed), 9), round(plain_likeness(own, other), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in QUERIES["op9_quartile_digest"](spark, at).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
