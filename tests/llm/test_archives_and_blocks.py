"""Broken gzip streams, repeated pages, and benchmarks that need several automata."""

import gzip
import io
import zlib

import numpy as np
import pytest

from stratagram.llm import decontaminate, warc
from stratagram.llm.common import WorkFolder

RECORDS = [warc.make_record(i, f"u{i}", b"x" * 50 * i, "00" * 20, name=f"r{i}") for i in range(6)]


def members(sizes=(6,)):
    out, at = b"", 0
    for n in sizes:
        out += gzip.compress(b"".join(RECORDS[at : at + n]))
        at += n
    return out


def records(raw):
    return list(warc.split_stream(warc.inflate(io.BytesIO(raw))))


def test_whole_streams():
    assert records(members()) == records(members((2, 3, 1))) == RECORDS
    assert records(members((2, 4)) + bytes(1000)) == records(gzip.compress(RECORDS[0]) + bytes(512) + gzip.compress(RECORDS[1]) + bytes(3)) + RECORDS[2:] == RECORDS
    assert records(b"") == records(bytes(100)) == []


def test_streams_that_are_cut_off():
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    flushed = z.compress(b"".join(RECORDS[:3])) + z.flush(zlib.Z_FULL_FLUSH)
    for raw in (flushed, members()[:-1], members()[:-8], members()[:30], members((3, 3))[:-5]):
        with pytest.raises(ValueError):
            records(raw)


def test_nothing_is_deleted_on_error(spark, tmp_path):
    source = tmp_path / "a.warc.gz"
    for raw, n in ((members()[:-4], None), (members(), 7)):
        source.write_bytes(raw)
        files = spark.createDataFrame([(f"file://{source}", n)], "file string, records long")
        with pytest.raises(Exception, match="ends inside|records of"):
            warc.normalise(files, f"file://{tmp_path}/out", consume=True).collect()
        assert source.exists() and not (tmp_path / "out" / "a.warc.gz").exists()


def test_record_ids_differ(spark):
    big = "y" * 2000
    pages = spark.createDataFrame([(1, "u", big)] * 5 + [(1, "v", big), (0, None, big), (2, "w", "small"), (2, "w", "small"), (None, None, None)], "page_id long, url string, html string")
    folder = WorkFolder(spark, "test")
    index = warc.archive_pages(folder.materialise(pages, "in"), folder)
    ids = [r["record_id"] for r in index.collect()]
    assert len(ids) == len(set(ids)) == 10
    rows = warc.read_records(index).collect()
    assert sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] == 2000) == sorted([(1, "v", "response", None)] + [(1, "u", "revisit", 1)] * 5 + [(0, "", "revisit", 1)])
    twins = pages.where("url = 'u'")
    again = WorkFolder(spark, "test")
    rows = warc.read_records(warc.archive_pages(again.materialise(twins, "in"), again)).collect()
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in rows) == [("response", 0)] + [("revisit", 1)] * 4


def test_automaton_of_a_whole_block():
    rng = np.random.default_rng(1)
    text = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(decontaminate.BLOCK_BYTES // 6))
    built = decontaminate.automaton(decontaminate.windows([("a", text)]))
    assert built.get_stats()["total_size"] < 150 << 20


def test_long_item_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STRETCH", 30)
    words = [f"w{i}" for i in range(500)]
    bench = spark.createDataFrame([("long", " ".join(words)), ("short", "only three words"), ("none", "-- !"), ("null", None)], "item_id string, text string")
    texts = [(k, "x " + " ".join(words[k : k + 10]) + " y") for k in range(491)] + [(1000, "Only THREE, words"), (1001, " ".join(words[3:12])), (1002, None)]
    docs = spark.createDataFrame([(*t, 5, 6) for t in texts], "doc_id long, text string, hit int, `__row` int")
    found = decontaminate.find_contamination(docs, bench, block_bytes=700).collect()
    want = {k: (10, ["long"]) for k in range(491)} | {1000: (3, ["short"]), 1001: (0, []), 1002: (0, [])}
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in found} == want and all(r["__row"] == 6 for r in found)
    clean = decontaminate.drop_contaminated(docs, bench, block_bytes=700)
    assert sorted(r["doc_id"] for r in clean.collect()) == [1001, 1002]
