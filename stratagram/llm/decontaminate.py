"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are lower-cased (A-Z), cut into words and every window of
``WINDOW`` consecutive words (or the whole of a shorter item) becomes a
pattern.  Each document is normalised the same way and scanned once; a hit
covers the window's words, and offsets lead back to the original text.

An automaton takes some 300 times the bytes of its items, so it is built from
``BLOCK_BYTES`` of them at most, once per worker.  A larger benchmark is dealt
into blocks of stretches of items that overlap by a window, each scanned in
turn, and the hits are merged, so every window counts at any size.

Null or wordless texts have no words and no hits; wordless items have no
window.  Repeated items each count by their own id, an item id that occurs
twice counts once.  Null item ids are ignored in the list of items.  Repeated
rows are kept.  Very long texts are scanned whole, one at a time.  Empty tables
give no rows or no hits.  Other columns pass by unread.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, table

WINDOW = 10
#: Bytes of benchmark text that one automaton may be built from: some 80 MB of automaton.
BLOCK_BYTES = 256 << 10
#: Words of an item that are dealt as one; longer items go in stretches.
STRETCH = 1000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z; other ASCII that is no word character to a blank.  Bytes over 0x7F are word characters.
_TO = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def _words(raw: bytes | None) -> list[bytes]:
    return [w for w in raw.translate(_TO).split(b" ") if w] if raw else []


def windows(items: list[tuple], window: int = WINDOW) -> dict[bytes, tuple[int, list]]:
    """Pattern (blank, words, blank) -> number of words, item ids."""
    out: dict[bytes, tuple[int, list]] = {}
    for item_id, text in items:
        words = _words((text or "").encode())
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            ids = out.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", (n, []))[1]
            if item_id is not None and item_id not in ids:
                ids.append(item_id)
    return out


def automaton(patterns: dict[bytes, tuple[int, list]]):
    """Bytes are read as Latin-1: matches of whole blank-bounded words are the same."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for pattern, (n, ids) in patterns.items():
        a.add_word(pattern.decode("latin-1"), (n, tuple(ids)))
    a.make_automaton()
    return a


def scan(raw: bytes | None, a) -> tuple[int, np.ndarray | None, set]:
    """Number of words, flags of the words hit (None: none), ids of the items found."""
    words = _words(raw)
    if not words or not len(a):
        return len(words), None, set()
    text = " " + b" ".join(words).decode("latin-1") + " "
    hit, items, ends = None, set(), None
    for end, (n, ids) in a.iter(text):
        if hit is None:
            hit = np.zeros(len(words) + 1, dtype=np.int32)
            ends = np.cumsum([len(w) + 1 for w in words])
        last = int(np.searchsorted(ends, end))
        hit[last + 1 - n] += 1
        hit[last + 1] -= 1
        items.update(ids)
    return len(words), None if hit is None else np.cumsum(hit[:-1]) > 0, items


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Hit words as stretches of code points of the original text, joined where neighbours."""
    out: list[list[int]] = []
    was = False
    for flag, m in zip(hit.tolist(), _WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))):
        if flag and was:
            out[-1][1] = m.end()
        elif flag:
            out.append([m.start(), m.end()])
        was = flag
    return [(a, b) for a, b in out]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words long, n_hit long, hit binary, items array<string>, spans array<struct<start:long,end:long>>"


_built: list = []


def _automaton_of(broadcast):
    """This worker's automaton of a broadcast block; the one before it goes."""
    key = broadcast.value[2]
    if not _built or _built[0] != key:
        _built.clear()
        _built.extend([key, automaton(windows(*broadcast.value[:2]))])
    return _built[1]


def _scanner(broadcast, names):
    def run(batches):
        a = _automaton_of(broadcast)
        for batch in batches:
            at = batch.schema.names.index("text")
            n, n_hit, hits, items, spans = [], [], [], [], []
            for cell in batch.column(at).cast(pa.binary()):
                raw = cell.as_py()
                count, hit, found = scan(raw, a)
                n.append(count)
                n_hit.append(0 if hit is None else int(hit.sum()))
                hits.append(None if hit is None else np.packbits(hit).tobytes())
                items.append(sorted(map(str, found)))
                spans.append([] if hit is None else [{"start": x, "end": y} for x, y in _spans(raw.decode(), hit)])
            keep = [batch.column(batch.schema.names.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN)], names=[*names, "n_words", "n_hit", "hit", "items", "spans"])

    return run


def _merge(batches):
    """Hits of all blocks of one document -> n_hit."""
    for b in batches:
        n_hit = []
        for hits in b.column(b.schema.names.index("hits")).to_pylist():
            total = None
            for h in hits or []:
                flags = np.frombuffer(h, np.uint8)
                total = flags if total is None else total | flags
            n_hit.append(0 if total is None else int(np.bitwise_count(total).sum()))
        i = b.schema.names.index("hits")
        yield pa.RecordBatch.from_arrays([*b.columns[:i], pa.array(n_hit, pa.int64())], names=[*b.schema.names[:i], "n_hit"])


def _stretches(window):
    """Items as (item_id, text); long ones in stretches that overlap by a window less a word."""

    def run(batches):
        for batch in batches:
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = _words(cell.as_py())
                cut = [b" ".join(words[at : at + STRETCH + window - 1]).decode() for at in range(0, max(1, len(words) - window + 1), STRETCH)]
                for at in range(0, len(cut), 256):
                    part = cut[at : at + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), batch.column(0).type), pa.array(part, pa.string())], names=["item_id", "text"])

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of (items, window, name), each made of about ``block_bytes`` of the benchmark."""
    spark = benchmark.sparkSession
    items = documents_only(benchmark, "item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    if n > 1:
        items = WorkFolder(spark, "benchmark").materialise(items.mapInArrow(_stretches(window), items.schema), "stretches")
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(([tuple(r) for r in (items if n == 1 else items.where(own == k)).collect()], window, uuid.uuid4().hex)) for k in range(n)]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs."""

    def filter_by(broadcast):
        def run(batches):
            a = _automaton_of(broadcast)
            for batch in batches:
                texts = batch.column(batch.schema.names.index("text")).cast(pa.binary())
                clean = [scan(raw, a)[1] is None for at in range(0, batch.num_rows, 256) for raw in texts.slice(at, 256).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    blocks, folder = _blocks(benchmark, window, block_bytes), WorkFolder(docs.sparkSession, "decontaminate")
    for k, b in enumerate(blocks):
        if k:  # one automaton in a worker at a time
            docs = folder.materialise(docs, f"block{k}")
        docs = docs.mapInArrow(filter_by(b), docs.schema)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, items (sorted as strings), spans of the original text.

    Columns of ``docs`` with those names, and hit, are replaced.  With several blocks
    ``spans`` lists each block's stretches and may overlap.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_hit", "hit", "items", "spans")
    blocks = _blocks(benchmark, window, block_bytes)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    if len(blocks) == 1:
        found = docs.mapInArrow(_scanner(blocks[0], docs.columns), f"{plain}, {_FOUND}")
        return found.drop("hit")
    folder = WorkFolder(spark, "decontaminate")
    keyed = folder.materialise(docs.withColumn("__stratagram_row", F.monotonically_increasing_id()), "rows")
    parts = None
    for k, b in enumerate(blocks):
        found = keyed.select("__stratagram_row", "text").mapInArrow(_scanner(b, ["__stratagram_row"]), f"__stratagram_row long, {_FOUND}").where(F.col("hit").isNotNull() | (F.lit(k) == 0))
        part = folder.materialise(found, f"block{k}")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("__stratagram_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.collect_list("hit").alias("hits"),
    )
    merged = merged.mapInArrow(_merge, "__stratagram_row long, n_words long, items array<string>, spans array<struct<start:long,end:long>>, n_hit long")
    return keyed.join(merged, "__stratagram_row").drop("__stratagram_row")


def op7_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents_only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents with a benchmark window go; null and empty texts, which have none, stay, repeated rows share their fate, an empty table stays empty."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH items AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM sized, unnest(range(1, len(w) - n + 2)) AS r(i)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_WORDS} AS w FROM documents),
spots AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM docs, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT rid, i, n, item_id FROM spots JOIN windows USING (n, k)),
hits AS (SELECT rid, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS r(j) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""
