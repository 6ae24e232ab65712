"""SimHash near-duplicates by anchor-point covering.

A fingerprint of 64 bits is split into ``BLOCKS`` blocks.  Two fingerprints at
most ``THRESHOLD`` bits apart have a block in which they differ by at most
t = THRESHOLD // BLOCKS bits.  In each block the anchors are a covering code:
the words whose leading bits are code words of the binary Hamming code
[2^r - 1, 2^r - 1 - r], a perfect code of covering radius R = 1, followed by
free bits.  A fingerprint's home is its nearest anchor (within R); a copy of it
goes to every anchor within R + t.  If x and y are within t of each other in a
block, y is within R + t of x's home: comparing each anchor's homes with its
visitors finds every link, exactly.

Copies, homes and keys are column expressions (one XOR mask list per syndrome
of the code), and only distinct fingerprints take part, so exact copies cost
nothing.  A hot anchor is dealt into a grid of (home chunk, visitor chunk)
tasks by all copies that it gets.  Per anchor only the links of a spanning forest are emitted, never all
pairs.  Components come from rounds of large-star and small-star steps over
tables in the shared folder.

Null, empty and blank texts have fingerprint zero, linked like any other.
Null doc_ids take part; a component's id is its smallest non-null doc_id (null
if it has none).  Very long texts are fingerprinted whole, 65,536 shingles at a
time.  Repeated rows are linked.  A bit that is set in just half the shingles'
hashes is 0.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, table

THRESHOLD = 4
BLOCKS = 3
SHINGLE = 4
SEED = 42
#: The Hamming code's parity bits: length 2^4 - 1 = 15.
PARITY = 4
#: Rows of one anchor that a task compares at once; hotter anchors are dealt into a grid.
HOT = 20_000
#: Up to so many copies at an anchor all pairs are compared at once; beyond it one home at a time.
SMALL = 64
#: Texts that are Python objects at a time, and pairs that are compared at a time.
AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 19

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """A hash of each run of ``shingle`` words; of all words if they are fewer, none if there are no words."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist())), dtype="<u8", count=n)


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if over half of the shingles' hashes have it."""
    h = shingle_hashes(raw, shingle)
    n = len(h)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle):
    def run(batches):
        for b in batches:
            texts, fps = b.column(1).cast(pa.binary()), np.zeros(b.num_rows, dtype=np.uint64)
            for at in range(0, b.num_rows, AT_ONCE):
                fps[at : at + AT_ONCE] = [fingerprint(raw or b"", shingle) for raw in texts.slice(at, AT_ONCE).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
            del b, texts
            pa.default_memory_pool().release_unused()

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp)."""
    return documents_only(docs, "doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


# ------------------------------------------------------------- covering anchors


class Code:
    """Anchors of one block of ``width`` bits: Hamming code words, then free bits."""

    def __init__(self, width: int, t: int, parity: int = PARITY):
        self.width, self.t = width, t
        self.parity = parity if width >= 2**parity - 1 else max(r for r in range(2, 8) if 2**r - 1 <= width)
        length = 2**self.parity - 1
        # Column j of the parity check is j + 1; check i sees the bits j with bit i of j + 1.
        self.checks = [sum(1 << j for j in range(length) if (j + 1) >> i & 1) for i in range(self.parity)]
        masks: list[list[int]] = [[] for _ in range(2**self.parity)]
        for weight in range(1 + t + 1):
            for bits in itertools.combinations(range(width), weight):
                e = sum(1 << b for b in bits)
                masks[self.syndrome(e)].append(e)
        #: masks[s]: x XOR these are the anchors within 1 + t of any x of syndrome s, the nearest first.
        self.masks = masks

    def syndrome(self, x: int) -> int:
        return sum((x & c).bit_count() % 2 << i for i, c in enumerate(self.checks))


def codes(blocks: int = BLOCKS, threshold: int = THRESHOLD) -> list[tuple[int, Code]]:
    """(shift, code) of each block; the widths differ by at most one."""
    out, at = [], 0
    for k in range(blocks):
        width = 64 // blocks + (k < 64 % blocks)
        out.append((at, Code(width, threshold // blocks)))
        at += width
    return out


def _copy(x, tag):
    return lambda e, i: F.struct((x.bitwiseXOR(e) + tag).alias("key"), (i == 0).alias("home"))


def copies(fps: DataFrame, blocks: int = BLOCKS, threshold: int = THRESHOLD) -> DataFrame:
    """(key, fp, home): each fingerprint at every anchor within reach, in each block."""
    arrays = []
    for k, (shift, code) in enumerate(codes(blocks, threshold)):
        x = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << code.width) - 1)) if shift else F.col("fp").bitwiseAND(F.lit((1 << code.width) - 1))
        s = sum(((F.bit_count(x.bitwiseAND(F.lit(c))) % 2) * (1 << i) for i, c in enumerate(code.checks)), F.lit(0))
        lists = F.array(*[F.array(*[F.lit(e).cast("long") for e in row]) for row in code.masks])
        arrays.append(F.transform(F.get(lists, s), _copy(x, F.lit(k << 48).cast("long"))))
    return fps.select("fp", F.explode(F.concat(*arrays)).alias("a")).select("a.key", "fp", "a.home")


def _spanning(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one anchor's homes and visitors."""
    label = np.arange(len(fps))
    edges = []
    for h in np.flatnonzero(home).tolist():
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[h]) <= threshold)
        others = np.unique(label[near])
        if len(others) > 1:
            first = {int(label[i]): int(i) for i in near[::-1]}
            edges += [(h, i) for lab, i in first.items() if lab != label[h]]
            label[np.isin(label, others)] = others[0]
    return edges


def _links(threshold, small):
    def pairs(key, fps, home):
        """Links among the rows of whole anchors, sorted by key."""
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        begin = np.concatenate([[0], cuts])
        size = np.diff(np.concatenate([begin, [len(key)]]))
        a, b = [], []
        row_begin, row_size = np.repeat(begin, size), np.repeat(size, size)
        h = np.flatnonzero(home & (row_size > 1) & (row_size <= small))
        step = max(1, PAIRS_AT_ONCE // small)
        for at in range(0, len(h), step):
            hs = h[at : at + step]
            n = row_size[hs]
            left = np.repeat(hs, n)
            right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(row_begin[hs], n)
            ok = (left != right) & (np.bitwise_count(fps[left] ^ fps[right]) <= threshold) & (fps[left] != fps[right])
            a.append(fps[left[ok]])
            b.append(fps[right[ok]])
        for s, n in zip(begin[size > small].tolist(), size[size > small].tolist()):
            g = fps[s : s + n]
            if e := _spanning(g, home[s : s + n], threshold):
                i, j = np.array(e).T
                a.append(g[i])
                b.append(g[j])
        if not a:
            return None
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        e = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        e = e[e[:, 0] != e[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"]) if len(e) else None

    def run(batches):
        held: list[list] = []

        def whole():
            return [np.concatenate(c) for c in zip(*held)]

        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1])
            if held and held[-1][0][-1] != cols[0][-1] or last:
                held.append([c[:last] for c in cols])
                held = [x for x in held if len(x[0])]
                if held and (out := pairs(*whole())) is not None:
                    yield out
                held = []
            held.append([c[last:] for c in cols])
        if held and (out := pairs(*whole())) is not None:
            yield out

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect all that are linked.

    ``fps``: one row per fingerprint, stored.
    """
    spread = copies(fps, blocks, threshold)
    # A task holds an anchor's homes and visitors: both are counted, and hot anchors dealt by both.
    crowds = spread.groupBy("key").agg(F.count("*").alias("all"), F.count_if("home").alias("homes")).where((F.col("all") > hot) & (F.col("homes") > 0))
    # Each listed key stands for more than ``hot`` rows, so the list is that much shorter than the table.
    crowds = crowds.select(F.col("key").alias("hot_key"), F.ceil(F.col("homes") / hot).cast("int").alias("down"), F.ceil(F.col("all") / hot).cast("int").alias("grid"))
    rows = spread.join(crowds, spread["key"] == crowds["hot_key"], "left")
    row, column = F.pmod(F.xxhash64("fp"), F.col("down")).cast("int"), F.pmod(F.xxhash64("fp"), F.col("grid")).cast("int")
    # Cell (i, j) holds the homes of chunk i and the visitors of chunk j; a home is a visitor too.
    as_home = F.transform(F.sequence(F.lit(0), F.col("grid") - 1), lambda j: F.struct((row * F.col("grid") + j).alias("cell"), F.lit(True).alias("home")))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: F.struct((i * F.col("grid") + column).alias("cell"), F.lit(False).alias("home")))
    alone = F.array(F.struct(F.lit(0).alias("cell"), F.col("home").alias("home")))
    cells = F.when(F.col("grid").isNull(), alone).when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)
    dealt = rows.select("key", "fp", F.explode(cells).alias("c")).select("key", "fp", "c.home", "c.cell")
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInArrow(_cells(threshold, small), "a long, b long")


def _cells(threshold, small):
    """Rows sorted by (key, cell): one number for each pair, then as for keys."""
    inner = _links(threshold, small)

    def numbered(batches):
        at, was = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            key, cell = b.column(0).to_numpy(), b.column(3).to_numpy()
            new = np.concatenate([[was is not None and (key[0], cell[0]) != was], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            number = at + np.cumsum(new)
            at, was = int(number[-1]), (key[-1], cell[-1])
            yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), b.column(1), b.column(2)], names=["key", "fp", "home"])

    return lambda batches: inner(numbered(batches))


# ------------------------------------------------------------------- components


def components(edges: DataFrame, folder: WorkFolder) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Large-star and small-star steps in turn until nothing changes; every state
    is a table in the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
        else:
            out = joined.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
        return out.where(F.col("a") != F.col("b")).select("a", "b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = folder.materialise(edges.distinct(), "links0")
    mark, k = state(now), 0
    while mark[0]:
        step = folder.materialise(star(now, True), f"large{k}")
        step = folder.materialise(star(step, False), f"links{k + 1}")
        new = state(step)
        folder.remove(f"large{k}")
        folder.remove(f"links{k}")
        now, k = step, k + 1
        if new == mark:
            break
        mark = new
    # Now every link leads from a node to its component's smallest.
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


#: With so many distinct fingerprints or more the anchors of three blocks are too few.
MANY = 1 << 26


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, first): ``first.doc_id`` is the component's smallest doc_id.  Results don't depend on ``blocks``; without one it follows from the number of fingerprints."""
    folder = WorkFolder(docs.sparkSession, "simhash")
    prints = folder.materialise(fingerprints(docs, shingle), "prints")
    one = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first"))
    one = folder.materialise(one, "distinct")
    return firsts(prints, one, reach(one.select("fp"), folder, threshold, blocks))


def reach(fps: DataFrame, folder: WorkFolder, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """(node, root): the components of distinct fingerprints, stored."""
    blocks = blocks or (BLOCKS if fps.count() < MANY else 2)
    return components(links(fps, threshold, blocks), folder)


def firsts(rows: DataFrame, one: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (with fp) and the first row of their component, by the components of the distinct ``fp``."""
    rooted = one.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = rooted.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    groups = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("first"))
    return rows.join(groups, "fp")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
