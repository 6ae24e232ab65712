"""Near copies by SimHash and an exact check of word shingles, for the pipeline's stage.

SimHash is op6's: fingerprints of four-word shingles, linked within four bits
by the covering code.  Its components are candidates.  Two documents are linked
if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Such pairs differ in up to 17 of SimHash's 64 bits, more than a covering code
can reach, so min-hash bands add the candidates that it leaves out: a
pair at 0.8 shares none of the ``BANDS`` bands once in 3 million, a pair above
it more seldom.  Documents of a SimHash component or a band are joined to coarse
groups, and within a coarse group every link is decided by the sets themselves.

Only distinct sets take part, so exact copies cost nothing.  A coarse group of
over ``HOT`` sets is dealt into chunks, each with the group's pivots; what the
pivots leave apart from the group's largest part is then compared with the
whole group, chunk by chunk.  Only the links of a spanning forest are emitted.

Rows are named by two hashes of doc_id and text, which are the same however a
table is split, so a lost executor or another number of cores changes nothing.
Texts move only where they must: a bitmap of fixed size, from the hashes of the
rows that matter, lets all other rows pass without a shuffle.

Null and empty texts and texts without words have the empty set and are linked
to each other.  A text of fewer than five words has one shingle.  Very long
texts are read whole.  Of a group the row of the smallest doc_id stays (null
last, ties by the rows' hashes); of rows that agree in doc_id and text, one.
An empty table gives an empty one.  Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, give_back
from .simhash import AT_ONCE, SEED, components, fingerprint, firsts, reach, shingle_hashes

WORDS = 5
#: Similarity is at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
BANDS, ROWS = 64, 7
#: Sets of one coarse group that a task compares at once.
HOT = 500
PIVOTS = 8

_draw = np.random.default_rng(SEED)
_TIMES, _PLUS = (_draw.integers(0, 1 << 64, (BANDS * ROWS, 1), dtype=np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _draw.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingle_set(raw: bytes) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(shingle_hashes(raw, WORDS))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; equal sets have equal keys."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048] * _TIMES + _PLUS).min(axis=1))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND


def _prints(batches):
    give_back()
    for b in batches:
        texts = b.column(3).cast(pa.binary())
        for at in range(0, b.num_rows, AT_ONCE):
            raws = [raw or b"" for raw in texts.slice(at, AT_ONCE).to_pylist()]
            sets = [shingle_set(raw) for raw in raws]
            bits = np.array([fingerprint(raw) for raw in raws], dtype=np.uint64).view(np.int64)
            fps = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64).view(np.int64)
            keys = pa.array([band_keys(h).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*[c.slice(at, AT_ONCE) for c in b.columns[:3]], pa.array(fps), pa.array(bits), keys], names=["doc_id", "h1", "h2", "fp", "bits", "keys"])
        del b, texts
        pa.default_memory_pool().release_unused()


def _bands(batches):
    """A row for each band of each set; a task's copies of a set count once."""
    seen = set()
    for b in batches:
        fps = b.column(0).to_pylist()
        new = [i for i, fp in enumerate(fps) if not (fp in seen or seen.add(fp))]
        for at in range(0, len(new), 4096):
            part = b.take(pa.array(new[at : at + 4096]))
            keys = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], names=["key", "fp"])


def covered(prints: DataFrame, folder: WorkFolder) -> DataFrame:
    """(key, fp) of ``prints`` (fp, bits): sets whose SimHash fingerprints reach each other within four bits have one key."""
    marks = folder.materialise(prints.select("fp", "bits").distinct(), "marks")
    roots = reach(folder.materialise(marks.select(F.col("bits").alias("fp")).distinct(), "bits"), WorkFolder(prints.sparkSession, "simhash"))
    return marks.join(roots, F.col("bits") == F.col("node"), "left").select(F.coalesce("root", "bits").alias("key"), "fp")


def _stars(batches):
    """Rows sorted by (key, fp): each fp with the first of its key."""
    was, first = None, None
    for b in batches:
        if not b.num_rows:
            continue
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.concatenate([[was is None or key[0] != was], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        head = np.where(begin >= 0, fp[begin], fp[0] if first is None else first)
        was, first = key[-1], head[-1]
        if (apart := head != fp).any():
            e = np.unique(np.stack([head[apart], fp[apart]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])


def spanning(sets: list[np.ndarray], home: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs with a home that are similar enough."""
    size = np.array([len(h) for h in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, ends = np.repeat(np.arange(len(sets)), size), np.cumsum(size)
    mark, label, edges = np.zeros(len(ids), dtype=bool), np.arange(len(sets)), []
    for h in np.flatnonzero(home).tolist():
        own = ids[ends[h] - size[h] : ends[h]]
        mark[own] = True
        common = np.bincount(owner[mark[ids]], minlength=len(sets))
        mark[own] = False
        near = np.flatnonzero(NEAR[1] * common >= NEAR[0] * (size + size[h] - common))
        others = np.unique(label[near])
        if len(others) > 1:
            first = {int(label[i]): int(i) for i in near[::-1]}
            edges += [(h, i) for lab, i in first.items() if lab != label[h]]
            label[np.isin(label, others)] = label[h]
    return edges


def _sets(batches):
    """(root, fp, cells, text) -> a row for each cell, with the set."""
    for b in batches:
        for at in range(0, b.num_rows, AT_ONCE):
            part = b.slice(at, AT_ONCE)
            rows = [(r["root"], c["cell"], r["fp"], c["home"], h) for r in part.to_pylist() for h in [shingle_set((r["text"] or "").encode()).tobytes()] for c in r["cells"]]
            for k in range(0, len(rows), AT_ONCE):
                root, cell, fp, home, h = zip(*rows[k : k + AT_ONCE])
                yield pa.RecordBatch.from_arrays([pa.array(root, pa.int64()), pa.array(cell, pa.int64()), pa.array(fp, pa.int64()), pa.array(home, pa.bool_()), pa.array(h, pa.binary())], names=["root", "cell", "fp", "home", "hashes"])


def _compare(batches):
    """Rows sorted by (root, cell): the links of each cell."""
    held, at = [], None

    def links():
        fp = np.array([f for f, _, _ in held])
        e = spanning([np.frombuffer(h, dtype="<u8") for _, _, h in held], np.array([x for _, x, _ in held])) if len(held) > 1 else []
        e = [(fp[i], fp[j]) for i, j in e if fp[i] != fp[j]]
        return [(min(x), max(x)) for x in e]

    def out(edges):
        a, b = zip(*edges)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        edges = []
        for root, cell, fp, home, h in zip(*[c.to_pylist() for c in batch.columns]):
            if (root, cell) != at:
                edges += links() if held else []
                held, at = [], (root, cell)
            held.append((fp, home, h))
        if edges:
            yield out(edges)
    if held and (edges := links()):
        yield out(edges)


def _cell(cell, home: bool):
    return F.struct(cell.cast("long").alias("cell"), F.lit(home).alias("home"))


def _whole(n):
    return F.sequence(F.lit(0), n - 1)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with h1 and h2, which name a row by doc_id and text."""
    return docs.withColumns({h: F.xxhash64(F.lit(k), docs["doc_id"], docs["text"]) for k, h in enumerate(_ROW)})


#: Columns that aren't a table's own.
_ROW = ("__stratagram_h1", "__stratagram_h2")
#: Bits of the map; a table of BITS / 64 rows of two numbers is broadcast at most.
BITS = 1 << 26


def _mapped(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
    """``rows`` whose h1 is in the bitmap of ``some`` (``how`` left_semi) or isn't (left_anti); a few others are in it by chance."""
    place = lambda h: F.pmod(h, F.lit(BITS))
    bit = lambda h: F.expr(f"shiftleft(1L, cast(pmod({h}, 64) as int))")
    words = some.groupBy(F.shiftright(place(F.col("h1")), 6).alias("__word")).agg(F.bit_or(bit("h1")).alias("__bits"))
    own = rows[_ROW[0]]
    return rows.join(F.broadcast(words), (F.shiftright(place(own), 6) == F.col("__word")) & (F.col("__bits").bitwiseAND(bit(f"`{_ROW[0]}`")) != 0), how)


def _dealt(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """The links within the cells of (h1, h2, fp, root, cells)."""
    texts = _mapped(_named(documents_only(docs, "doc_id", "text")), cells, "left_semi")
    # Repeated rows meet their like before they move.
    texts = texts.groupBy(*[F.col(h).alias(h[-2:]) for h in _ROW]).agg(F.first("text").alias("text"))
    rows = texts.join(cells, ["h1", "h2"]).select("root", "fp", "cells", "text")
    sets = rows.mapInArrow(_sets, "root long, cell long, fp long, home boolean, hashes binary")
    return sets.repartition("root", "cell").sortWithinPartitions("root", "cell").mapInArrow(_compare, "a long, b long")


def near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, h1, h2, fp, first), rows that agree in doc_id and text once: ``first`` is the (doc_id, h1, h2) of the component's first row, ``again`` says that the row occurs more than once; fp names the set."""
    folder = WorkFolder(docs.sparkSession, "jaccard")
    rows = _named(documents_only(docs, "doc_id", "text")).select("doc_id", *_ROW, "text")
    prints = folder.materialise(rows.mapInArrow(_prints, "doc_id long, h1 long, h2 long, fp long, bits long, keys binary"), "prints")
    bands = covered(prints, folder).unionByName(prints.select("fp", "keys").mapInArrow(_bands, "key long, fp long"))
    coarse = components(bands.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_stars, "a long, b long"), WorkFolder(docs.sparkSession, "coarse"))
    rows = folder.materialise(prints.groupBy("fp", "doc_id", "h1", "h2").agg((F.count("*") > 1).alias("again")), "rows")
    folder.remove("prints")
    one = folder.materialise(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("first")), "distinct")
    members = coarse.select(F.col("node").alias("fp"), "root").unionByName(coarse.select(F.col("root").alias("fp"), "root").distinct())
    sizes = members.groupBy("root").agg(F.count("*").alias("n")).select("root", "n", F.ceil(F.col("n") / hot).cast("int").alias("grid"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("grid")).cast("int")
    members = members.join(one.select("fp", "first.h1", "first.h2"), "fp").join(sizes, "root").withColumn("chunk", chunk)
    members = folder.materialise(members, "members")
    pivot = (F.col("grid") > 1) & (F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("n")) < PIVOTS)
    cells = F.when(pivot, F.transform(_whole(F.col("grid")), lambda c: _cell(c, True))).otherwise(F.array(_cell(F.col("chunk"), True)))
    found = folder.materialise(_dealt(docs, members.select("h1", "h2", "fp", "root", cells.alias("cells"))), "near")
    roots = components(found, WorkFolder(docs.sparkSession, "linked"))
    if members.where(F.col("grid") > 1).limit(1).count():
        found = found.unionByName(_dealt(docs, _apart(members, roots, hot)))
        roots = components(folder.materialise(found, "all"), folder)
    return folder.materialise(firsts(rows, one, roots), "found")


def _apart(members: DataFrame, roots: DataFrame, hot: int) -> DataFrame:
    """Cells that hold each set outside its group's largest part against the whole group."""
    crowd = members.where(F.col("grid") > 1).join(roots.select(F.col("node").alias("fp"), F.col("root").alias("part")), "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    parts = crowd.groupBy("root", "part").agg(F.count("*").alias("many"))
    core = parts.groupBy("root").agg(F.max(F.struct("many", "part")).alias("core"), F.sum("many").alias("all"))
    core = core.where(F.col("all") > F.col("core.many")).select("root", F.col("core.part").alias("core"), F.ceil((F.col("all") - F.col("core.many")) / hot).cast("int").alias("rest"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("rest")).cast("int")
    # Cell (i, j) holds chunk i of the sets apart and chunk j of all.
    as_home = F.transform(_whole(F.col("grid")), lambda j: _cell(own * F.col("grid") + j, True))
    as_visitor = F.transform(_whole(F.col("rest")), lambda i: _cell(i * F.col("grid") + F.col("chunk"), False))
    return crowd.join(core, "root").select("h1", "h2", "fp", "root", F.when(F.col("part") == F.col("core"), as_visitor).otherwise(F.concat(as_home, as_visitor)).alias("cells"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: SimHash's and the bands' candidates, checked by their sets; one document of each group stays, the one of the smallest doc_id."""
    found = near_copies(docs)
    first = (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    gone, again = found.where(~first), found.where(first & F.col("again"))
    named, odd = _named(docs), gone.unionByName(again).select("h1", "h2")
    plain = _mapped(named, odd, "left_anti")
    # Few rows: those that go, those that occur again, and what shares a bit with them by chance.
    others = _mapped(named, odd, "left_semi").dropDuplicates(list(_ROW))
    gone = gone.select(F.col("h1").alias(_ROW[0]), F.col("h2").alias(_ROW[1]))
    return plain.unionByName(others.join(gone, list(_ROW), "left_anti").select(*named.columns)).drop(*_ROW)
