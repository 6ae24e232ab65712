"""Bounded-space online best-fit packing of token pieces into sequences.

Each task keeps a fixed number of open bins in a bitset keyed by free space.
Pieces are placed as they arrive.  A piece goes to the bin with the least free
space that holds it.  If none does and all bins are open, the fullest closes
first.  What is open when a task ends goes through a second, far smaller round
of the same kind, whose open bins close as they are.  Sequences never share
pieces between tasks, so any number of tasks may run.

Documents longer than a sequence, and only those, are cut.  Null text counts
as empty (the end id alone); null doc_id and repeated rows are packed like
others.  Very long texts are encoded whole, one at a time.  Bins of equal free
space are filled last opened first.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WorkFolder, documents_only, give_back, table
from .encoding import encoder

CAPACITY = 2048
END_ID = 0
#: Twice as many save under a thousandth of the sequences.
OPEN_BINS = 128
#: Pieces that a task of the second round gets.
PIECES_A_TASK = 50_000
#: Documents that are encoded, and rows that are handed on, at once.
AT_ONCE = 128
ROWS_AT_ONCE = 500

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_IDS = ", ids array<int>"
_PLACES = ("sequence_id", "offset", "closed")
_PLACED = "sequence_id long, offset long, closed boolean"


class BestFit:
    """Open bins by free space; ``add`` yields the bins that close."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        #: Bins that closed with room left, since another had to be opened.
        self.forced = 0
        self.mask, self.count = 0, 0
        self.bins: dict[int, list[list]] = {}

    def _take(self, free: int) -> list:
        stack = self.bins[free]
        bin_ = stack.pop()
        if not stack:
            del self.bins[free]
            self.mask ^= 1 << free
        self.count -= 1
        return bin_

    def add(self, length: int, item) -> list[list]:
        closed = []
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.open_bins:
                self.forced += 1
                closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
            free, bin_ = self.capacity, []
        bin_.append((self.capacity - free, length, item))
        free -= length
        if free:
            self.bins.setdefault(free, []).append(bin_)
            self.mask |= 1 << free
            self.count += 1
        else:
            closed.append(bin_)
        return closed

    def rest(self) -> list[list]:
        """The bins still open, the fullest first."""
        out = [b for free in sorted(self.bins) for b in self.bins[free]]
        self.mask, self.count, self.bins = 0, 0, {}
        return out


def _cut(path, end_id, capacity, with_ids):
    end = np.array([end_id], dtype="<u4").tobytes()
    width = capacity * 4

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                rows = batch.slice(i, AT_ONCE)
                for doc_id, raw in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1).to_pylist())):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), width)):
                        cut = raw[at : at + width]
                        row = (doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut))
                        yield (*row, np.frombuffer(cut, dtype="<i4")) if with_ids else row

    return run


def _column(values, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), kind.value_type))


def _cells(column: pa.Array) -> list:
    """The column's values; lists, which have no nulls, as arrays of their own."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, at = column.values.to_numpy(), column.offsets.to_numpy().tolist()
    return [values[i:j].copy() for i, j in zip(at, at[1:])]


def _rows(batches):
    for batch in batches:
        yield from zip(*[_cells(c) for c in batch.columns])


def _place(source, fields, capacity, open_bins, round_, last):
    """The rows that ``source`` makes of batches, with their places; ``last``: nothing stays open."""
    names, kinds = [f[0] for f in fields], [f[1] for f in fields]
    at = names.index("length")

    def run(batches):
        from pyspark import TaskContext

        serial = (round_ << 58) + (TaskContext.get().partitionId() << 34)
        packer, out = BestFit(capacity, open_bins), []
        give_back()

        def close(bins, closed=True):
            nonlocal serial
            for bin_ in bins:
                out.extend((*row, serial, offset, closed) for offset, _, row in bin_)
                serial += 1

        def emit():
            arrays = [_column(c, t) for c, t in zip(zip(*out), [*kinds, pa.int64(), pa.int64(), pa.bool_()])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *_PLACES])

        for row in source(batches):
            close(packer.add(row[at], row))
            if len(out) >= ROWS_AT_ONCE:
                yield emit()
        close(packer.rest(), last)
        if out:
            yield emit()

    return run


def _packed(rows: DataFrame, source, pieces: str, fields: list, folder: WorkFolder, capacity: int, open_bins: int) -> DataFrame:
    schema = f"{pieces}, {_PLACED}"
    first = folder.materialise(rows.mapInArrow(_place(source, fields, capacity, open_bins, 0, False), schema), "first")
    remains = first.where(~F.col("closed")).drop("offset", "closed")
    tasks = max(1, math.ceil(remains.count() / PIECES_A_TASK))
    fewer = remains.repartition(tasks, F.xxhash64("sequence_id")).drop("sequence_id")
    second = folder.materialise(fewer.mapInArrow(_place(_rows, fields, capacity, open_bins, 1, True), schema), "second")
    return first.where("closed").unionByName(second).drop("closed")


def _fields(schema) -> tuple[str, list]:
    """The schema as Spark text, and (name, Arrow type) of each column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]


def pack_pieces(pieces: DataFrame, folder: WorkFolder, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (with a length of at most ``capacity``) with sequence_id and offset; columns of those names, and closed, are replaced."""
    pieces = pieces.drop(*_PLACES)
    return _packed(pieces, _rows, *_fields(pieces.schema), folder, capacity, open_bins)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.  Texts are encoded, cut and placed in one pass."""
    from pyspark.sql.types import StructType

    pieces = _fields(StructType.fromDDL(_PIECES + _IDS * with_ids))
    rows = documents_only(docs, "doc_id", "text")
    return _packed(rows, _cut(vocabulary, end_id, capacity, with_ids), *pieces, WorkFolder(docs.sparkSession, "packing"), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a group holds at most one sequence's ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: what is left as sequences of token ids, a row per piece.

    Null and empty texts are an end id, repeated rows are all packed, an empty table gives no pieces.
    """
    return pack_documents(docs, with_ids=True)
