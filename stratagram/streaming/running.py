"""Streams: scoring, and models that follow their data.

Scores are row expressions and a join with a small table, so a fitted model
scores a stream as it scores a table.  Cross-products of disjoint batches add
up, so a model of all rows so far needs only the sums so far.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gram import Gram, build_gram, factors_of
from ..operators.kernels import lmm
from ..operators.linear import _assemble
from ..operators.model import FittedModel
from ..plans.design import Design


def score_stream(model: FittedModel, stream: DataFrame, conditional: bool = True, allow_new_levels: bool = True, name: str = "prediction") -> DataFrame:
    """``stream`` with a prediction; groups that the model doesn't know add nothing."""
    if conditional and model.factors:
        return model.predict_conditional_response(stream, allow_new_levels, name)
    return model.predict_response(stream, name)


#: Bytes of a row of stored sums.
PART = 1 << 26
_STORED = "epoch long, parts int, at int, bytes binary, slot int"


class RunningModel:
    """The sums of all batches so far; a batch that comes again is added once.

    The design (levels, encodings) is fixed beforehand, as streams need it.
    With a ``path`` that the cluster shares, the sums are stored after each
    batch, before the stream's own checkpoint moves on, and taken up again by
    a model of the same path.  One path belongs to one stream's checkpoint.
    The last two states are kept, in turn, so one is whole at any time.
    """

    def __init__(self, design: Design, reml: bool = True, weights: str | None = None, path: str | None = None):
        self.design, self.reml, self.weights, self.path = design, reml, weights, path
        self.gram: Gram | None = None
        self.last, self.slot = -1, 0
        if path is not None:
            self._restore(SparkSession.active())

    def update(self, batch: DataFrame, epoch: int) -> None:
        """For ``writeStream.foreachBatch``."""
        if epoch <= self.last or batch.isEmpty():
            self.last = max(self.last, epoch)
            return
        new = build_gram(batch, self.design, self.weights)
        total = new if self.gram is None else self.gram.combined(new, 1)
        if self.path is not None:
            self._store(total, epoch, batch.sparkSession)
        self.gram, self.last = total, epoch

    def _store(self, gram: Gram, epoch: int, spark: SparkSession) -> None:
        arrays = {"n": np.array(gram.n), "t": gram.t}
        for k, f in enumerate(gram.factors):
            labels = "".join(f.labels).encode()
            arrays |= {f"labels{k}": np.frombuffer(labels, np.uint8), f"ends{k}": np.cumsum([len(v.encode()) for v in f.labels]), f"s{k}": f.s, f"c{k}": f.c, f"n{k}": f.n}
        for (a, b), parts in gram.cross.items():
            arrays |= {f"cross{a}_{b}_{i}": np.asarray(v) for i, v in enumerate(parts)}
        np.savez(out := io.BytesIO(), **arrays)
        raw = out.getvalue()
        rows = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        n = len(rows)
        table = pa.table({"epoch": pa.repeat(epoch, n), "parts": pa.array([n] * n, pa.int32()), "at": pa.array(range(n), pa.int32()), "bytes": pa.array(rows, pa.binary())})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{self.path}/slot={self.slot}")
        self.slot = 1 - self.slot

    def _restore(self, spark: SparkSession) -> None:
        try:
            stored = spark.read.schema(_STORED).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        whole = stored.groupBy("epoch", "slot", "parts").agg(F.count("*").alias("n")).where(F.col("n") == F.col("parts"))
        latest = whole.orderBy(F.desc("epoch")).first()
        if latest is None:
            return
        rows = stored.where((F.col("slot") == latest["slot"]) & (F.col("epoch") == latest["epoch"])).orderBy("at").select("bytes").collect()
        got = np.load(io.BytesIO(b"".join(r["bytes"] for r in rows)), allow_pickle=False)
        factors, layout = factors_of(self.design)
        for k, f in enumerate(factors):
            raw, ends = got[f"labels{k}"].tobytes(), got[f"ends{k}"].tolist()
            f.labels = [raw[i:j].decode() for i, j in zip([0, *ends], ends)]
            f.s, f.c, f.n = got[f"s{k}"], got[f"c{k}"], got[f"n{k}"]
        pairs = {tuple(map(int, name[5:].split("_")[:2])) for name in got.files if name.startswith("cross")}
        cross = {(a, b): tuple(got[f"cross{a}_{b}_{i}"] for i in range(3)) for a, b in pairs}
        self.gram = Gram(self.design.names, int(got["n"]), got["t"], factors, cross, layout)
        self.last, self.slot = latest["epoch"], 1 - latest["slot"]

    def fit(self) -> FittedModel:
        if self.gram is None:
            raise ValueError("no rows so far")
        kind = "lmer" if self.design.random else "lm"
        fit, count, ok = lmm.fit(self.gram, self.reml and kind == "lmer")
        return _assemble(self.design, self.gram, fit, kind, count, ok, None, self.weights)
