"""Cross-products: the one pass over the data that a Gaussian model needs.

Everything a linear (mixed) model asks of its rows is a sum of products of
design columns, overall, by group and by pair of groups.  These sums are
column expressions in one or a few ``groupBy().agg()`` jobs with map-side
partial sums; what comes back is as large as the groups, not the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.design import Design, ModelError, factor_column, group_key, number

#: Groups (of one factor, or pairs of two) whose sums the driver holds.
MOST_GROUPS = 4_000_000
#: Up to so many design columns the sums of a table without groups are expressions; beyond it partial matrices.
MOST_EXPRESSIONS = 24


@dataclass
class Factor:
    """One grouping: all random terms that share it."""

    group: tuple
    effects: list
    blocks: list  # (first effect, number of effects) of each random term, by formula order
    labels: list = field(default_factory=list)
    s: np.ndarray | None = None  # (m, k, k): Z'WZ
    c: np.ndarray | None = None  # (m, k, p + 1): Z'W[X y]
    n: np.ndarray | None = None  # rows of each group


@dataclass
class Gram:
    names: list
    n: int
    t: np.ndarray  # (p + 1, p + 1): [X y]'W[X y]
    factors: list
    cross: dict  # (f, g) -> (index in f, index in g, (entries, kf, kg))
    layout: list  # of theta: (factor, first effect, number, names)

    @property
    def p(self) -> int:
        return len(self.names)

    def with_response(self, t_y: np.ndarray, c_y: list) -> "Gram":
        """The same design with other sums of the response."""
        t = self.t.copy()
        t[:, -1] = t_y
        t[-1, :] = t_y
        factors = []
        for f, y in zip(self.factors, c_y):
            c = f.c.copy()
            c[:, :, -1] = y
            factors.append(Factor(f.group, f.effects, f.blocks, f.labels, f.s, c, f.n))
        return Gram(self.names, self.n, t, factors, self.cross, self.layout)

    def combined(self, other: "Gram", sign: int) -> "Gram":
        """Sums of both tables, or (sign -1) of what is left of the first; groups by label."""
        factors, keep = [], []
        for f, g in zip(self.factors, other.factors):
            at = {v: i for i, v in enumerate(f.labels)}
            labels = list(f.labels) + [v for v in g.labels if v not in at]
            at = {v: i for i, v in enumerate(labels)}
            m = len(labels)
            s, c, n = np.zeros((m, *f.s.shape[1:])), np.zeros((m, *f.c.shape[1:])), np.zeros(m)
            s[: len(f.labels)], c[: len(f.labels)], n[: len(f.labels)] = f.s, f.c, f.n
            rows = np.array([at[v] for v in g.labels], dtype=int)
            np.add.at(s, rows, sign * g.s)
            np.add.at(c, rows, sign * g.c)
            np.add.at(n, rows, sign * g.n)
            ok = n > 0.5
            keep.append((at, ok, np.cumsum(ok) - 1))
            factors.append(Factor(f.group, f.effects, f.blocks, [v for v, o in zip(labels, ok) if o], s[ok], c[ok], n[ok]))
        cross = {}
        for (a, b), (i, j, z) in self.cross.items():
            ii = np.array([keep[a][0][self.factors[a].labels[x]] for x in i], dtype=int)
            jj = np.array([keep[b][0][self.factors[b].labels[x]] for x in j], dtype=int)
            oi, oj, oz = other.cross[(a, b)]
            xi = np.array([keep[a][0][other.factors[a].labels[x]] for x in oi], dtype=int)
            xj = np.array([keep[b][0][other.factors[b].labels[x]] for x in oj], dtype=int)
            ii, jj, z = np.concatenate([ii, xi]), np.concatenate([jj, xj]), np.concatenate([z, sign * oz])
            # A pair that both tables have is one entry, as the kernels need it.
            pairs, entry = np.unique(np.stack([ii, jj], axis=1), axis=0, return_inverse=True)
            total = np.zeros((len(pairs), *z.shape[1:]))
            np.add.at(total, entry.ravel(), z)
            ii, jj = pairs.T
            ok = keep[a][1][ii] & keep[b][1][jj]
            cross[(a, b)] = (keep[a][2][ii[ok]], keep[b][2][jj[ok]], total[ok])
        return Gram(self.names, self.n + sign * other.n, self.t + sign * other.t, factors, cross, self.layout)


def factors_of(design: Design) -> tuple[list[Factor], list]:
    """Groupings with their effects, and where each random term's theta belongs."""
    factors, layout = [], []
    for r in design.random:
        f = next((f for f in factors if f.group == r.group), None)
        if f is None:
            f = Factor(r.group, [], [])
            factors.append(f)
        blocks = [r.effects] if r.correlated else [[e] for e in r.effects]
        for effects in blocks:
            f.blocks.append((len(f.effects), len(effects)))
            layout.append((factors.index(f), len(f.effects), len(effects), effects))
            f.effects += effects
    return factors, layout


def _effect(name: str) -> tuple:
    return ("one",) if name == "(Intercept)" else ("name", name)


class Expressions:
    """Distinct design expressions of a model, numbered."""

    def __init__(self, design: Design, factors: list[Factor], response: Column | None = None):
        self.columns: list[Column] = []
        self.index: dict = {}
        self.x = [self._add(tuple(map(_frozen, c.factors)), c.column()) for c in design.columns]
        self.z = [[self._add((_effect(e),), factor_column(_effect(e))) for e in f.effects] for f in factors]
        y = response if response is not None else number(design.response)
        y = y - design.offset_column() - F.lit(design.shift) if design.offset else y - F.lit(design.shift)
        self.y = self._add("y", y)

    def _add(self, key, column: Column) -> int:
        if key not in self.index:
            self.index[key] = len(self.columns)
            self.columns.append(column)
        return self.index[key]


def _frozen(x):
    if isinstance(x, dict):
        return tuple(sorted((k, _frozen(v)) for k, v in x.items()))
    return tuple(_frozen(v) for v in x) if isinstance(x, (list, tuple)) else x


def design_rows(df: DataFrame, design: Design, factors: list[Factor], weights: str | None = None, response: Column | None = None, keep: tuple = ()) -> tuple[DataFrame, Expressions]:
    """Keys g0.., weight w and the distinct design expressions u0.. of each row: only the columns used are read."""
    e = Expressions(design, factors, response)
    w = F.lit(1.0) if weights is None else number(weights)
    if weights is not None:
        w = F.when((w > 0) & (w < F.lit(float("inf"))), w).otherwise(F.raise_error(F.lit(f"weights in {weights} must be positive and finite")).cast("double"))
    rows = df.select(*[group_key(f.group).alias(f"g{i}") for i, f in enumerate(factors)], w.alias("w"), *[c.alias(f"u{i}") for i, c in enumerate(e.columns)], *keep)
    return rows, e


def _product(i: int, j: int) -> Column:
    return F.sum(F.col("w") * F.col(f"u{min(i, j)}") * F.col(f"u{max(i, j)}")).alias(f"p{min(i, j)}_{max(i, j)}")


def _matrix(pdf, left: list[int], right: list[int]) -> np.ndarray:
    """(rows, left, right) of collected products."""
    return np.stack([np.stack([pdf[f"p{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in right], axis=-1) for i in left], axis=-2)


def _sums(rows: DataFrame, keys: list[str], pairs: set, most: int):
    agg = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[_product(i, j) for i, j in sorted(pairs)]) if keys else rows.agg(F.count("*").alias("rows"), *[_product(i, j) for i, j in sorted(pairs)])
    pdf = agg.limit(most + 1).toPandas() if keys else agg.toPandas()
    if len(pdf) > most:
        raise ModelError(f"more than {most} groups of {keys}; fit a single grouping factor with distributed_profile=True")
    return pdf.sort_values(keys, kind="stable", key=lambda s: s.map(lambda v: v.encode()) if s.dtype == object else s).reset_index(drop=True) if keys else pdf


def _pairs(left, right) -> set:
    return {(min(i, j), max(i, j)) for i in left for j in right}


def partial_products(rows: DataFrame, k: int) -> np.ndarray:
    """U'WU of a wide table by one matrix product a batch; a partial matrix a task, summed by row in Spark."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros((k, k))
        for b in batches:
            u = np.stack([b.column(f"u{i}").to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            total += (u * b.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), k), pa.int32()), pa.array(np.tile(np.arange(k), k), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    got = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((k, k))
    out[got["i"], got["j"]] = got["v"]
    return out


def build_gram(df: DataFrame, design: Design, weights: str | None = None, response: Column | None = None) -> Gram:
    factors, layout = factors_of(design)
    rows, e = design_rows(df, design, factors, weights, response)
    xy = e.x + [e.y]
    if len(factors) == 1:  # all sums by group in one job; the totals are their sums
        f = factors[0]
        pdf = _sums(rows, ["g0"], _pairs(xy, xy) | _pairs(e.z[0], xy) | _pairs(e.z[0], e.z[0]), MOST_GROUPS)
        f.labels, f.n = pdf["g0"].tolist(), pdf["rows"].to_numpy(float)
        f.s, f.c = _matrix(pdf, e.z[0], e.z[0]), _matrix(pdf, e.z[0], xy)
        t, n = _matrix(pdf, xy, xy).sum(axis=0), int(f.n.sum())
        return Gram(design.names, n, t, factors, {}, layout)
    if not factors and len(e.columns) > MOST_EXPRESSIONS:
        full = partial_products(rows, len(e.columns))
        return Gram(design.names, design.n, full[np.ix_(xy, xy)], [], {}, layout)
    if factors:
        rows = rows.persist()
    try:
        total = _sums(rows, [], _pairs(xy, xy), 1)
        t, n = _matrix(total, xy, xy)[0], int(total["rows"].iloc[0])
        for i, f in enumerate(factors):
            pdf = _sums(rows, [f"g{i}"], _pairs(e.z[i], xy) | _pairs(e.z[i], e.z[i]), MOST_GROUPS)
            f.labels, f.n = pdf[f"g{i}"].tolist(), pdf["rows"].to_numpy(float)
            f.s, f.c = _matrix(pdf, e.z[i], e.z[i]), _matrix(pdf, e.z[i], xy)
        cross = {}
        for a in range(len(factors)):
            for b in range(a + 1, len(factors)):
                pdf = _sums(rows, [f"g{a}", f"g{b}"], _pairs(e.z[a], e.z[b]), MOST_GROUPS)
                ia, ib = ({v: k for k, v in enumerate(factors[x].labels)} for x in (a, b))
                cross[(a, b)] = (pdf[f"g{a}"].map(ia).to_numpy(int), pdf[f"g{b}"].map(ib).to_numpy(int), _matrix(pdf, e.z[a], e.z[b]))
    finally:
        if factors:
            rows.unpersist()
    return Gram(design.names, n, t, factors, cross, layout)
