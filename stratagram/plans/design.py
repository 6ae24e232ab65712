"""From a formula and a schema to named column expressions.

``analyze`` resolves names, expands ``.`` and learns what the encodings need
(levels, moments, knots, the response's mean) in one aggregate job, plus one
per ``ns`` term.  The result is a ``Design``: an ordered list of (name, term,
specification) whose specifications are plain data, so that a stored model
rebuilds the same columns on other tables.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .formula import UNARY, Atom, Formula, FormulaError, Random, Term, parse

#: Levels of one categorical column; more belong in a random effect.
MOST_LEVELS = 10_000


class ModelError(ValueError):
    pass


# ------------------------------------------------------------- specifications
# ("one",) | ("name", column) | ("log"|"sqrt"|"exp", column) | ("expr", tree)
# ("dummy", column, level) | ("power", column, k) | ("poly", column, k, coefficients)
# ("ns", column, j, knots, projection) ; a design column is a product of these.


def _levels(df: DataFrame, column: str) -> list[str]:
    """The levels of a factor in order of their bytes; at most MOST_LEVELS and one come back, however many there are."""
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.raise_error(F.lit(f"null in column {column}")).cast("string"))
    found = [r[0] for r in df.select(text.alias("level")).distinct().limit(MOST_LEVELS + 1).collect()]
    if len(found) > MOST_LEVELS:
        raise ModelError(f"{column} has over {MOST_LEVELS} levels; use a random effect")
    return sorted(found, key=lambda s: s.encode())


def number(column: str) -> Column:
    """A numeric value; null is an error, as is text that is no number."""
    return F.coalesce(F.col(f"`{column}`").cast("double"), F.raise_error(F.lit(f"null or no number in column {column}")).cast("double"))


def _checked(ok: Column, value: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(what)).cast("double"))


def _arithmetic(t) -> Column:
    op = t[0]
    if op == "num":
        return F.lit(float(t[1]))
    if op == "name":
        return number(t[1])
    if op == "neg":
        return -_arithmetic(t[1])
    a, b = _arithmetic(t[1]), _arithmetic(t[2])
    if op == "/":
        return _checked(b != 0, a / F.nullif(b, F.lit(0.0)), "division by zero in I()")
    if op == "^":
        v = F.pow(a, b)
        return _checked(~F.isnan(v) & (F.abs(v) < F.lit(math.inf)), v, "a power that isn't finite in I()")
    return a + b if op == "+" else a - b if op == "-" else a * b


def _natural(column: str, j: int, knots, projection) -> Column:
    """Column j of a natural spline: cubic B-splines projected on zero curvature at the ends."""
    x = number(column)
    basis = [_truncated(x, k, knots) for k in range(len(knots))]
    return sum((b * float(projection[i][j]) for i, b in enumerate(basis)), F.lit(0.0))


def _truncated(x: Column, k: int, knots) -> Column:
    """The natural cubic basis by truncated powers: 1, x, then one function per inner knot."""
    lo, hi = knots[0], knots[-1]
    u = (x - lo) / (hi - lo)
    if k == 0:
        return F.lit(1.0)
    if k == 1:
        return u
    at = lambda t: F.pow(F.greatest(u - (t - lo) / (hi - lo), F.lit(0.0)), F.lit(3.0))
    d = lambda t: (at(t) - at(hi)) / ((hi - t) / (hi - lo))
    return d(knots[k - 2]) - d(knots[-2])


def factor_column(f) -> Column:
    kind = f[0]
    if kind == "one":
        return F.lit(1.0)
    if kind == "name":
        return number(f[1])
    if kind == "log":
        x = number(f[1])
        return _checked(x > 0, F.log(x), f"log of a value that isn't positive in {f[1]}")
    if kind == "sqrt":
        x = number(f[1])
        return _checked(x >= 0, F.sqrt(x), f"sqrt of a negative value in {f[1]}")
    if kind == "exp":
        v = F.exp(number(f[1]))
        return _checked(v < F.lit(math.inf), v, f"exp isn't finite in {f[1]}")
    if kind == "expr":
        return _arithmetic(f[1])
    if kind == "dummy":
        text = F.col(f"`{f[1]}`").cast("string")
        known = F.coalesce(text, F.raise_error(F.lit(f"null in column {f[1]}")).cast("string"))
        return F.when(known == F.lit(f[2]), 1.0).otherwise(0.0)
    if kind == "power":
        x = number(f[1])
        out = x
        for _ in range(f[2] - 1):
            out = out * x
        return out
    if kind == "poly":
        x, centre = number(f[1]) - float(f[3]["mean"]), f[3]["rows"][f[2] - 1]
        out = F.lit(0.0)
        for c in reversed(centre):
            out = out * x + float(c)
        return out
    if kind == "ns":
        return _natural(f[1], f[2], f[3], f[4])
    raise ModelError(f"unknown factor {kind}")


@dataclass
class DesignColumn:
    name: str
    term: str
    factors: list

    def column(self) -> Column:
        out = factor_column(self.factors[0])
        for f in self.factors[1:]:
            out = out * factor_column(f)
        return out


@dataclass
class Design:
    formula: str
    response: str
    columns: list
    random: list
    offset: list | None
    intercept: bool
    levels: dict = field(default_factory=dict)
    shift: float = 0.0
    n: int = 0

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def terms(self) -> list[str]:
        return [c.term for c in self.columns]

    def offset_column(self) -> Column:
        return factor_column(self.offset) if self.offset else F.lit(0.0)

    def to_dict(self) -> dict:
        return asdict(self) | {"random": [asdict(r) for r in self.random]}

    @classmethod
    def from_dict(cls, d: dict) -> "Design":
        d = dict(d)
        d["columns"] = [DesignColumn(c["name"], c["term"], [_tuples(f) for f in c["factors"]]) for c in d["columns"]]
        d["random"] = [Random(tuple(r["group"]), r["intercept"], tuple(r["slopes"]), r["correlated"]) for r in d["random"]]
        d["offset"] = _tuples(d["offset"]) if d["offset"] else None
        return cls(**d)


def _tuples(x):
    return tuple(_tuples(v) for v in x) if isinstance(x, list) else x


def group_key(group: tuple) -> Column:
    """The label of a group: its columns joined by ':'; null is an error."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.raise_error(F.lit(f"null in group column {c}")).cast("string")) for c in group]
    return parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)


def is_category(df: DataFrame, column: str) -> bool:
    if column not in df.columns:
        raise ModelError(f"no column {column}; the table has {df.columns}")
    kind = df.schema[column].dataType
    if isinstance(kind, (T.StringType, T.BooleanType, T.CharType, T.VarcharType)):
        return True
    if isinstance(kind, T.NumericType):
        return False
    raise ModelError(f"column {column} is of type {kind.simpleString()}; numbers, text and booleans can be modelled")


def _expand_dot(f: Formula, df: DataFrame) -> list:
    named = {f.response} | {c for r in f.random for c in (*r.group, *r.slopes)} | (f.offset.columns() if f.offset else set())
    for t in f.terms:
        for a in t.atoms:
            named |= a.columns()
    out = []
    for t in f.terms:
        if t.atoms[0].kind == "dot":
            out += [Term((Atom("name", c, (c,)),), c) for c in df.columns if c not in named]
        else:
            out.append(t)
    return out


def analyze(df: DataFrame, formula: str | Formula, response_as: Column | None = None) -> Design:
    f = parse(formula) if isinstance(formula, str) else formula
    ship(df.sparkSession)
    terms = _expand_dot(f, df)
    atoms = {a.label: a for t in terms for a in t.atoms}
    for c in {c for a in atoms.values() for c in a.columns()} | {f.response} | {c for r in f.random for c in (*r.group, *r.slopes)} | (f.offset.columns() if f.offset else set()):
        if c not in df.columns:
            raise ModelError(f"no column {c}; the table has {df.columns}")
    categories = {a.args[0] for a in atoms.values() if a.kind == "name" and is_category(df, a.args[0])}
    for a in atoms.values():
        if a.kind != "name":
            for c in a.columns():
                if is_category(df, c):
                    raise ModelError(f"{a.label}: {c} is categorical")
    for r in f.random:
        for c in r.slopes:
            if is_category(df, c):
                raise ModelError(f"random slope {c} is categorical")
    offset = _factor(f.offset) if f.offset else None
    y = (response_as if response_as is not None else number(f.response)) - (factor_column(offset) if offset else F.lit(0.0))
    polys = [a for a in atoms.values() if a.kind == "poly" and not a.args[2]]
    wanted = [F.count("*").alias("n"), F.avg(y).alias("mean_y")]
    wanted += [F.avg(number(a.args[0])).alias(f"mean_{k}") for k, a in enumerate(polys)]
    got = df.agg(*wanted).first()
    if not got["n"]:
        raise ModelError("the table has no rows")
    levels = {c: _levels(df, c) for c in sorted(categories)}
    encodings = {a.label: _orthogonal(df, a, got[f"mean_{k}"]) for k, a in enumerate(polys)}
    encodings |= {a.label: _spline(df, a) for a in atoms.values() if a.kind == "ns"}
    columns, handled = [], f.intercept
    if f.intercept:
        columns.append(DesignColumn("(Intercept)", "(Intercept)", [("one",)]))
    singles = {t.atoms[0].label for t in terms if len(t.atoms) == 1}
    for t in terms:
        if len(t.atoms) == 1:
            made, handled = _encode(t.atoms[0], levels, encodings, handled)
            columns += [DesignColumn(n, t.label, [s]) for n, s in made]
            continue
        a, b = t.atoms
        sides = [_coded(x, other, singles, levels) for x, other in ((a, b), (b, a))]
        made = [DesignColumn(f"{na}:{nb}", t.label, [sa, sb]) for na, sa in sides[0] for nb, sb in sides[1]]
        if f.intercept and a.label not in singles and b.label not in singles and all(s[0][1][0] == "dummy" for s in sides):
            made = made[1:]  # the reference cell is the intercept
        columns += made
    design = Design(f.text, f.response, columns, f.random, offset, f.intercept, levels, 0.0, got["n"])
    design.shift = float(got["mean_y"]) if f.intercept else 0.0
    return design


def _factor(a: Atom) -> tuple:
    return ("name", a.args[0]) if a.kind == "name" else (a.kind, a.args[0]) if a.kind in UNARY else ("expr", a.args[0])


def _dummies(column: str, levels: list[str]) -> list:
    return [(f"{column}{v}", ("dummy", column, v)) for v in levels]


def _encode(a: Atom, levels: dict, encodings: dict, handled: bool):
    """(name, specification) of a main effect; whether an intercept is there now."""
    if a.kind == "name" and a.args[0] in levels:
        found = levels[a.args[0]]
        return _dummies(a.args[0], found[1:] if handled and len(found) > 1 else found), True
    if a.kind == "poly":
        c, d, raw = a.args
        return [(f"{a.label}{k}", ("power", c, k) if raw else ("poly", c, k, encodings[a.label])) for k in range(1, d + 1)], handled
    if a.kind == "ns":
        knots, projection = encodings[a.label]
        return [(f"{a.label}{j + 1}", ("ns", a.args[0], j, knots, projection)) for j in range(a.args[1])], handled
    return [(a.label, _factor(a))], handled


def _coded(a: Atom, other: Atom, singles: set, levels: dict) -> list:
    """A side of an interaction: contrasts if the other side stands alone, else all levels."""
    if a.kind == "name" and a.args[0] in levels:
        found = levels[a.args[0]]
        return _dummies(a.args[0], found[1:] if other.label in singles and len(found) > 1 else found)
    return [(a.label, _factor(a))]


def _orthogonal(df: DataFrame, a: Atom, mean: float) -> dict:
    """Coefficients of orthonormal polynomials, positive leading: Cholesky of the centred moments."""
    c, d, _ = a.args
    x = number(c) - F.lit(mean)
    sums = df.agg(*[F.sum(F.pow(x, F.lit(float(k)))).alias(f"m{k}") for k in range(2 * d + 1)], F.approx_count_distinct(x).alias("u")).first()
    moments = np.array([[sums[f"m{i + j}"] for j in range(d + 1)] for i in range(d + 1)])
    scale = np.sqrt(np.diag(moments))
    try:
        lower = np.linalg.cholesky(moments / np.outer(scale, scale))
    except np.linalg.LinAlgError:
        raise ModelError(f"{a.label}: fewer distinct values than the degree needs") from None
    if sums["u"] <= d and sums["u"] < 64:
        raise ModelError(f"{a.label}: fewer distinct values than the degree needs")
    # Rows of inverse(lower) turn 1, x, x^2, ... into orthonormal columns.
    rows = np.linalg.inv(lower) / scale
    return {"mean": float(mean), "rows": [row[: k + 1].tolist() for k, row in enumerate(rows)][1:]}


def _spline(df: DataFrame, a: Atom):
    """Knots at type-7 quantiles of the distinct values; ``df`` columns."""
    c, n, with_intercept = a.args
    inner = n - 1 - with_intercept
    shares = [(k + 1) / (inner + 1) for k in range(inner)] if inner > 0 else []
    got = df.select(number(c).alias("x")).distinct().agg(F.percentile("x", F.array(*[F.lit(p) for p in [0.0, *shares, 1.0]])).alias("q")).first()
    knots = [float(v) for v in got["q"]]
    if len(set(knots)) < len(knots):
        raise ModelError(f"{a.label}: not enough distinct values for the knots")
    k = len(knots)
    projection = np.eye(k)[:, (0 if with_intercept else 1) :]
    if projection.shape[1] < n:
        raise ModelError(f"{a.label}: not enough knots")
    return knots, projection[:, :n].tolist()


__all__ = ["Design", "DesignColumn", "FormulaError", "ModelError", "analyze", "factor_column", "group_key", "number"]
