"""Model formulas: text to a small tree.

``y ~ x + a*b + log(z) + I(x^2) + poly(x, 2) + ns(x, 3) + offset(w) + (1 + x | g) + (1 | a/b)``

Names are ASCII letters, digits and underscores; numbers are integers; any
other text raises ``FormulaError`` and nothing else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

UNARY = ("log", "sqrt", "exp")
MOST_DEGREE = 32
_TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)|(\d+)|(\|\||[~+\-*/:^()|,=.]))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Atom:
    """One source of columns: name, call or arithmetic.

    kind: name | log | sqrt | exp | expr | poly | ns | dot; ``args`` by kind.
    """

    kind: str
    label: str
    args: tuple = ()

    def columns(self) -> set[str]:
        if self.kind == "expr":
            return names_in(self.args[0])
        return set() if self.kind == "dot" else {self.args[0]}


@dataclass(frozen=True)
class Term:
    """Atoms multiplied; one atom is a main effect."""

    atoms: tuple
    label: str


@dataclass(frozen=True)
class Random:
    """(effects | group columns); correlated or one variance per effect."""

    group: tuple
    intercept: bool
    slopes: tuple
    correlated: bool

    @property
    def name(self) -> str:
        return ":".join(self.group)

    @property
    def effects(self) -> list[str]:
        return ["(Intercept)"] * self.intercept + list(self.slopes)


@dataclass
class Formula:
    text: str
    response: str
    intercept: bool = True
    terms: list = field(default_factory=list)
    random: list = field(default_factory=list)
    offset: Atom | None = None


def names_in(tree) -> set[str]:
    if tree[0] == "name":
        return {tree[1]}
    return set().union(*[names_in(t) for t in tree[1:] if isinstance(t, tuple)]) if tree[0] != "num" else set()


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected character at {text[at:].strip()[:12]!r}")
        kind = "name" if m[1] else "num" if m[2] else "op"
        value = m[1] or m[2] or m[3]
        if kind == "num" and len(value) > 18:
            raise FormulaError(f"number too large: {value}")
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, k=0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value=None, kind=None):
        t = self.peek()
        if value is not None and t[1] != value or kind is not None and t[0] != kind:
            raise FormulaError(f"expected {value or kind}, found {t[1] or 'the end'!r}")
        self.at += 1
        return t[1]

    # ----------------------------------------------------------- arithmetic

    def sum(self):
        left = self.product()
        while self.peek()[1] in ("+", "-"):
            left = (self.take(), left, self.product())
        return left

    def product(self):
        left = self.minus()
        while self.peek()[1] in ("*", "/"):
            left = (self.take(), left, self.minus())
        return left

    def minus(self):
        """A minus sign binds less than a power: -x^2 is -(x^2)."""
        if self.peek()[1] == "-":
            self.take()
            return ("neg", self.minus())
        return self.power()

    def power(self):
        base = self.value()
        if self.peek()[1] == "^":
            self.take()
            return ("^", base, self.minus())
        return base

    def value(self):
        kind, value = self.peek()
        if value == "(":
            self.take()
            inner = self.sum()
            self.take(")")
            return inner
        if kind == "num":
            return ("num", int(self.take()))
        if kind == "name":
            if self.peek(1)[1] == "(":
                raise FormulaError(f"a call inside I(): {value}")
            return ("name", self.take())
        raise FormulaError(f"unexpected {value or 'end'!r} in an expression")

    # ---------------------------------------------------------------- terms

    def integer(self):
        return int(self.take(kind="num"))

    def atom(self) -> Atom:
        kind, value = self.peek()
        if value == ".":
            self.take()
            return Atom("dot", ".")
        name = self.take(kind="name")
        if self.peek()[1] != "(":
            if self.peek()[1] == ".":
                raise FormulaError("names have no dots")
            return Atom("name", name, (name,))
        self.take("(")
        if name in UNARY:
            column = self.take(kind="name")
            self.take(")")
            return Atom(name, f"{name}({column})", (column,))
        if name == "I":
            at = self.at
            tree = self.sum()
            if tree[0] == "name":
                raise FormulaError("I() around a bare column")
            text = "".join(t[1] for t in self.tokens[at : self.at])
            self.take(")")
            return Atom("expr", f"I({text})", (tree,))
        if name in ("poly", "ns"):
            column = self.take(kind="name")
            self.take(",")
            n, flag = self.integer(), False
            if not 1 <= n <= MOST_DEGREE:
                raise FormulaError(f"{name}: degree {n} is out of 1..{MOST_DEGREE}")
            if self.peek()[1] == ",":
                self.take()
                key = self.take(kind="name")
                self.take("=")
                truth = self.take(kind="name")
                if key != {"poly": "raw", "ns": "intercept"}[name] or truth not in ("TRUE", "FALSE", "T", "F"):
                    raise FormulaError(f"{name}: unknown option {key}")
                flag = truth in ("TRUE", "T")
            self.take(")")
            option = f", {'raw' if name == 'poly' else 'intercept'}=TRUE" if flag else ""
            return Atom(name, f"{name}({column}, {n}{option})", (column, n, flag))
        raise FormulaError(f"unknown function {name}")

    def group(self) -> list[tuple]:
        names, seps = [self.take(kind="name")], set()
        while self.peek()[1] in ("/", ":"):
            seps.add(self.take())
            names.append(self.take(kind="name"))
        if len(seps) > 1:
            raise FormulaError("':' and '/' mixed in a group")
        return [tuple(names[: k + 1]) for k in range(len(names))] if "/" in seps else [tuple(names)]

    def random(self) -> list[Random]:
        self.take("(")
        intercept, slopes, sign = True, [], "+"
        while True:
            kind, value = self.peek()
            if kind == "num":
                n = self.integer()
                if n not in (0, 1):
                    raise FormulaError(f"{n} is no random effect")
                if n == 0 and sign == "-":
                    raise FormulaError("- 0")
                intercept = n == 1 and sign == "+"
            elif kind == "name" and sign == "+":
                name = self.take()
                if name not in slopes:
                    slopes.append(name)
            else:
                raise FormulaError(f"unexpected {value or 'end'!r} in a random effect")
            if self.peek()[1] not in ("+", "-"):
                break
            sign = self.take()
        bar = self.take()
        if bar not in ("|", "||"):
            raise FormulaError(f"expected | in a random effect, found {bar!r}")
        groups = self.group()
        self.take(")")
        if not intercept and not slopes:
            raise FormulaError("a random term without effects")
        return [Random(g, intercept, tuple(slopes), bar == "|") for g in groups]


def parse(text: str) -> Formula:
    tokens = tokenize(text)
    if sum(t[1] == "~" for t in tokens) != 1:
        raise FormulaError("a formula has exactly one ~")
    p = _Parser(tokens)
    out = Formula(text.strip(), p.take(kind="name"))
    p.take("~")
    seen: set[str] = set()

    def add(term: Term):
        if term.label not in seen:
            seen.add(term.label)
            out.terms.append(term)

    sign = "+"
    if p.peek()[1] == "-":
        sign = p.take()
    elif p.peek()[0] == "end":
        return out
    while True:
        kind, value = p.peek()
        if kind == "num":
            n = p.integer()
            if n == 1:
                out.intercept = sign == "+"
            elif n == 0 and sign == "+":
                out.intercept = False
            else:
                raise FormulaError(f"{sign}{n} is no term")
        elif sign == "-":
            raise FormulaError("only the intercept can be taken out")
        elif value == "(":
            out.random += p.random()
        elif value == "offset" and p.peek(1)[1] == "(":
            p.take()
            p.take("(")
            atom = p.atom()
            p.take(")")
            if atom.kind not in ("name", *UNARY) or out.offset is not None:
                raise FormulaError("one offset, of a column or its log, sqrt or exp")
            out.offset = atom
        else:
            left = p.atom()
            if p.peek()[1] in ("*", ":"):
                op = p.take()
                right = p.atom()
                if p.peek()[1] in ("*", ":"):
                    raise FormulaError("interactions are between two columns")
                for a in (left, right):
                    if a.kind in ("poly", "ns", "dot"):
                        raise FormulaError(f"{a.label} in an interaction")
                if op == "*":
                    add(Term((left,), left.label))
                    add(Term((right,), right.label))
                add(Term((left, right), f"{left.label}:{right.label}"))
            else:
                add(Term((left,), left.label))
        if p.peek()[0] == "end":
            return out
        if p.peek()[1] not in ("+", "-"):
            raise FormulaError(f"unexpected {p.peek()[1]!r}")
        sign = p.take()
