import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagram.plans.formula import FormulaError, parse

ACCEPT = ["y ~ x", "y ~ 0 + x", "y ~", "y ~ a*b", "y ~ a:b", "y ~ log(x) + I(x^2)", "y ~ poly(x, 2) + ns(x, 3)", "y ~ .", "y ~ (x | g)", "y ~ (x || g)", "y ~ (0 + x | g)", "y ~ (1 | a/b/c)", "y ~ (1 | a:b)", "y ~ offset(log(w))", "y ~ -1 + x", "y ~ I(-x^2 + (x - 1)/2)", "y ~ poly(x, 3, raw=TRUE)", "y ~ ns(x, 3, intercept=TRUE)"]
REJECT = ["", "y", "y ~ x ~ z", "y ~ (x", "y ~ x)", "y ~ x +", "y ~ a*b*c", "y ~ a:b:c", "y ~ foo(x)", "y ~ I(log(x))", "y ~ ns(x, knots=3)", "ÿ ~ x", "y ~ `a`", "y ~ a.b", "y ~ 1.5", "y ~ (1|a:b/c)", "y ~ offset(x)+offset(z)", "y ~ x - z", "y ~ 99999999999999999999", "y ~ I(x)", "y ~ 2", "1 ~ x", "y ~ ()", "y ~ (1|)", "y ~ + +", "y ~ poly(x, 0)", "y ~ poly(x, 33)", "y ~ (0 | g)", "log(y) ~ x"]


@pytest.mark.parametrize("text", ACCEPT)
def test_accepted(text):
    assert parse(text).response == "y"


@pytest.mark.parametrize("text", REJECT)
def test_rejected(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_expansions():
    assert [r.name for r in parse("y ~ (1 | a/b/c)").random] == ["a", "a:b", "a:b:c"]
    assert [t.label for t in parse("y ~ a*b + a").terms] == ["a", "b", "a:b"]
    assert not parse("y ~ x - 1").intercept
    r = parse("y ~ (x || g)").random[0]
    assert not r.correlated and r.effects == ["(Intercept)", "x"]
    assert parse("y ~ I(-x^2)").terms[0].atoms[0].args[0] == ("neg", ("^", ("name", "x"), ("num", 2)))


def test_many_terms():
    assert len(parse("y ~ " + " + ".join(f"x{k}" for k in range(1000))).terms) == 1000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="yxab01~+-*:()|/^,. logIpns=\n", max_size=40))
def test_total(text):
    try:
        parse(text)
    except FormulaError:
        pass
