import pytest

from regmesh.errors import EndogVarsAsCovarsError, FormulaSyntaxError, InstrumentsAsCovarsError, UnderDeterminedIVError
from regmesh.plans.formula import Formula, term_name


def parsed(text):
    return [(f.depvar, [term_name(t) for t in f.exogenous], f.fe_name) for f in Formula.parse(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Y ~ X1 + X2 | f1 + f2", [("Y", ["X1", "X2"], "f1+f2")]),
        ("Y ~ sw(X1, X2)", [("Y", ["X1"], "0"), ("Y", ["X2"], "0")]),
        ("Y ~ sw0(X1, X2)", [("Y", [], "0"), ("Y", ["X1"], "0"), ("Y", ["X2"], "0")]),
        ("Y ~ csw(X1, X2) | f1", [("Y", ["X1"], "f1"), ("Y", ["X1", "X2"], "f1")]),
        ("Y ~ X1 | csw0(f1, f2)", [("Y", ["X1"], "0"), ("Y", ["X1"], "f1"), ("Y", ["X1"], "f1+f2")]),
        ("Y ~ mvsw(X1, X2)", [("Y", [], "0"), ("Y", ["X1"], "0"), ("Y", ["X2"], "0"), ("Y", ["X1", "X2"], "0")]),
        ("Y + Y2 ~ X1", [("Y", ["X1"], "0"), ("Y2", ["X1"], "0")]),
        ("Y ~ X1 | f1^f2", [("Y", ["X1"], "f1:f2")]),
        ("Y ~ X1*X2", [("Y", ["X1", "X2", "X1:X2"], "0")]),
        ("log(Y) ~ I(X1 ** 2) + exp(X2)", [("log(Y)", ["I(X1 ** 2)", "exp(X2)"], "0")]),
    ],
)
def test_parse(text, want):
    assert parsed(text) == want


def test_iv_spellings():
    for text in ("Y ~ X2 | f1 | X1 ~ Z1", "Y ~ X2 + [X1 ~ Z1] | f1"):
        (f,) = Formula.parse(text)
        assert f.is_iv and [term_name(t) for t in f.endogenous] == ["X1"] and [term_name(t) for t in f.instruments] == ["Z1"] and f.fe_name == "f1"


@pytest.mark.parametrize(
    "text, error",
    [
        ("Y X1", FormulaSyntaxError), ("Y ~ X1 | f1 | f2 | f3", FormulaSyntaxError), ("Y ~ sw(X1)", FormulaSyntaxError), ("Y ~ (X1", FormulaSyntaxError), ("Y ~ [X1 + X2 ~ Z1 + Z2]", FormulaSyntaxError),
        ("Y ~ X1 + [X1 ~ Z1]", EndogVarsAsCovarsError), ("Y ~ Z1 + [X1 ~ Z1]", InstrumentsAsCovarsError), ("Y ~ [X1 ~ 1]", UnderDeterminedIVError),
    ],
)
def test_errors(text, error):
    with pytest.raises(error):
        Formula.parse(text)
