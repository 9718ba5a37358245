"""From a formula and a DataFrame to a design: one projection and one filter.

A design is a lazy DataFrame with the dependent column, the covariates, the
endogenous column and instruments, weights and offset as doubles, and the fixed
effects in their own types, next to the user's columns. What the projection needs
from the data (factor levels, moments of polynomials) is gathered by one small
aggregate each and kept, so that new data get the same columns.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DepvarIsNotNumericError, EmptySampleError, FormulaSyntaxError, NonPositiveWeightsError
from .formula import Formula, Node, term_name

NUMERIC = (T.NumericType, T.BooleanType)
MAX_LEVELS = 10_000  # of a factor among the covariates; more belong into a fixed effect


@dataclass
class DesignCol:
    name: str
    column: Column


@dataclass
class DesignState:
    """What a design has learned from its data."""

    levels: dict[str, list] = field(default_factory=dict)
    moments: dict[str, tuple] = field(default_factory=dict)


def missing(c: Column, kind: T.DataType) -> Column:
    out = c.isNull()
    return out | F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) else out


def level_label(v: Any) -> str:
    return repr(v) if isinstance(v, float) else str(v)


class Builder:
    """Turns formula trees into Spark columns over one DataFrame."""

    def __init__(self, data: DataFrame, state: DesignState, context: dict[str, Callable] | None = None, fitted: bool = False):
        self.data, self.state, self.context, self.fitted = data, state, context or {}, fitted
        self.types = {f.name: f.dataType for f in data.schema.fields}

    def col(self, name: str) -> Column:
        if name not in self.types:
            raise FormulaSyntaxError(f"no column {name!r} in the data")
        return F.col(f"`{name}`")

    def is_factor(self, node: Node) -> bool:
        if node.kind == "call":
            return node.value in ("C", "i")
        return node.kind == "name" and not isinstance(self.types.get(node.value), T.NumericType)

    # scalar expressions
    def scalar(self, n: Node) -> Column:
        if n.kind == "number":
            return F.lit(float(n.value))
        if n.kind == "name":
            return self.col(n.value).cast("double")
        if n.kind == "op":
            if len(n.args) == 1:
                return -self.scalar(n.args[0])
            a, b = (self.scalar(x) for x in n.args)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b), "**": lambda: F.pow(a, b)}[n.value]()
        if n.kind == "call":
            if n.value in self.context:
                return self.context[n.value](*[self.scalar(a) for a in n.args]).cast("double")
            if n.value == "I":
                return self.scalar(n.args[0])
            one = self.scalar(n.args[0])
            if n.value in ("log", "log2", "log10"):  # non-positive values are missing
                base = {"log": F.ln, "log2": F.log2, "log10": F.log10}[n.value]
                return F.when((one > 0) & ~F.isnan(one), base(one))
            table = {"exp": F.exp, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "abs": F.abs, "log1p": lambda x: F.when(x > -1, F.log1p(x)), "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil, "sign": F.signum}
            if n.value in table:
                return table[n.value](one).cast("double")
            raise FormulaSyntaxError(f"unknown function {n.value!r}")
        raise FormulaSyntaxError(f"cannot evaluate {n}")

    # factors
    def _relabel(self, c: Column, bins: Node | None) -> Column:
        if bins is None:
            return c
        out = c.cast("string")
        for new, old in bins.args:
            values = [x.value for x in (old.args if old.kind == "list" else (old,))]
            out = F.when(c.cast("string").isin(values) | c.cast("string").isin([f"{float(v)}" for v in values if _is_number(v)]), F.lit(new.value)).otherwise(out)
        return out

    def levels(self, key: str, c: Column) -> list:
        """Sorted non-null levels, gathered once."""
        if key not in self.state.levels:
            if self.fitted:
                raise FormulaSyntaxError(f"levels of {key} are not known")
            got = self.data.select(c.alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()  # bounded by MAX_LEVELS
            if len(got) > MAX_LEVELS:
                raise FormulaSyntaxError(f"{key} has more than {MAX_LEVELS} levels: use it as a fixed effect")
            self.state.levels[key] = sorted(r.v for r in got if not (isinstance(r.v, float) and math.isnan(r.v)))
        return self.state.levels[key]

    def indicators(self, key: str, c: Column) -> list[tuple[Any, Column]]:
        levels = self.levels(key, c)
        known = c.isin(levels) if self.fitted else c.isNotNull()  # an unseen level has no indicator: missing
        return [(v, F.when(known, (c == F.lit(v)).cast("double"))) for v in levels]

    def factor(self, n: Node, reduced: bool) -> list[tuple[str, Column]]:
        """Named columns of a factor of a term."""
        if n.kind == "name":
            ind = self.indicators(n.value, self.col(n.value))
            return [(f"{n.value}[T.{level_label(v)}]" if reduced else f"{n.value}[{level_label(v)}]", c) for v, c in (ind[1:] if reduced else ind)]
        if n.value == "C":
            name = n.args[0].value
            ind = self.indicators(name, self.col(name))
            ref = _match_level([v for v, _ in ind], _treatment_reference(n))
            drop = ref if ref is not None else (ind[0][0] if reduced and ind else None)
            label = str(n)
            return [(f"{label}[T.{level_label(v)}]" if drop is not None else f"{label}[{level_label(v)}]", c) for v, c in ind if v != drop]
        return self.interaction(n, reduced)

    def interaction(self, n: Node, reduced: bool) -> list[tuple[str, Column]]:
        """i(var, var2, ref=, ref2=, bin=, bin2=)."""
        kw = dict(n.keywords)
        name = n.args[0].value
        second = n.args[1] if len(n.args) > 1 else kw.get("var2")
        one = self._relabel(self.col(name), kw.get("bin"))
        ind = self.indicators(f"i({name},{kw.get('bin')})", one)
        all_levels = [v for v, _ in ind]
        ref = _match_level(all_levels, kw.get("ref"))
        if second is None:
            drop = ref if ref is not None else (all_levels[0] if reduced and all_levels else None)
            return [(f"{name}::{level_label(v)}", c) for v, c in ind if drop is None or v != drop]
        mine = [(v, c) for v, c in ind if ref is None or v != ref]
        numeric = second.kind != "name" or isinstance(self.types.get(second.value), T.NumericType)
        if numeric and "ref2" not in kw and "bin2" not in kw:
            x = self.scalar(second)
            return [(f"{name}::{level_label(v)}:{second}", c * x) for v, c in mine]
        other = self._relabel(self.col(second.value), kw.get("bin2"))
        ind2 = self.indicators(f"i({second.value},{kw.get('bin2')})", other)
        ref2 = _match_level([v for v, _ in ind2], kw.get("ref2"))
        theirs = [(v, c) for v, c in ind2 if ref2 is None or v != ref2]
        first = (ref if ref is not None else all_levels[0], ref2 if ref2 is not None else ind2[0][0])
        return [(f"{name}::{level_label(a)}:{second}::{level_label(b)}", c * d) for a, c in mine for b, d in theirs if (a, b) != first]

    def poly(self, n: Node) -> list[tuple[str, Column]]:
        """Orthonormal polynomials, by the three-term recurrence; its moments are one aggregate a degree."""
        kw = dict(n.keywords)
        degree = int(float((n.args[1] if len(n.args) > 1 else kw.get("degree", Node("number", "1"))).value))
        x, key = self.scalar(n.args[0]), str(n)
        if key not in self.state.moments:
            alphas, norms = [], [float(self.data.agg(F.count(x)).first()[0])]
            before, now = F.lit(0.0), F.lit(1.0)
            for d in range(degree):
                r = self.data.agg(F.sum(x * now * now), F.sum(now * now)).first()
                alphas.append(r[0] / r[1])
                beta = norms[-1] / norms[-2] if d else 0.0
                before, now = now, (x - F.lit(alphas[-1])) * now - F.lit(beta) * before
                norms.append(float(self.data.agg(F.sum(now * now)).first()[0]))
            self.state.moments[key] = (alphas, norms)
        alphas, norms = self.state.moments[key]
        out, before, now = [], F.lit(0.0), F.lit(1.0)
        for d in range(degree):
            beta = norms[d] / norms[d - 1] if d else 0.0
            before, now = now, (x - F.lit(alphas[d])) * now - F.lit(beta) * before
            out.append((f"{n}[{d + 1}]", now / F.lit(math.sqrt(norms[d + 1]))))
        return out

    def term(self, term: tuple[Node, ...], spanned: bool) -> list[DesignCol]:
        """Columns of a term. spanned: an intercept or fixed effect is there, so a factor loses its first level."""
        parts: list[list[tuple[str, Column]]] = []
        for n in term:
            if n.kind == "call" and n.value == "poly":
                parts.append(self.poly(n))
            elif self.is_factor(n):
                parts.append(self.factor(n, spanned))
            else:
                parts.append([(str(n), self.scalar(n))])
        out = parts[0]
        for more in parts[1:]:
            out = [(f"{a}:{b}", c * d) for b, d in more for a, c in out]
        return [DesignCol(a, c.cast("double")) for a, c in out]


def _is_number(v: str) -> bool:
    try:
        float(v)
    except ValueError:
        return False
    return True


def _treatment_reference(n: Node) -> Node | None:
    """The reference in C(x, contr.treatment("a")) or C(x, Treatment(reference="a"))."""
    for a in n.args[1:]:
        if a.kind == "call" and a.value.lower() in ("contr.treatment", "treatment"):
            return dict(a.keywords).get("base") or dict(a.keywords).get("reference") or (a.args[0] if a.args else None)
    return None


def _match_level(levels: list, want: Node | None) -> Any:
    if want is None:
        return None
    value = -float(want.args[0].value) if want.kind == "op" else want.value
    for v in levels:
        if v == value or str(v) == str(value) or (_is_number(str(value)) and not isinstance(v, (str, bool)) and float(v) == float(value)):
            return v
    raise FormulaSyntaxError(f"reference level {value!r} is not among the levels")


@dataclass
class Design:
    """frame: the rows that take part, with columns y, x0.., e0, z0.., w, off, fe0.. (names below) beside the user's."""

    formula: Formula
    frame: DataFrame
    x_names: list[str]
    z_names: list[str]
    endog_names: list[str]
    fe: list[str]
    weighted: bool
    has_offset: bool
    state: DesignState
    spec: dict

    y = "__y"

    @property
    def x(self) -> list[str]:
        return [f"__x{i}" for i in range(len(self.x_names))]

    @property
    def e(self) -> list[str]:
        return [f"__e{i}" for i in range(len(self.endog_names))]

    @property
    def z(self) -> list[str]:
        return [f"__z{i}" for i in range(len(self.z_names))]

    @property
    def f(self) -> list[str]:
        return [f"__f{i}" for i in range(len(self.fe))]

    @property
    def w(self) -> Column:
        return F.col("__w") if self.weighted else F.lit(1.0)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))


def project(formula: Formula, data: DataFrame, state: DesignState, weights: str | None = None, offset: str | None = None, drop_intercept: bool = False, context: dict | None = None, fitted: bool = False, with_y: bool = True) -> tuple[DataFrame, dict]:
    """The projection without the filter, and the names of its columns."""
    b = Builder(data, state, context, fitted)
    spanned = formula.intercept or bool(formula.fixed_effects)
    cols: list[tuple[str, Column]] = []
    if with_y:
        kind = b.types.get(formula.dependent.value) if formula.dependent.kind == "name" else T.DoubleType()
        if kind is not None and not isinstance(kind, NUMERIC):
            raise DepvarIsNotNumericError(f"{formula.depvar} is not numeric")
        cols.append(("__y", b.scalar(formula.dependent)))
    xs = [DesignCol("Intercept", F.lit(1.0))] if formula.intercept and not drop_intercept else []
    for i, t in enumerate(formula.exogenous):
        # with no intercept the first factor spans it
        xs += b.term(t, spanned or any(all(b.is_factor(n) for n in s) for s in formula.exogenous[:i]))
    es = [c for t in formula.endogenous for c in b.term(t, spanned)]
    zs = [c for t in formula.instruments for c in b.term(t, spanned)]
    for prefix, group in (("x", xs), ("e", es), ("z", zs)):
        cols += [(f"__{prefix}{i}", c.column) for i, c in enumerate(group)]
    for i, parts in enumerate(formula.fixed_effects):
        c = [b.col(p) for p in parts]
        null = missing(c[0], b.types[parts[0]])
        for p, v in zip(parts[1:], c[1:], strict=True):
            null = null | missing(v, b.types[p])
        cols.append((f"__f{i}", F.when(~null, c[0] if len(c) == 1 else F.concat_ws("\x1f", *[x.cast("string") for x in c]))))
    if weights:
        if not isinstance(b.types.get(weights), T.NumericType):
            raise NonPositiveWeightsError(f"weights {weights!r} must be numeric")
        cols.append(("__w", b.col(weights).cast("double")))
    if offset:
        cols.append(("__off", b.col(offset).cast("double")))
    names = {"x": [c.name for c in xs], "e": [c.name for c in es], "z": [c.name for c in zs]}
    keep = [F.col(f"`{c}`") for c in data.columns if not c.startswith("__")]
    return data.select(*keep, *[c.alias(n) for n, c in cols]), names


def build(formula: Formula, data: DataFrame, weights: str | None = None, offset: str | None = None, drop_intercept: bool = False, context: dict | None = None, state: DesignState | None = None) -> Design:
    """The design of a formula: listwise deletion of missing and infinite values over all of its columns."""
    state = state or DesignState()
    frame, names = project(formula, data, state, weights, offset, drop_intercept, context)
    numeric = ["__y"] + [f"__{k}{i}" for k, v in names.items() for i in range(len(v)) if v[i] != "Intercept"] + (["__w"] if weights else []) + (["__off"] if offset else [])
    keep = F.lit(True)
    for c in numeric:
        keep = keep & finite(c)
    for i in range(len(formula.fixed_effects)):
        keep = keep & F.col(f"__f{i}").isNotNull()
    frame = frame.where(keep)
    return Design(formula, frame, names["x"], names["z"], names["e"], [":".join(p) for p in formula.fixed_effects], bool(weights), bool(offset), state, {"weights": weights, "offset": offset, "drop_intercept": drop_intercept, "context": context})


def warn(text: str) -> None:
    warnings.warn(text, stacklevel=3)


def require_rows(n: float) -> None:
    if not n:
        raise EmptySampleError("no rows are left after dropping missing values and singletons")


__all__ = ["Builder", "Design", "DesignState", "build", "project", "require_rows", "term_name", "warn"]
