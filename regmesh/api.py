"""Entry points: feols, feglm, fepois, quantreg and what they return."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.absorb import Demeaner
from .operators.glm import GlmModel
from .operators.model import Given, LinearModel, Options, Vcov, pooled, shared_moments
from .operators.moments import WIDE
from .operators.ols import Ssc
from .plans.design import Builder, DesignState, build
from .plans.formula import Formula


class MultiModel:
    """The models of a formula that stands for several, or of several samples."""

    def __init__(self, models: dict[str, LinearModel]):
        self.models = models

    def to_list(self) -> list[LinearModel]:
        return list(self.models.values())

    def __getitem__(self, at: int) -> LinearModel:
        return self.to_list()[at]

    def __len__(self) -> int:
        return len(self.models)

    def fetch_model(self, at: int | str) -> LinearModel:
        return self.models[at] if isinstance(at, str) else self[at]

    def vcov(self, vcov: Vcov, vcov_kwargs: dict | None = None) -> MultiModel:
        for m in self.models.values():
            m.vcov(vcov, vcov_kwargs)
        return self

    def _long(self, what: Callable[[LinearModel], pd.DataFrame]) -> pd.DataFrame:
        return pd.concat({name: what(m) for name, m in self.models.items()}, names=["fml"])

    def tidy(self, alpha: float = 0.05) -> pd.DataFrame:
        return self._long(lambda m: m.tidy(alpha))

    def tidy_frame(self) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [m.tidy_frame().withColumn("fml", F.lit(n)) for n, m in self.models.items()])

    def coef(self) -> pd.DataFrame:
        return self._long(lambda m: m.coef().to_frame())

    def se(self) -> pd.DataFrame:
        return self._long(lambda m: pd.DataFrame({"Std. Error": m.se()}, index=m.coefnames))

    def tstat(self) -> pd.DataFrame:
        return self._long(lambda m: pd.DataFrame({"t value": m.tstat()}, index=m.coefnames))

    def pvalue(self) -> pd.DataFrame:
        return self._long(lambda m: pd.DataFrame({"Pr(>|t|)": m.pvalue()}, index=m.coefnames))

    def confint(self, alpha: float = 0.05) -> pd.DataFrame:
        return self._long(lambda m: m.confint(alpha))

    def iv_diag(self) -> dict[str, dict[str, float]]:
        return {n: m.iv_diag() for n, m in self.models.items()}


def _samples(data: DataFrame, split: str | None, fsplit: str | None) -> list[tuple[tuple[str, Any] | None, DataFrame]]:
    by = split or fsplit
    if not by:
        return [(None, data)]
    if split and fsplit:
        raise ValueError("give split or fsplit, not both")
    c = F.col(f"`{by}`")
    values = sorted(r[0] for r in data.select(c).where(c.isNotNull()).distinct().limit(1001).collect())
    if len(values) > 1000:
        raise ValueError(f"{by} has more than 1000 values to split by")
    whole = [((by, "all"), data.where(c.isNotNull()))] if fsplit else []
    return whole + [((by, v), data.where(c == F.lit(v))) for v in values]


def _estimate(fml: str, data: DataFrame, make: Callable, vcov: Vcov, vcov_kwargs: dict | None, split: str | None, fsplit: str | None, cache: bool, grouped: bool = False, **spec) -> LinearModel | MultiModel:
    """make(design, data, sample, given). grouped: plain formulas and their samples may share one aggregation."""
    formulas = Formula.parse(fml)
    models: dict[str, LinearModel] = {}
    samples = _samples(data, split, fsplit)
    keep = cache and len(formulas) * len(samples) > 1
    if keep:  # one scan serves all models
        used = {n for f in formulas for n in _columns_of(f)} | {v for v in (spec.get("weights"), spec.get("offset"), split or fsplit) if v} | _vcov_columns(vcov, vcov_kwargs)
        data = data.select(*[F.col(f"`{c}`") for c in data.columns if c in used]).persist()
        samples = _samples(data, split, fsplit)
    try:
        shared = _shared_moments(formulas, data, split or fsplit, spec) if grouped and len(samples) * len(formulas) > 1 else {}
        for sample, part in samples:
            state = DesignState()
            for f in formulas:
                given = None
                if f.text in shared:
                    of = shared[f.text]
                    whole = fsplit and sample is samples[0][0]
                    given = (pooled(list(of.values())) if whole else of.get(sample[1] if sample else 0)) if of else None
                model = make(build(f, part, state=state, **spec), part, sample, given)
                model.vcov(vcov, vcov_kwargs)
                name = f.text if sample is None else f"{f.text} (Sample: {sample[0]} = {sample[1]})"
                models[name if name not in models else f"{name} ({len(models)})"] = model  # a value may be called as the whole sample is
    finally:
        if keep:
            data.unpersist()
    return next(iter(models.values())) if len(models) == 1 else MultiModel(models)


def _shared_moments(formulas: list[Formula], data: DataFrame, by: str | None, spec: dict) -> dict[str, dict[Any, Given]]:
    """By formula with an intercept, without effects, instruments and terms that learn from their sample: the moments of all samples."""
    b = Builder(data, DesignState(), spec.get("context"))
    wanted: dict[str, list[tuple[str, Column]]] = {}
    for f in formulas:
        learns = any(b.is_factor(n) or (n.kind == "call" and n.value in ("poly", "C", "i")) for t in f.exogenous for n in t)
        if f.fixed_effects or f.is_iv or learns or not f.intercept or spec.get("drop_intercept") or b.is_factor(f.dependent):
            continue
        wanted[f.text] = [(f"y {f.depvar}", b.scalar(f.dependent)), *[(f"x {c.name}", c.column) for t in f.exogenous for c in b.term(t, True)]]
    if len(wanted) * (2 if by else 1) < 2 or len({k for c in wanted.values() for k, _ in c}) + 1 > WIDE:
        return {}
    w = F.col(f"`{spec['weights']}`").cast("double") if spec.get("weights") else F.lit(1.0)
    return shared_moments(data.where(F.col(f"`{by}`").isNotNull()) if by else data, wanted, w, F.col(f"`{by}`") if by else None)


def _columns_of(f: Formula) -> set[str]:
    out = f.dependent.names() | {p for parts in f.fixed_effects for p in parts}
    for t in (*f.exogenous, *f.endogenous, *f.instruments):
        for n in t:
            out |= n.names()
    return out


def _vcov_columns(vcov: Vcov, kw: dict | None) -> set[str]:
    out = {c.strip() for v in vcov.values() for c in v.split("+")} if isinstance(vcov, dict) else set()
    return out | {v for k, v in (kw or {}).items() if k in ("time_id", "panel_id") and v}


def _checked(data: DataFrame) -> DataFrame:
    if isinstance(data, DataFrame):
        return data
    raise TypeError("data must be a Spark DataFrame; regmesh.sources.frames.intake() reads pandas and Arrow tables")


def _options(ssc, weights_type: str, collin_tol: float, solver: str, fixef_rm: str, tol: float, max_iter: int, max_cells: int | None, demeaner: Demeaner | None) -> Options:
    if weights_type not in ("aweights", "fweights") or fixef_rm not in ("singleton", "none"):
        raise ValueError("weights_type is aweights or fweights; fixef_rm is singleton or none")
    d = demeaner or Demeaner(tol=tol, max_iter=max_iter, **({} if max_cells is None else {"max_cells": max_cells}))
    return Options(ssc or Ssc(), weights_type, collin_tol, solver, fixef_rm, d.tol, d.max_iter, d.cells)


def feols(
    fml: str, data: DataFrame, vcov: Vcov = None, vcov_kwargs: dict | None = None, weights: str | None = None, ssc: Ssc | None = None, fixef_rm: str = "singleton", collin_tol: float = 1e-9, drop_intercept: bool = False,
    weights_type: str = "aweights", solver: str = "scipy.linalg.solve", context: dict | None = None, split: str | None = None, fsplit: str | None = None, tol: float = 1e-10, max_iter: int = 10_000, max_cells: int | None = None, demeaner: Demeaner | None = None, cache: bool = True,
) -> LinearModel | MultiModel:
    """Least squares with fixed effects and instruments; several models come as a MultiModel."""
    options = _options(ssc, weights_type, collin_tol, solver, fixef_rm, tol, max_iter, max_cells, demeaner)
    return _estimate(fml, _checked(data), lambda d, part, s, given: LinearModel(d, part, options, s, given), vcov, vcov_kwargs, split, fsplit, cache, grouped=True, weights=weights, drop_intercept=drop_intercept, context=context)


def feglm(
    fml: str, data: DataFrame, family: str, vcov: Vcov = None, vcov_kwargs: dict | None = None, weights: str | None = None, offset: str | None = None, ssc: Ssc | None = None, fixef_rm: str = "singleton", collin_tol: float = 1e-9,
    drop_intercept: bool = False, weights_type: str = "aweights", iwls_tol: float = 1e-8, iwls_maxiter: int = 25, separation_check: list[str] | None = None, context: dict | None = None, split: str | None = None, fsplit: str | None = None,
    tol: float = 1e-10, max_iter: int = 10_000, max_cells: int | None = None, demeaner: Demeaner | None = None, cache: bool = True,
) -> GlmModel | MultiModel:
    """Generalised linear models with fixed effects: logit, probit, gaussian, poisson."""
    if offset and family != "poisson":
        raise ValueError("an offset is available for the poisson family")
    if any(f.is_iv for f in Formula.parse(fml)):
        raise ValueError("generalised linear models take no instruments")
    options = _options(ssc, weights_type, collin_tol, "scipy.linalg.solve", fixef_rm, tol, max_iter, max_cells, demeaner)
    checks = ["fe"] if separation_check is None else separation_check

    def make(d, part, s, given):
        return GlmModel(d, part, options, s, family=family, iwls_tol=iwls_tol, iwls_maxiter=iwls_maxiter, separation=checks if family == "poisson" else [])

    return _estimate(fml, _checked(data), make, vcov, vcov_kwargs, split, fsplit, cache, weights=weights, offset=offset, drop_intercept=drop_intercept, context=context)


def fepois(fml: str, data: DataFrame, vcov: Vcov = None, **kwargs) -> GlmModel | MultiModel:
    """Poisson regression with fixed effects."""
    return feglm(fml, data, "poisson", vcov, **kwargs)
