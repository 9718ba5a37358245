"""Generalised linear models with fixed effects, by iteratively reweighted least squares.

No row-sized state is kept: the linear predictor is an expression of the coefficients
and of one level table an effect. An iteration is one absorption, whose aggregation also sums
the deviance, so a step is judged with the sums of the next one. Level tables are gathered up to a checked
size and written in the shared folder beyond it.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DepvarOutsideDomainError, EmptySampleError, NonConvergenceError, VcovTypeNotSupportedError
from ..functions.columns import log_gamma, norm_cdf, norm_pdf
from ..plans.design import build
from ..scratch import cut
from .absorb import absorb, drop_singletons
from .model import LinearModel, _linear
from .moments import moments_with, pairs, product_sums, rough_centre, square
from .ols import independent_columns, spd_inverse

LEVELS_ON_DRIVER = 1_000_000


@dataclass(frozen=True)
class Family:
    name: str
    inverse: object
    slope: object  # derivative of the link, by mu and eta
    variance: object
    deviance: object
    start: object
    normal: bool = True


def _bounded(mu: Column) -> Column:
    return F.least(F.greatest(mu, F.lit(1e-15)), F.lit(1 - 1e-15))


def _binary_deviance(y: Column, mu: Column) -> Column:
    return -2.0 * (y * F.ln(_bounded(mu)) + (1.0 - y) * F.ln(1.0 - _bounded(mu)))


def _logit(mu: Column) -> Column:
    return F.ln(mu / (1.0 - mu))


FAMILIES = {
    "logit": Family("logit", lambda e: 1.0 / (1.0 + F.exp(-e)), lambda m, e: 1.0 / (_bounded(m) * (1.0 - _bounded(m))), lambda m: _bounded(m) * (1.0 - _bounded(m)), _binary_deviance, lambda y, w, mean: _logit((w * y + 0.5) / (w + 1.0))),
    "probit": Family("probit", norm_cdf, lambda m, e: 1.0 / F.greatest(norm_pdf(e), F.lit(1e-300)), lambda m: _bounded(m) * (1.0 - _bounded(m)), _binary_deviance, lambda y, w, mean: _logit((w * y + 0.5) / (w + 1.0)) / 1.702),
    "gaussian": Family("gaussian", lambda e: e, lambda m, e: F.lit(1.0), lambda m: F.lit(1.0), lambda y, m: (y - m) * (y - m), lambda y, w, mean: F.lit(mean), normal=False),
    "poisson": Family("poisson", F.exp, lambda m, e: 1.0 / m, lambda m: m, lambda y, m: 2.0 * (F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - (y - m)), lambda y, w, mean: F.ln((y + F.lit(mean)) / 2.0)),
}


_erfc = np.frompyfunc(math.erfc, 1, 1)


def _arrays(family: str, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, its slope in the predictor and variance, as FAMILIES says them of columns."""
    if family == "poisson":
        mu = np.exp(eta)
        return mu, mu, mu
    if family == "gaussian":
        return eta, np.ones_like(eta), np.ones_like(eta)
    if family == "logit":
        mu = 1.0 / (1.0 + np.exp(-eta))
        slope = mu * (1.0 - mu)
    else:
        mu, slope = 0.5 * _erfc(-eta / math.sqrt(2.0)).astype(float), np.exp(-0.5 * eta * eta) / math.sqrt(2 * math.pi)
    bounded = np.clip(mu, 1e-15, 1 - 1e-15)
    return mu, slope, bounded * (1.0 - bounded)


class GlmModel(LinearModel):
    """A fitted generalised linear model; y and w of the linear machinery are the working ones."""

    method = "feglm"

    def __init__(self, design, data, options, sample=None, family: str = "poisson", iwls_tol: float = 1e-8, iwls_maxiter: int = 25, separation: list[str] | None = None):
        if family not in FAMILIES:
            raise ValueError(f"family is one of {sorted(FAMILIES)}")
        self.family, self.iwls_tol, self.iwls_maxiter, self.separation = FAMILIES[family], iwls_tol, iwls_maxiter, separation or []
        self.normal_inference, self._given = self.family.normal, None
        super().__init__(design, data, options, sample)

    # --- sample ----------------------------------------------------------------

    def _separate(self) -> None:
        """Drops rows whose outcome the design predicts as zero for certain."""
        self.n_separated = 0
        if not self.design.fe:
            return
        for method in self.separation:
            if method == "fe":
                for f in self.design.f:
                    zero = self.frame.groupBy(f).agg(F.max((F.col("__y") > 0).cast("int")).alias("any"), F.count(F.lit(1)).alias("n")).where("any = 0")
                    lost = zero.agg(F.sum("n")).first()[0] or 0
                    if lost:
                        self.n_separated += lost
                        self.frame = self.frame.join(zero.select(f), f, "left_anti").select(*self.frame.columns)
            elif method == "ir":
                self._rectify()
            else:
                raise ValueError("separation checks are 'fe' and 'ir'")
        if self.n_separated:
            warnings.warn(f"{self.n_separated} observations removed because of separation", stacklevel=4)

    def _rectify(self, tol: float = 1e-4, rounds: int = 100) -> None:
        """Iterative rectifier: weighted regressions of the boundary indicator, negative fits set to zero, until none is left."""
        inside = self.frame.agg(F.sum((F.col("__y") > 0).cast("double")), F.count(F.lit(1))).first()
        if not inside[1] or inside[0] == inside[1]:
            return
        heavy = float(inside[0] or 0) / tol**2
        rows = self.frame.withColumn("__id", F.monotonically_increasing_id()).withColumn("__wt", F.when(F.col("__y") > 0, F.lit(heavy)).otherwise(1.0)).withColumn("__u0", F.when(F.col("__y") > 0, 0.0).otherwise(1.0))
        rows = cut(rows, "rectifier")
        xs = [F.col(c) for c, n in zip(self.design.x, self.design.x_names, strict=True) if n != "Intercept"]
        for _ in range(rounds):
            cols, w = [F.col("__u0"), *xs], F.col("__wt")
            got = absorb(rows, cols, w, self.design.f, self.options.tol, self.options.max_iter, self.options.max_cells)
            keep = np.flatnonzero(independent_columns(got.gram[1:, 1:], 1e-9)) + 1
            beta = spd_inverse(got.gram[np.ix_(keep, keep)]) @ got.gram[keep, 0]
            names = [f"__d{i}" for i in range(len(cols))]
            fitted = got.demean(rows, self.design.f, cols, names)
            u = F.col("__u0") - (F.col("__d0") - _linear([F.col(names[i]) for i in keep], beta))
            u = F.when((F.col("__y") > 0) | ((u > -0.1 * tol) & (u < tol)), 0.0).otherwise(u)
            fitted = cut(fitted.select(*rows.columns, u.alias("__fit")), "rectifier")
            if (fitted.agg(F.min("__fit")).first()[0] or 0.0) >= 0:
                bad = fitted.where("__fit > 0")
                self.n_separated += bad.count()
                self.frame = fitted.where("__fit <= 0").select(*self.frame.columns)
                return
            rows = fitted.withColumn("__u0", F.when(F.col("__y") > 0, F.col("__u0")).otherwise(F.greatest(F.col("__fit"), F.lit(0.0)))).drop("__fit")
        warnings.warn("the iterative rectifier did not settle", stacklevel=4)

    def _domain(self) -> float:
        y, w = F.col("__y"), self.design.w
        r = self.frame.agg(F.min(y), F.max(y), F.sum(((y != 0) & (y != 1)).cast("int")), F.avg(y), F.count(F.lit(1)), F.min(w)).first()
        if not r[4]:
            raise EmptySampleError("no rows are left after dropping missing values, singletons and separated rows")
        if self.family.name in ("logit", "probit") and (r[2] or r[0] == r[1]):
            raise DepvarOutsideDomainError("the dependent variable must be binary, with both values 0 and 1")
        if self.family.name == "poisson" and r[0] < 0:
            raise DepvarOutsideDomainError("the dependent variable must not be negative")
        self._check_weights(r[5])
        return float(r[3])

    # --- iterations ------------------------------------------------------------

    def _small(self, t: DataFrame) -> DataFrame:
        """A level table with its lineage cut: gathered if its checked size allows, else written."""
        if t.count() > LEVELS_ON_DRIVER:
            return cut(t, "levels")
        return t.sparkSession.createDataFrame(t.toPandas(), t.schema)

    def _with_eta(self, tables: list[DataFrame] | None, beta: np.ndarray, x: list[str], constant: float, first: Column) -> DataFrame:
        """The rows with the linear predictor. With effects the coefficients come as columns of the first level table, so
        the generated code of an iteration is that of the last one and is compiled once."""
        rows, off = self.frame, F.col("__off") if self.design.has_offset else F.lit(0.0)
        if tables is None:
            return rows.withColumn("__eta", first)
        if not tables:
            return rows.withColumn("__eta", off + F.lit(constant) + _linear([F.col(c) for c in x], beta))
        eta, drop = off, []
        for i, t in enumerate(tables):
            more = [F.lit(float(b)).alias(f"__b{j}") for j, b in enumerate(beta)] if not i else []
            rows = rows.join(t.select(F.col("__f").alias(f"__l{i}"), (F.col("c") + F.lit(0.0 if i else constant)).alias(f"__c{i}"), *more), F.col(self.design.f[i]) == F.col(f"__l{i}"), "inner")
            eta, drop = eta + F.col(f"__c{i}"), [*drop, f"__l{i}", f"__c{i}"]
        for j, c in enumerate(x):
            eta, drop = eta + F.col(c) * F.col(f"__b{j}"), [*drop, f"__b{j}"]
        return rows.withColumn("__eta", eta).drop(*drop)

    def _fit(self) -> None:
        d, fam = self.design, self.family
        self._separate()
        if d.fe and self.options.fixef_rm == "singleton" and self.n_separated:
            self.frame, more = drop_singletons(self.frame, d.f, self.options.max_cells)
            self.n_dropped_singletons += more
        y_mean = self._domain()
        used = [c for c in self.frame.columns if not c.startswith("__z") and not c.startswith("__e")]
        self.frame = self.frame.select(*[F.col(f"`{c}`") for c in used])
        kept = self.frame.persist()
        try:
            self._iterate(y_mean, fam)
        finally:
            kept.unpersist()

    def _iterate(self, y_mean: float, fam: Family) -> None:
        d, y, w0 = self.design, F.col("__y"), self.design.w
        off = F.col("__off") if d.has_offset else F.lit(0.0)
        self.intercept = "Intercept" in d.x_names
        xs = [c for c, n in zip(d.x, d.x_names, strict=True) if n != "Intercept"]
        labels = [n for n in d.x_names if n != "Intercept"]
        centre = np.zeros(len(xs)) if not self.intercept and not d.fe else rough_centre(self.frame, xs) if xs else np.zeros(0)
        xc = [F.col(c) - F.lit(float(m)) for c, m in zip(xs, centre, strict=True)]
        beta, constant, active = np.zeros(0), 0.0, list(range(len(xs)))
        start = fam.start(y, w0, y_mean)
        before, self.converged, halved = None, False, 0  # before: the last accepted estimate and its deviance
        now = (None, beta, constant)
        self.iterations = 0
        while self.iterations <= self.iwls_maxiter:
            rows = self._with_eta(now[0], now[1], [xs[i] for i in active], now[2], start)
            eta = F.col("__eta")
            mu = fam.inverse(eta)
            slope = fam.slope(mu, eta)
            work = rows.withColumn("__work", w0 / (slope * slope * fam.variance(mu))).withColumn("__zz", eta - off + (y - mu) * slope).withColumn("__dev", w0 * fam.deviance(y, mu))
            cols = [F.col("__zz"), *[xc[i] for i in active]]
            # one pass gives the deviance of the estimate and the sums for the next one
            if d.fe:
                got = absorb(work, cols, F.col("__work"), d.f, self.options.tol, self.options.max_iter, self.options.max_cells, extra=F.col("__dev"))
                gram, deviance = got.gram, got.extra
            else:
                total, m, deviance = moments_with(work, cols, F.col("__work"), F.col("__dev"))
                gram = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0] if self.intercept else m[1:, 1:]
            if before is not None:
                (old, last), worse = before, not np.isfinite(deviance) or deviance > before[1] * (1 + 1e-12) + 1e-12
                if worse and old[0] is not None and halved < 12 and fam.name != "gaussian":
                    halved += 1  # half way back to the last estimate
                    mixed = [self._small(a.alias("a").join(b.alias("b"), "__f").select("__f", ((F.col("a.c") + F.col("b.c")) / 2).alias("c"))) for a, b in zip(now[0], old[0], strict=True)]
                    now = (mixed, (now[1] + old[1]) / 2, (now[2] + old[2]) / 2)
                    continue
                if fam.name == "gaussian" or abs(deviance - last) / (0.1 + abs(last)) < self.iwls_tol:
                    self.converged = True
                    break
            before, halved = (now, deviance), 0
            self.iterations += 1
            if self.iterations > self.iwls_maxiter:
                break
            if self.iterations == 1:
                ok = independent_columns(gram[1:, 1:], self.options.collin_tol)
                self.collinear = [labels[i] for i, k in zip(active, ok, strict=True) if not k]
                sel = np.concatenate([[0], 1 + np.flatnonzero(ok)]).astype(int)
                active, gram = [i for i, k in zip(active, ok, strict=True) if k], gram[np.ix_(sel, sel)]
            else:
                sel = np.arange(len(gram))
            slopes = spd_inverse(gram[1:, 1:]) @ gram[1:, 0] if len(active) else np.zeros(0)
            shift = float(centre[active] @ slopes) if len(active) else 0.0
            if d.fe:
                if got.local is not None:  # the driver has the tables: no job is needed to cut their lineage
                    spark = self.frame.sparkSession
                    fresh = [spark.createDataFrame(t[["__f"]].assign(c=t["a0"] - t[[f"a{j}" for j in sel[1:]]].to_numpy() @ slopes), f"__f {self.frame.schema[f].dataType.simpleString()}, c double") for t, f in zip(got.local, d.f, strict=True)]
                else:
                    fresh = [self._small(t.select("__f", (F.col("a0") - _linear([F.col(f"a{j}") for j in sel[1:]], slopes)).alias("c"))) for t in got.levels]
                now = (fresh, slopes, -shift)
            elif self.intercept:
                means = m[0, 1:][sel] / m[0, 0]
                now = ([], slopes, float(means[0] - means[1:] @ slopes) - shift)
            else:
                now = ([], slopes, 0.0)
        if not self.converged:
            raise NonConvergenceError(f"no convergence in {self.iwls_maxiter} iterations")
        self.deviance, self._active = deviance, active
        # one last weighted regression at the estimate gives the bread, the scores and the levels
        final = rows.withColumn("__work", w0 / (slope * slope * fam.variance(mu))).withColumn("__zz", eta - off + (y - mu) * slope).withColumn("__mu", mu)
        keep = [c for c in d.x_names if c == "Intercept" or c in [labels[i] for i in active]]
        self._finish(final, keep)

    def _finish(self, final: DataFrame, keep: list[str]) -> None:
        self._y_frame = final
        frame, design = self.frame, self.design
        working = final.withColumn("__y0", F.col("__y")).withColumn("__y", F.col("__zz"))
        self.frame, self.design = working, _Working(design)
        try:
            weights_type, self.options.weights_type = self.options.weights_type, "aweights"
            super()._fit()
        finally:
            self.options.weights_type = weights_type
        self._plain_frame = frame
        if self.options.weights_type == "fweights":
            self.n = float(working.agg(F.sum("__w")).first()[0])

    def _iid(self) -> np.ndarray:
        return super()._iid() if self.family.name == "gaussian" else self.bread

    def _hetero_meat(self, name: str) -> np.ndarray:
        if self.options.weights_type != "fweights":
            return super()._hetero_meat("HC1" if name == "hetero" else name)
        m = [F.col(f"__m{j}") for j in range(self.k)]
        rows = self.score_rows()
        weight = F.col(f"`{self.design.spec['weights']}`").cast("double")
        return square(rows.agg(*product_sums(m, F.pow(F.col("__w") * F.col("__u"), 2) / weight)).first(), self.k)

    def _refit(self, frame: DataFrame) -> GlmModel:
        data = frame.select(*[F.col(f"`{c}`") for c in self.data.columns])
        design = build(self.formula, data, state=self.design.state, **self.design.spec)
        return GlmModel(design, data, self.options, family=self.family.name, iwls_tol=self.iwls_tol, iwls_maxiter=self.iwls_maxiter, separation=self.separation)

    def _jackknife(self, clusters: list[str]) -> np.ndarray:
        """Refits without each cluster. Without effects all of them iterate at once, a job an iteration, from the full estimate."""
        return self._jackknife_refits(clusters) if self.design.fe else self._leave_out(clusters)

    def _leave_out(self, clusters: list[str], most: int = 10_000, rounds: int = 50) -> np.ndarray:
        keys = [F.col(f"`{c}`") for c in clusters]
        groups = self._y_frame.select(*keys).distinct().orderBy(*keys).limit(most + 1).collect()
        if len(groups) > most:
            raise VcovTypeNotSupportedError(f"CRV3 refits once a cluster; there are more than {most}")
        names = [f"__k{i}" for i in range(len(clusters))]
        schema = ", ".join(f"{n} {self._y_frame.schema[c].dataType.simpleString()}" for n, c in zip(names, clusters, strict=True))
        codes = self.frame.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], schema + ", __code int")  # at most ``most`` rows
        on = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
        lead = [F.lit(1.0)] if self.intercept else []
        x = [*lead, *[F.col(self.names_all[i]) for i in self.x_at]]
        off = F.col("__off") if self.design.has_offset else F.lit(0.0)
        rows = self._y_frame.join(F.broadcast(codes), on).select("__code", "__y", _Working(self.design).base.alias("__b"), off.alias("__o"), *[c.cast("double").alias(f"x{j}") for j, c in enumerate(x)]).persist()
        family, k, g, at = self.family.name, self.k, len(groups), pairs(self.k)
        beta = np.tile(self.beta, (g, 1))
        try:
            for _ in range(rounds):

                def part(batches, beta=beta):
                    out = np.zeros((g, len(at) + k))
                    for b in batches:
                        v = b.to_numpy(float)
                        for low in range(0, len(v), max(1, 2_000_000 // g)):
                            p = v[low : low + max(1, 2_000_000 // g)]
                            code, y, base, xs = p[:, 0].astype(int), p[:, 1:2], p[:, 2:3], p[:, 4:]
                            mu, slope, variance = _arrays(family, xs @ beta.T + p[:, 3:4])
                            score, weight = base * (y - mu) * slope / variance, base * slope * slope / variance
                            score[np.arange(len(p)), code] = weight[np.arange(len(p)), code] = 0.0
                            out[:, : len(at)] += weight.T @ np.column_stack([xs[:, i] * xs[:, j] for i, j in at])
                            out[:, len(at) :] += score.T @ xs
                    frame = pd.DataFrame(out, columns=[f"s{i}" for i in range(out.shape[1])])
                    frame.insert(0, "code", np.arange(g))
                    yield frame

                cols = [f"s{i}" for i in range(len(at) + k)]
                got = rows.mapInPandas(part, "code int, " + ", ".join(f"{c} double" for c in cols)).groupBy("code").agg(*[F.sum(c).alias(c) for c in cols]).orderBy("code").toPandas()[cols].to_numpy(float)
                step = np.stack([np.linalg.pinv(square(r[: len(at)], k)) @ r[len(at) :] for r in got])
                beta = beta + step
                if np.abs(step).max(initial=0.0) < 1e-9 * (1 + np.abs(beta).max(initial=0.0)):
                    d = beta - self.beta
                    return d.T @ d
        finally:
            rows.unpersist()
        raise NonConvergenceError("a refit without a cluster did not converge")

    # --- rows for users --------------------------------------------------------

    def _respond(self, link: Column, kind: str) -> Column:
        if kind not in ("link", "response"):
            raise ValueError("type is 'link' or 'response'")
        return self.family.inverse(link) if kind == "response" else link

    def resid(self, type: str = "response") -> DataFrame:
        rows = self._y_frame
        user = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")]
        u = F.col("__y") - F.col("__mu")
        return rows.select(*user, (u if type == "response" else u * self.family.slope(F.col("__mu"), F.col("__eta"))).alias("resid"))

    def _linear_predictor(self, newdata=None, se: bool = False):
        rows, link, x = super()._linear_predictor(newdata)
        return rows, link + (F.col("__off") if self.design.has_offset else F.lit(0.0)), x

    def loglik(self) -> dict[str, float]:
        """Poisson: log-likelihood, that of the mean alone, pseudo R2 and Pearson's chi-squared."""
        y, mu, w = F.col("__y"), F.col("__mu"), _Working(self.design).base
        mean = float(self._y_frame.agg(F.sum(w * y) / F.sum(w)).first()[0])
        one = lambda m: F.sum(w * (y * F.ln(m) - m - log_gamma(y + 1.0)))
        r = self._y_frame.agg(one(mu), one(F.lit(mean)), F.sum(w * (y - mu) * (y - mu) / mu)).first()
        return {"loglik": r[0], "loglik_null": r[1], "pseudo_r2": 1 - r[0] / r[1], "pearson_chi2": r[2], "deviance": self.deviance}


class _Working:
    """The design with the working weights in place of the user's."""

    def __init__(self, design):
        self._design = design._design if isinstance(design, _Working) else design

    def __getattr__(self, name):
        return getattr(self._design, name)

    @property
    def base(self) -> Column:
        return self._design.w

    @property
    def weighted(self) -> bool:
        return False  # the working weights are positive by construction

    @property
    def w(self) -> Column:
        return F.col("__work")


__all__ = ["FAMILIES", "Family", "GlmModel", "reduce"]
