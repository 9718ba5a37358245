"""Linear models: least squares, weighted, two-stage; covariances, inference, prediction.

A model holds k-sized numbers on the driver and lazy DataFrames for all that has as
many rows as the data. Coefficients come from one aggregation; a covariance that needs
residuals is one more pass with the scores as expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EmptySampleError, NanInClusterVarError, NonPositiveWeightsError, VcovTypeNotSupportedError
from ..functions import distributions as dist
from ..plans.design import Design, build, finite, project
from ..scratch import cut
from .absorb import MAX_CELLS, Absorbed, absorb, drop_singletons
from .moments import moments, moments_with, pairs, product_sums, rough_centre, square
from .ols import Ssc, independent_columns, solve, spd_inverse

Vcov = str | dict[str, str] | None


def shared_moments(data: DataFrame, wanted: dict[str, list[tuple[str, Column]]], w: Column, by: Column | None) -> dict[str, dict[Any, Given]]:
    """Moments of several models (a name to its columns, the outcome first) in several samples (values of by): one aggregation.

    Rows are those that are complete in all columns. A model that has more rows of its own in some sample is left out.
    """
    named = {k: c for cols in wanted.values() for k, c in cols}
    at = {k: i for i, k in enumerate(named)}
    rows = data.select((F.lit(0) if by is None else by).alias("by"), w.alias("w"), *[c.cast("double").alias(f"u{i}") for i, c in enumerate(named.values())]).where(finite("w"))
    complete = reduce(lambda a, b: a & b, [finite(f"u{i}") for i in range(len(named))])
    centre = rough_centre(rows.where(complete), [f"u{i}" for i in range(len(named))])
    cols = [F.lit(1.0), *[F.col(f"u{i}") - F.lit(float(v)) for i, v in enumerate(centre)]]
    own = [F.sum(reduce(lambda a, b: a & b, [finite(f"u{at[k]}") for k, _ in c]).cast("long")) for c in wanted.values()]
    inside = F.when(complete, F.col("w"))
    got = rows.groupBy("by").agg(F.sum(complete.cast("long")), F.min(inside), *own, *product_sums(cols, inside)).collect()
    out: dict[str, dict[Any, Given]] = {}
    for j, (name, c) in enumerate(wanted.items()):
        if all(r[3 + j] == r[1] for r in got):
            sel = [at[k] for k, _ in c]
            wide = [0, *[i + 1 for i in sel]]
            out[name] = {r[0]: Given(centre[sel], float(r[1]), square(r[3 + len(wanted) :], len(cols))[np.ix_(wide, wide)], r[2]) for r in got if r[1]}
    return out


def pooled(parts: list[Given]) -> Given:
    return Given(parts[0].centre, sum(p.n for p in parts), sum(p.m for p in parts), min(p.w_min for p in parts))


def _linear(cols: list[Column], beta) -> Column:
    terms = [c * F.lit(float(b)) for c, b in zip(cols, beta, strict=True)]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def _quadratic(cols: list[Column], a: np.ndarray) -> Column:
    return reduce(lambda x, y: x + y, [F.lit(float(a[i, j] * (1 if i == j else 2))) * cols[i] * cols[j] for i, j in pairs(len(cols))], F.lit(0.0))


@dataclass
class Options:
    ssc: Ssc = field(default_factory=Ssc)
    weights_type: str = "aweights"
    collin_tol: float = 1e-9
    solver: str = "scipy.linalg.solve"
    fixef_rm: str = "singleton"
    tol: float = 1e-10
    max_iter: int = 10_000
    max_cells: int = MAX_CELLS


@dataclass
class Given:
    """Moments of a sample that were gathered together with those of others: of [1, columns less their centre]."""

    centre: np.ndarray
    n: float
    m: np.ndarray
    w_min: float | None


class LinearModel:
    """A fitted OLS, WLS or 2SLS model."""

    method = "feols"
    normal_inference = False

    def __init__(self, design: Design, data: DataFrame, options: Options, sample: tuple[str, Any] | None = None, given: Given | None = None):
        self.design, self.data, self.options, self.sample, self._given = design, data, options, sample, given
        self.frame = design.frame
        self.n_dropped_singletons = 0
        if design.fe and options.fixef_rm == "singleton":
            self.frame, self.n_dropped_singletons = drop_singletons(self.frame, design.f, options.max_cells)
        self._fit()

    # --- fitting ---------------------------------------------------------------

    @property
    def formula(self):
        return self.design.formula

    @property
    def is_iv(self) -> bool:
        return bool(self.design.endog_names)

    def _columns(self) -> tuple[list[str], list[str]]:
        """Names of the regressors (intercept first) and of the instruments beyond the exogenous ones."""
        d = self.design
        return [*[c for c, n in zip(d.x, d.x_names, strict=True) if n != "Intercept"], *d.e], d.z

    def _check_weights(self, w_min: float | None) -> None:
        if self.design.weighted and w_min is not None and w_min <= 0:
            raise NonPositiveWeightsError("weights must be strictly positive")

    def _fit(self) -> None:
        d = self.design
        xs, zs = self._columns()
        names = ["__y", *xs, *zs]
        if d.weighted:
            self._check_weights(self._given.w_min if self._given else self.frame.agg(F.min("__w")).first()[0])
        self.intercept = "Intercept" in d.x_names
        free = not self.intercept and not d.fe
        self.centre = self._given.centre if self._given else np.zeros(len(names)) if free else rough_centre(self.frame, names)
        self.cols = [F.col(c) - F.lit(float(m)) if m else F.col(c) for c, m in zip(names, self.centre, strict=True)]
        self.names_all = names
        if d.fe:
            got = absorb(self.frame, self.cols, d.w, d.f, self.options.tol, self.options.max_iter, self.options.max_cells)
            gram, means = got.gram, got.sums / max(got.sum_w, 1e-300)
        else:
            n, m = (self._given.n, self._given.m) if self._given else moments(self.frame, self.cols, d.w)[::2]
            got = Absorbed(n, m[0, 0], m[0, 1:], m[1:, 1:], m[1:, 1:], [])
            means = got.sums / max(got.sum_w, 1e-300)
            gram = m[1:, 1:] - np.outer(means, means) * got.sum_w if self.intercept else m[1:, 1:]
        if not got.n:
            raise EmptySampleError("no rows are left after dropping missing values and singletons")
        self.absorbed, self.gram, self.means = got, gram, means
        self.n_rows, self.sum_w = got.n, got.sum_w
        self.n = got.sum_w if self.options.weights_type == "fweights" else got.n
        self.k_fe = list(got.k_fe)
        self._solve(xs, zs)

    def _solve(self, xs: list[str], zs: list[str]) -> None:
        d, gram, p = self.design, self.gram, len(xs)
        labels = [n for n in d.x_names if n != "Intercept"] + d.endog_names
        keep = independent_columns(gram[1 : p + 1, 1 : p + 1], self.options.collin_tol)
        at = 1 + np.flatnonzero(keep)
        self.collinear = [n for n, k in zip(labels, keep, strict=True) if not k]
        n_exo = sum(1 for i in at if i <= p - len(d.e))
        if self.is_iv:
            zi = np.concatenate([at[:n_exo], p + 1 + np.arange(len(zs))]).astype(int)
            keep_z = independent_columns(gram[np.ix_(zi, zi)], self.options.collin_tol)
            zi = zi[keep_z]
            zz, zx, zy = gram[np.ix_(zi, zi)], gram[np.ix_(zi, at)], gram[zi, 0]
            self.pi = solve(zz, zx, self.options.solver)
            xx, xy, self.z_at = zx.T @ self.pi, self.pi.T @ zy, zi
        else:
            xx, xy = gram[np.ix_(at, at)], gram[at, 0]
        slopes = solve(xx, xy, self.options.solver) if len(at) else np.zeros(0)
        inv = spd_inverse(xx)
        self.x_at = at
        ux = gram[0, 0] - 2 * slopes @ gram[at, 0] + slopes @ gram[np.ix_(at, at)] @ slopes
        self.rss, self.slopes = max(float(ux), 0.0), slopes
        mean_y, mean_x = self.means[0] + self.centre[0], self.means[at] + self.centre[at]
        total = self.absorbed.total[0, 0] - self.absorbed.sums[0] ** 2 / self.sum_w
        self.tss, self.tss_within = float(total), float(gram[0, 0])
        if self.intercept:
            self.coefnames = ["Intercept", *[labels[i - 1] for i in at]]
            self.beta = np.concatenate([[mean_y - mean_x @ slopes], slopes])
            top = 1.0 / self.sum_w + mean_x @ inv @ mean_x
            self.bread = np.block([[np.array([[top]]), -(mean_x @ inv)[None, :]], [-(inv @ mean_x)[:, None], inv]])
        else:
            self.coefnames, self.beta, self.bread = [labels[i - 1] for i in at], slopes, inv
            if not d.fe:
                self.tss = float(self.absorbed.total[0, 0] - self.absorbed.sums[0] ** 2 / self.sum_w)
        self.k = len(self.beta)

    # --- rows ------------------------------------------------------------------

    def _absorbed_rows(self) -> tuple[DataFrame, list[Column]]:
        """The frame with the absorbed (or raw) columns, in the order of names_all."""
        if self.design.fe:
            names = [f"__d{i}" for i in range(len(self.cols))]
            return self.absorbed.demean(self.frame, self.design.f, self.cols, names), [F.col(n) for n in names]
        return self.frame, [F.col(c) for c in self.names_all]

    def score_rows(self) -> DataFrame:
        """The user's columns, __w, __u (residual), __m0.. (regressors, projected for IV) and __s0.. (scores)."""
        rows, v = self._absorbed_rows()
        x = [v[i] for i in self.x_at]
        lead = [F.lit(1.0)] if self.intercept else []
        u = v[0] - _linear(lead + x, self.beta)
        m = lead + ([_linear([v[i] for i in self.z_at], self.pi[:, j]) + self._iv_shift(j) for j in range(len(x))] if self.is_iv else x)
        user = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__") or c.startswith("__f")]
        rows = rows.select(*user, self.design.w.alias("__w"), u.alias("__u"), v[0].alias("__yd"), *[c.cast("double").alias(f"__m{j}") for j, c in enumerate(m)])
        return rows.select("*", *[(F.col("__w") * F.col("__u") * F.col(f"__m{j}")).alias(f"__s{j}") for j in range(self.k)])

    def _iv_shift(self, j: int) -> Column:
        """With an intercept the projected regressor has the regressor's mean."""
        if not self.intercept:
            return F.lit(0.0)
        mean = self.means + self.centre
        return F.lit(float(mean[self.x_at[j]] - mean[self.z_at] @ self.pi[:, j]))

    @property
    def _s(self) -> list[Column]:
        return [F.col(f"__s{j}") for j in range(self.k)]

    # --- covariance ------------------------------------------------------------

    def vcov(self, vcov: Vcov = None, vcov_kwargs: dict | None = None, ssc: Ssc | None = None) -> LinearModel:
        """Sets the covariance; returns the model itself."""
        vcov, ssc, kw = vcov or "iid", ssc or self.options.ssc, vcov_kwargs or {}
        self.vcov_type, self.vcov_kwargs = vcov, kw
        fe = (sum(self.k_fe), len(self.k_fe))
        self.G: list[int] = []
        if isinstance(vcov, dict):
            ((kind, text),) = vcov.items()
            self._clustered(kind.upper(), [c.strip() for c in text.split("+")], ssc)
            return self
        name = vcov.upper() if vcov.upper() in ("HC1", "HC2", "HC3", "NW", "DK") else vcov.lower()
        if name == "iid":
            adj, _, self.df_t = ssc.factor("iid", self.n, self.k, *fe)
            self.V = adj * self._iid()
        elif name in ("hetero", "HC1", "HC2", "HC3"):
            if name in ("HC2", "HC3") and (self.design.fe or self.is_iv):
                raise VcovTypeNotSupportedError(f"{name} is not available with fixed effects or instruments")
            adj, _, self.df_t = ssc.factor("hetero", self.n, self.k, *fe)
            self.V = adj * self.bread @ self._hetero_meat(name) @ self.bread
        elif name in ("NW", "DK"):
            meat, groups = self._hac_meat(name, kw)
            adj, _, self.df_t = ssc.factor("HAC", self.n, self.k, *fe, groups=groups)
            self.V = adj * self.bread @ meat @ self.bread
        else:
            raise VcovTypeNotSupportedError(f"unknown covariance {vcov!r}")
        self.V = 0.5 * (self.V + self.V.T)
        return self

    def _iid(self) -> np.ndarray:
        return self.rss / (self.n - 1) * self.bread

    def _hetero_meat(self, name: str) -> np.ndarray:
        if not self.k:
            return np.zeros((0, 0))
        rows, w, u = self.score_rows(), F.col("__w"), F.col("__u")
        m = [F.col(f"__m{j}") for j in range(self.k)]
        # frequency weights stand for rows: w * u^2 * mm'; others for precision: (w u)^2 mm'
        frequency = self.options.weights_type == "fweights"
        scale = w * u * u if frequency else w * w * u * u
        if name in ("HC2", "HC3"):
            h = _quadratic(m, self.bread) * (F.lit(1.0) if frequency else w)
            scale = scale / (F.lit(1.0) - h if name == "HC2" else F.pow(F.lit(1.0) - h, 2))
        return moments(rows, m, scale)[2][1:, 1:]

    def _cluster_columns(self, clusters: list[str]) -> None:
        for c in clusters:
            if c not in self.data.columns:
                raise VcovTypeNotSupportedError(f"no cluster column {c!r} in the data")

    def _cluster_checks(self, clusters: list[str], rows: DataFrame) -> None:
        self._cluster_columns(clusters)
        null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in clusters])
        if rows.where(null).limit(1).count():
            raise NanInClusterVarError("a cluster variable has null values")

    def _nested(self, clusters: list[str]) -> tuple[int, int]:
        """Levels of, and number of, fixed effects that are nested in some cluster variable."""
        k = n = 0
        for f, name, size in zip(self.design.f, self.design.fe, self.k_fe, strict=True):
            if name in clusters:
                nested = True
            else:
                per = self.frame.groupBy(f).agg(*[(F.min(f"`{c}`") == F.max(f"`{c}`")).alias(f"same{i}") for i, c in enumerate(clusters)])
                nested = any(per.agg(*[F.min(F.col(f"same{i}").cast("int")) for i in range(len(clusters))]).first())
            k, n = k + size * nested, n + nested
        return k, n

    def _clustered(self, kind: str, clusters: list[str], ssc: Ssc) -> None:
        if kind not in ("CRV1", "CRV3") or len(clusters) > 2:
            raise VcovTypeNotSupportedError("clustered covariances are CRV1 or CRV3, by one or two variables")
        if kind == "CRV3" and self.is_iv:
            raise VcovTypeNotSupportedError("CRV3 is not available with instruments")
        rows = self.score_rows()
        self._cluster_columns(clusters) if kind == "CRV1" and self.k else self._cluster_checks(clusters, self.frame)  # the meat looks for nulls itself
        sets = [[c] for c in clusters] + ([clusters] if len(clusters) > 1 else [])
        meats, counts = [], []
        for s in sets:
            meat, g = self._cluster_meat(rows, s) if kind == "CRV1" else (None, 0)
            meats.append(meat)
            counts.append(g)
        if kind == "CRV3":
            counts = [self.frame.select(*[F.col(f"`{c}`") for c in s]).distinct().count() for s in sets]
        self.G = counts
        used = [min(counts)] * len(counts) if ssc.G_df == "min" else counts
        k_nested, n_nested = self._nested(clusters) if self.design.fe and ssc.k_fixef == "nonnested" else (0, 0)
        self.V, self.df_t = np.zeros((self.k, self.k)), min(used) - 1
        for s, meat, g, sign in zip(sets, meats, used, (1, 1, -1), strict=False):
            adj, _, _ = ssc.factor("CRV", self.n, self.k, sum(self.k_fe), len(self.k_fe), k_nested, n_nested, g)
            self.V += sign * adj * (self.bread @ meat @ self.bread if kind == "CRV1" else self._jackknife(s))
        self.clusters = clusters
        self.V = 0.5 * (self.V + self.V.T)

    def cluster_scores(self, clusters: list[str]) -> DataFrame:
        """Sums of the scores by cluster; map-side partial sums, so a hot cluster costs a row a task."""
        return self.score_rows().groupBy(*[F.col(f"`{c}`") for c in clusters]).agg(*[F.sum(s).alias(f"g{j}") for j, s in enumerate(self._s)])

    def _cluster_meat(self, rows: DataFrame, clusters: list[str]) -> tuple[np.ndarray, int]:
        if not self.k:
            return np.zeros((0, 0)), rows.select(*[F.col(f"`{c}`") for c in clusters]).distinct().count()
        sums = rows.groupBy(*[F.col(f"`{c}`") for c in clusters]).agg(*[F.sum(s).alias(f"g{j}") for j, s in enumerate(self._s)])
        null = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in clusters])
        n, m, nulls = moments_with(sums, [F.col(f"g{j}") for j in range(self.k)], F.lit(1.0), null.cast("double"))
        if nulls:
            raise NanInClusterVarError("a cluster variable has null values")
        return m[1:, 1:], int(n)

    def _jackknife(self, clusters: list[str]) -> np.ndarray:
        """Leave-one-cluster-out coefficients around the estimate, from each cluster's own cross products."""
        if self.design.fe:
            return self._jackknife_refits(clusters)
        rows, v = self._absorbed_rows()
        lead = [F.lit(1.0)] if self.intercept else []
        cols = [v[0], *lead, *[v[i] for i in self.x_at]]
        per = rows.groupBy(*[F.col(f"`{c}`") for c in clusters]).agg(*[s.alias(f"q{i}") for i, s in enumerate(product_sums(cols, self.design.w))]).select([f"q{i}" for i in range(len(pairs(len(cols))))])
        total = square(per.agg(*[F.sum(c) for c in per.columns]).first(), len(cols))
        k, beta, all_pairs = self.k, self.beta, pairs(len(cols))

        def part(batches):
            out = np.zeros((k, k))
            for b in batches:
                for r in b.itertuples(index=False):
                    m = total.copy()
                    for value, (i, j) in zip(r, all_pairs, strict=True):
                        m[i, j] -= value
                        m[j, i] = m[i, j]
                    d = np.linalg.pinv(m[1:, 1:]) @ m[1:, 0] - beta
                    out += np.outer(d, d)
            yield pd.DataFrame({"m": [out.ravel().tolist()]})

        got = per.mapInPandas(part, "m array<double>").agg(*[F.sum(F.col("m")[i]) for i in range(k * k)]).first()
        return np.array(got, dtype=float).reshape(k, k)

    def _refit(self, frame: DataFrame) -> LinearModel:
        data = frame.select(*[F.col(f"`{c}`") for c in self.data.columns])
        return type(self)(build(self.formula, data, state=self.design.state, **self.design.spec), data, self.options)

    def _jackknife_refits(self, clusters: list[str], most: int = 10_000) -> np.ndarray:
        groups = self.frame.select(*[F.col(f"`{c}`") for c in clusters]).distinct().limit(most + 1).collect()
        if len(groups) > most:
            raise VcovTypeNotSupportedError(f"CRV3 with fixed effects refits once a cluster; there are more than {most}")
        out = np.zeros((self.k, self.k))
        for g in groups:
            rest = self.frame.where(~reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.lit(g[c])) for c in clusters]))
            m = self._refit(rest)
            other = dict(zip(m.coefnames, m.beta, strict=True))
            d = np.array([other.get(n, 0.0) for n in self.coefnames]) - self.beta
            out += np.outer(d, d)
        return out

    def _hac_meat(self, name: str, kw: dict) -> tuple[np.ndarray, int]:
        time, panel, lag = kw.get("time_id"), kw.get("panel_id"), kw.get("lag")
        if not time:
            raise VcovTypeNotSupportedError("NW and DK need vcov_kwargs with a time_id")
        rows = self.score_rows()
        times = self.frame.select(F.col(f"`{time}`")).distinct().count()
        if name == "DK" or not panel:
            by_time = rows.groupBy(F.col(f"`{time}`").alias("__t")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"g{j}") for j, s in enumerate(self._s)])
            if name == "NW":
                if lag is None:
                    raise VcovTypeNotSupportedError("NW without a panel_id needs a lag")
                if by_time.where("n > 1").limit(1).count():
                    raise VcovTypeNotSupportedError("NW needs unique times; give a panel_id for panels")
            lag = int(math.floor(times**0.25)) if lag is None else int(lag)
            return self._bartlett_series(by_time, lag), times
        if rows.groupBy(F.col(f"`{panel}`"), F.col(f"`{time}`")).count().where("count > 1").limit(1).count():
            raise VcovTypeNotSupportedError("panel and time do not name rows uniquely")
        lag = int(math.floor(times**0.25)) if lag is None else int(lag)
        w = Window.partitionBy(F.col(f"`{panel}`")).orderBy(F.col(f"`{time}`"))
        lagged = rows.select(*[c.alias(f"g{j}") for j, c in enumerate(self._s)], *[F.lag(c, step).over(w).alias(f"l{step}_{j}") for step in range(1, lag + 1) for j, c in enumerate(self._s)])
        return self._weighted_lags(lagged, lag), times

    def _weighted_lags(self, rows: DataFrame, lag: int) -> np.ndarray:
        k = self.k
        g = [F.col(f"g{j}") for j in range(k)]
        sums = product_sums(g) + [F.sum(g[i] * F.col(f"l{step}_{j}")) for step in range(1, lag + 1) for i in range(k) for j in range(k)]
        got = [v or 0.0 for v in rows.agg(*sums).first()]
        meat, at = square(got[: len(pairs(k))], k), len(pairs(k))
        for step in range(1, lag + 1):
            gamma = np.array(got[at : at + k * k]).reshape(k, k)
            meat += (1.0 - step / (lag + 1.0)) * (gamma + gamma.T)
            at += k * k
        return meat

    def _bartlett_series(self, by_time: DataFrame, lag: int, most: int = 2_000_000) -> np.ndarray:
        """Lags of a series of one row a time; the series is numbered without a single-task window."""
        cols = [f"g{j}" for j in range(self.k)]
        size = by_time.count()
        if size <= most:  # a bounded series: its products need no shuffle
            s = by_time.orderBy("__t").select(*cols).toPandas().to_numpy(float)
            meat = s.T @ s
            for step in range(1, min(lag, len(s) - 1) + 1):
                gamma = s[step:].T @ s[:-step]
                meat += (1.0 - step / (lag + 1.0)) * (gamma + gamma.T)
            return meat
        # ranges of time, each sorted; a row's number is that in its range and the sizes of the ranges before
        ranged = by_time.repartitionByRange("__t").sortWithinPartitions("__t").select(F.monotonically_increasing_id().alias("id"), *cols)
        ranged = cut(ranged, "series")  # written: the numbers stay
        part, own = F.shiftrightunsigned("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())  # a row a range
        starts = by_time.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "p long, start long")
        numbered = ranged.join(F.broadcast(starts), part == F.col("p")).select((own + F.col("start")).alias("at"), *cols)
        out = numbered
        for step in range(1, lag + 1):
            out = out.join(numbered.select((F.col("at") + step).alias("at"), *[F.col(c).alias(f"l{step}_{j}") for j, c in enumerate(cols)]), "at", "left")
        return self._weighted_lags(out, lag)

    # --- inference -------------------------------------------------------------

    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.V), 0.0))

    def coef(self) -> pd.Series:
        return pd.Series(self.beta, index=self.coefnames, name="Estimate")

    def tstat(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.beta / self.se()

    def _p(self, t: float) -> float:
        return 2 * (dist.norm_sf(abs(t)) if self.normal_inference else dist.t_sf(abs(t), self.df_t))

    def _crit(self, alpha: float) -> float:
        return dist.norm_ppf(1 - alpha / 2) if self.normal_inference else dist.t_ppf(1 - alpha / 2, self.df_t)

    def pvalue(self) -> np.ndarray:
        return np.array([self._p(t) if np.isfinite(t) else np.nan for t in self.tstat()])

    def confint(self, alpha: float = 0.05, joint: bool = False, reps: int = 9999, seed: int | None = None) -> pd.DataFrame:
        """Intervals by coefficient; joint ones hold together, by a multiplier bootstrap."""
        crit = self._joint_crit(alpha, reps, seed) if joint else self._crit(alpha)
        half = crit * self.se()
        return pd.DataFrame({f"{alpha / 2 * 100:.1f}%": self.beta - half, f"{(1 - alpha / 2) * 100:.1f}%": self.beta + half}, index=self.coefnames)

    def _joint_crit(self, alpha: float, reps: int, seed: int | None) -> float:
        s = self.se()
        corr = self.V / np.outer(s, s)
        values, vectors = np.linalg.eigh(corr)
        root = vectors * np.sqrt(np.maximum(values, 0.0))
        draws = np.random.default_rng(seed).standard_normal((reps, len(s))) @ root.T
        return float(np.quantile(np.abs(draws).max(axis=1), 1 - alpha))

    def tidy(self, alpha: float = 0.05) -> pd.DataFrame:
        ci = self.confint(alpha).to_numpy()
        out = pd.DataFrame(
            {"Coefficient": self.coefnames, "Estimate": self.beta, "Std. Error": self.se(), "t value": self.tstat(), "Pr(>|t|)": self.pvalue(), f"{alpha / 2 * 100:.1f}%": ci[:, 0], f"{(1 - alpha / 2) * 100:.1f}%": ci[:, 1]}
        ).set_index("Coefficient")
        if self.sample is not None:
            out["Sample"] = f"{self.sample[0]} = {self.sample[1]}"
        return out

    def tidy_frame(self, alpha: float = 0.05) -> DataFrame:
        """The tidy table as a DataFrame: coefficient, estimate, std_error, t_value, p_value, ci_low, ci_high."""
        t = self.tidy(alpha)
        rows = [(n, *[float(v) for v in r[:6]]) for n, r in zip(t.index, t.to_numpy(), strict=True)]
        return self.frame.sparkSession.createDataFrame(rows, "coefficient string, estimate double, std_error double, t_value double, p_value double, ci_low double, ci_high double")

    def wald_test(self, R: np.ndarray | None = None, q: np.ndarray | float | None = None, distribution: str = "F") -> pd.Series:
        """Wald test of R beta = q."""
        r = np.eye(self.k) if R is None else np.atleast_2d(np.asarray(R, float))
        q = np.zeros(len(r)) if q is None else np.broadcast_to(np.asarray(q, float), (len(r),))
        diff = r @ self.beta - q
        stat = float(diff @ np.linalg.pinv(r @ self.V @ r.T) @ diff)
        dfd = min(self.G) - 1 if self.G else self.n - self.k - sum(self.k_fe)
        if distribution == "F":
            return pd.Series({"statistic": stat / len(r), "pvalue": dist.f_sf(stat / len(r), len(r), dfd), "dfn": len(r), "dfd": dfd})
        return pd.Series({"statistic": stat, "pvalue": dist.chi2_sf(stat, len(r)), "dfn": len(r), "dfd": np.nan})

    # --- fit statistics --------------------------------------------------------

    @property
    def rmse(self) -> float:
        return math.sqrt(self.rss / self.n)

    def _r2(self) -> dict[str, float]:
        k_fe = sum(k - 1 for k in self.k_fe) + 1 if self.k_fe else 0
        out = {"r2": 1 - self.rss / self.tss if self.tss > 0 else float("nan")}
        lost = 0 if self.design.spec.get("drop_intercept") else 1
        out["adj_r2"] = 1 - (1 - out["r2"]) * (self.n - lost) / (self.n - self.k - k_fe)
        if self.k_fe:
            out["r2_within"] = 1 - self.rss / self.tss_within if self.tss_within > 0 else float("nan")
            out["adj_r2_within"] = 1 - (1 - out["r2_within"]) * (self.n - k_fe) / (self.n - self.k - k_fe)
        return out

    def __getattr__(self, name: str):
        if name in ("r2", "adj_r2", "r2_within", "adj_r2_within"):
            return self._r2().get(name, float("nan"))
        raise AttributeError(name)

    # --- rows for users --------------------------------------------------------

    def resid(self) -> DataFrame:
        """The user's columns with the residual (of the unweighted outcome) as resid."""
        rows = self.score_rows()
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")], F.col("__u").alias("resid"))

    @cached_property
    def _effect_levels(self) -> list[tuple[str, DataFrame, float]]:
        """By effect: its name, (level, coefficient), and what was moved to the first effect."""
        out, moved = [], 0.0
        for i, (name, table) in enumerate(zip(self.design.fe, self.absorbed.levels, strict=True)):
            value = F.col("a0") - _linear([F.col(f"a{j}") for j in self.x_at], self.slopes)
            t = table.select(F.col("__f").alias("level"), value.alias("coefficient"))
            base = 0.0
            if i:
                base = t.orderBy("level").first()[1]
                t = t.withColumn("coefficient", F.col("coefficient") - F.lit(base))
                moved += base
            out.append((name, t))
        shift = float(self.centre[0] - self.centre[self.x_at] @ self.slopes) + moved
        if out:
            name, t = out[0]
            out[0] = (name, t.withColumn("coefficient", F.col("coefficient") + F.lit(shift)))
        return out

    def fixef(self) -> DataFrame:
        """variable, level, coefficient; the first level of the second and later effects is zero."""
        parts = [t.select(F.lit(n).alias("variable"), F.col("level").cast("string").alias("level"), "coefficient") for n, t in self._effect_levels]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def _linear_predictor(self, newdata: DataFrame | None, se: bool = False) -> tuple[DataFrame, Column, list[Column]]:
        d = self.design
        data = self.frame.select(*[F.col(f"`{c}`") for c in self.data.columns]) if newdata is None else newdata
        spec = {k: v for k, v in d.spec.items() if k in ("offset", "drop_intercept", "context")}
        rows, names = project(d.formula, data, d.state, weights=None, fitted=True, with_y=False, **spec)
        by_name = dict(zip(names["x"], [f"__x{i}" for i in range(len(names["x"]))], strict=True)) | dict(zip(names["e"], [f"__e{i}" for i in range(len(names["e"]))], strict=True))
        x = [F.col(by_name[n]) for n in self.coefnames]
        out = _linear(x, self.beta)
        for i, (_, t) in enumerate(self._effect_levels):
            rows = rows.join(t.select(F.col("level").alias(f"__l{i}"), F.col("coefficient").alias(f"__c{i}")), F.col(f"__f{i}") == F.col(f"__l{i}"), "left")
            out = out + F.col(f"__c{i}")
        return rows, out, x

    def predict(self, newdata: DataFrame | None = None, type: str = "link", se_fit: bool = False, interval: str | None = None, alpha: float = 0.05) -> DataFrame:
        """The rows with fit, and with se_fit and ci_low/ci_high on demand; levels never seen give null."""
        rows, fit, x = self._linear_predictor(newdata)
        user = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")]
        cols = [self._respond(fit, type).alias("fit")]
        if se_fit or interval:
            if self.design.fe or self.design.weighted:
                raise VcovTypeNotSupportedError("prediction errors need a model without fixed effects and weights")
            var = _quadratic(x, self.V)
            cols.append(F.sqrt(var).alias("se_fit"))
            if interval == "prediction":
                half = F.lit(dist.t_ppf(1 - alpha / 2, self.n - self.k)) * F.sqrt(var + F.lit(self.rss / (self.n - self.k)))
                cols += [(fit - half).alias("ci_low"), (fit + half).alias("ci_high")]
        return rows.select(*user, *cols)

    def _respond(self, link: Column, kind: str) -> Column:
        return link

    # --- instruments -----------------------------------------------------------

    def first_stage(self) -> LinearModel:
        """The endogenous variable on the instruments and covariates, with the same covariance."""
        if not self.is_iv:
            raise ValueError("the model has no instruments")
        f = self.formula
        stage = type(f)(f.text, f.endogenous[0][0], f.exogenous + f.instruments, f.intercept, f.fixed_effects)
        data = self.frame.select(*[F.col(f"`{c}`") for c in self.data.columns])
        m = LinearModel(build(stage, data, weights=self.design.spec["weights"], context=self.design.spec["context"]), data, self.options)
        return m.vcov(self.vcov_type, self.vcov_kwargs)

    def iv_diag(self) -> dict[str, float]:
        """First-stage F on the excluded instruments, and the effective F of Olea and Pflueger."""
        m = self.first_stage()
        names = [n for n in self.design.z_names if n in m.coefnames]
        at = [m.coefnames.index(n) for n in names]
        r = np.eye(m.k)[at]
        f = m.wald_test(r)
        m.vcov("hetero" if self.vcov_type == "iid" else self.vcov_type)
        # second moments of the instruments, the covariates partialled out
        pos = [self.names_all.index(z) for z in self.design.z if self.design.z_names[int(z[3:])] in names]
        exo = [i for i in self.x_at if self.names_all[i].startswith("__x")]
        q = self.gram[np.ix_(pos, pos)]
        if len(exo):
            q = q - self.gram[np.ix_(pos, exo)] @ spd_inverse(self.gram[np.ix_(exo, exo)]) @ self.gram[np.ix_(exo, pos)]
        pi = m.beta[at]
        effective = float(pi @ q @ pi / np.trace(m.V[np.ix_(at, at)] @ q))
        return {"f_stat": float(f["statistic"]), "p_value": float(f["pvalue"]), "effective_f": effective}
