"""Quantile regression: interior point on the driver, preprocessing on the cluster.

Most rows' residual signs are known from a good first guess. Rows far below or above
the guess are summed into two rows that act alike while their signs hold; only the
band between is gathered and solved exactly. Signs are then checked over all rows,
and rows found on the wrong side join the band. The band grows like n to the power
2/3, so it fits a driver for very large n; below ``direct_rows`` all rows are the band.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NonConvergenceError, VcovTypeNotSupportedError
from ..functions import distributions as dist
from ..plans.design import Design, build
from ..plans.formula import Formula
from .model import LinearModel, Options, _linear
from .moments import product_sums, square
from .ols import Ssc, independent_columns, spd_inverse

DIRECT_ROWS = 50_000
DIRECT_VALUES = 10_000_000  # rows times columns that the driver gathers at most


def interior_point(x: np.ndarray, y: np.ndarray, tau: float, tol: float = 1e-9, max_iter: int = 200) -> np.ndarray:
    """Coefficients that minimise the check loss: predictor-corrector steps on the bounded dual.

    The dual maximises y'a subject to x'a = x'(1 - tau), 0 <= a <= 1. The multipliers of
    the equality are the coefficients; z and w are those of the two bounds.
    """
    scale = np.sqrt((x * x).mean(axis=0))
    scale[scale == 0] = 1.0
    spread = float(np.std(y)) or 1.0
    xs, ys = x / scale, y / spread
    n, k = xs.shape
    a = np.full(n, 1.0 - tau)
    s = 1.0 - a
    b = xs.sum(axis=0) * (1.0 - tau)
    d = -np.linalg.lstsq(xs, ys, rcond=None)[0]
    r = -ys - xs @ d
    r = np.where(r == 0, 1e-3, r)
    z, w = np.maximum(r, 0) + 1e-2, np.maximum(-r, 0) + 1e-2
    for _ in range(max_iter):
        gap = float(a @ z + s @ w)
        if gap < tol * (1.0 + abs(float(ys @ a))):
            break
        dual, primal = -ys - xs @ d - z + w, b - xs.T @ a
        q = 1.0 / (z / a + w / s)
        m = xs.T @ (q[:, None] * xs)

        def direction(t1, t2, dual=dual, primal=primal, q=q, m=m):
            """Step for target products: a dz + z da = t1, s dw - w da = t2."""
            rho = dual - t1 / a + t2 / s
            dd = np.linalg.solve(m, primal + xs.T @ (q * rho))
            da = q * (xs @ dd - rho)
            return dd, da, (t1 - z * da) / a, (t2 + w * da) / s

        def reach(v, dv):
            neg = dv < 0
            return min(1.0, 0.9995 * float(np.min(-v[neg] / dv[neg]))) if neg.any() else 1.0

        dd, da, dz, dw = direction(-a * z, -s * w)
        p, u = min(reach(a, da), reach(s, -da)), min(reach(z, dz), reach(w, dw))
        after = float((a + p * da) @ (z + u * dz) + (s - p * da) @ (w + u * dw))
        mu = (after / gap) ** 2 * after / (2 * n)
        dd, da, dz, dw = direction(mu - a * z - da * dz, mu - s * w + da * dw)
        p, u = min(reach(a, da), reach(s, -da)), min(reach(z, dz), reach(w, dw))
        a, s = a + p * da, s - p * da
        d, z, w = d + u * dd, z + u * dz, w + u * dw
    else:
        raise NonConvergenceError("the interior point method did not converge")
    return _polish(xs, ys, -d, tau) * spread / scale


def _polish(x: np.ndarray, y: np.ndarray, beta: np.ndarray, tau: float) -> np.ndarray:
    """The vertex next to the interior solution: exact where k residuals are all but zero."""
    k = x.shape[1]
    r = np.abs(y - x @ beta)
    near = np.argsort(r, kind="stable")[: 3 * k]
    chosen: list[int] = []
    for i in near:
        if np.linalg.matrix_rank(x[[*chosen, i]]) > len(chosen):
            chosen.append(int(i))
        if len(chosen) == k:
            vertex = np.linalg.solve(x[chosen], y[chosen])
            loss = lambda v: float(np.sum(np.where(v >= 0, tau * v, (tau - 1) * v)))
            return vertex if loss(y - x @ vertex) <= loss(y - x @ beta) else beta
    return beta


def bandwidth(tau: float, n: float, alpha: float = 0.05) -> float:
    """Hall and Sheather's bandwidth."""
    x0 = dist.norm_ppf(tau)
    return n ** (-1 / 3) * dist.norm_ppf(1 - alpha / 2) ** (2 / 3) * (1.5 * dist.norm_pdf(x0) ** 2 / (2 * x0 * x0 + 1)) ** (1 / 3)


def exact_quantiles(rows: DataFrame, value: Column, probs: list[float], few: int = 100_000, accuracy: int = 10_000) -> list[float]:
    """Interpolated quantiles, exact. Few values meet in one task; of more, sketches name a bracket for each rank, and only
    the brackets' values, counted, come to the driver."""
    rows = rows.select(value.alias("v")).where("v is not null")
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + s * 2 / accuracy))) for p in probs for s in (-1, 1)])
    n, bounds = rows.agg(F.count("v"), F.percentile_approx("v", edges, accuracy)).first()
    out: list[float] = []
    if n > few:
        pairs_of = [(bounds[2 * i], bounds[2 * i + 1]) for i in range(len(probs))]
        inside = reduce(lambda a, b: a | b, [(F.col("v") >= lo) & (F.col("v") <= hi) for lo, hi in pairs_of])
        below = rows.agg(*[F.count(F.when(F.col("v") < lo, 1)) for lo, _ in pairs_of]).first()
        held = rows.where(inside).groupBy("v").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("v")
        for p, (lo, hi), less in zip(probs, pairs_of, below, strict=True):
            own = held[(held["v"] >= lo) & (held["v"] <= hi)]
            last = less + own["n"].to_numpy().cumsum()
            rank = (n - 1) * p
            low, high = math.floor(rank), math.ceil(rank)
            if low < less or not len(last) or high >= last[-1]:
                break  # a sketch missed its rank
            a, b = (float(own["v"].to_numpy()[np.searchsorted(last, k, side="right")]) for k in (low, high))
            out.append(a + (rank - low) * (b - a))
    return out if len(out) == len(probs) else [float(v) for v in rows.agg(*[F.percentile("v", p) for p in probs]).first()]


class QuantileModel(LinearModel):
    """A fitted quantile regression."""

    method = "quantreg"

    def __init__(self, design: Design, data: DataFrame, options: Options, quantile: float, start: np.ndarray | None = None, direct_rows: int = DIRECT_ROWS, seed: int = 1):
        if not 0 < quantile < 1:
            raise ValueError("a quantile lies between 0 and 1")
        if design.fe or design.endog_names or design.weighted:
            raise ValueError("quantile regression takes no fixed effects, instruments or weights")
        self.quantile, self.start, self.direct_rows, self.seed = quantile, start, direct_rows, seed
        super().__init__(design, data, options)

    def _fit(self) -> None:
        d = self.design
        self.intercept, self.k_fe, self.names_all = False, [], ["__y", *d.x]
        x = [F.col(c) for c in d.x]
        got = list(self.frame.agg(F.count(F.lit(1)), F.stddev_pop("__y"), *product_sums(x)).first())
        self.n = self.n_rows = float(got[0])
        self.sigma_y = float(got[1] or 0.0)
        xx = square(got[2:], len(x))
        keep = np.flatnonzero(independent_columns(xx, self.options.collin_tol))
        self.collinear = [n for i, n in enumerate(d.x_names) if i not in set(keep.tolist())]
        self.x_at, self.coefnames = 1 + keep, [d.x_names[i] for i in keep]
        self.xx, self.k = xx[np.ix_(keep, keep)], len(keep)
        self.xc = [d.x[i] for i in keep]
        self.most_rows = max(self.direct_rows, DIRECT_VALUES // (self.k + 1))
        self.beta = self._solve_at(self.quantile, self.start)
        self.bread = spd_inverse(self.xx)
        self.rss = self.tss = float("nan")
        self.absorbed = None

    def _gather(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = rows.select("__y", *self.xc).toPandas().to_numpy(float)
        return t[:, 1:], t[:, 0]

    def _solve_at(self, tau: float, start: np.ndarray | None) -> np.ndarray:
        if self.n <= self.direct_rows:
            x, y = self._gather(self.frame)
            return interior_point(x, y, tau)
        k, n = self.k, self.n
        band = int(min(self.most_rows / 2, max(min(10_000.0, self.direct_rows / 2), 4 * (k ** (1 / 3)) * n ** (2 / 3))))
        if start is None:
            u = F.pmod(F.xxhash64("__y", *self.xc, F.lit(self.seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
            x, y = self._gather(self.frame.where(u < min(1.0, band / n)))
            start = interior_point(x, y, tau)
        beta = np.asarray(start, float)
        xc = [F.col(c) for c in self.xc]
        for _ in range(8):
            r = F.col("__y") - _linear(xc, beta)
            rows = self.frame.withColumn("__r", r)
            half = band / (2 * n)
            lo, hi = rows.agg(F.percentile_approx("__r", F.array(F.lit(max(0.0, tau - half)), F.lit(min(1.0, tau + half))), 10_000)).first()[0]
            x, y = self._gather(rows.where((F.col("__r") >= lo) & (F.col("__r") <= hi)))
            globs = rows.where((F.col("__r") < lo) | (F.col("__r") > hi)).groupBy((F.col("__r") < lo).alias("low")).agg(F.sum("__y"), *[F.sum(c) for c in xc]).collect()  # two rows
            gx = np.array([list(g[2:]) for g in globs], dtype=float).reshape(-1, k)
            gy = np.array([g[1] for g in globs], dtype=float)
            for _ in range(4):
                beta = interior_point(np.vstack([x, gx]), np.concatenate([y, gy]), tau)
                fresh = F.col("__y") - _linear(xc, beta)
                wrong = rows.where(((F.col("__r") < lo) & (fresh > 0)) | ((F.col("__r") > hi) & (fresh < 0)))
                bad = wrong.groupBy((F.col("__r") < lo).alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum("__y"), *[F.sum(c) for c in xc]).collect()
                count = sum(b.n for b in bad)
                if not count:
                    return beta
                if count > band:
                    break
                wx, wy = self._gather(wrong)  # they leave the sums and join the band; then the signs stay as they were cut
                for b in bad:
                    i = next(i for i, g in enumerate(globs) if g[0] == b[0])
                    gx[i] -= np.array(b[3:], dtype=float)
                    gy[i] -= b[2]
                x, y = np.vstack([x, wx]), np.concatenate([y, wy])
                rows = rows.where(~(((F.col("__r") < lo) & (fresh > 0)) | ((F.col("__r") > hi) & (fresh < 0))))
            band = int(min(2 * band, self.most_rows))
        raise NonConvergenceError("the preprocessing did not settle")

    # --- covariance ------------------------------------------------------------

    def vcov(self, vcov=None, vcov_kwargs=None, ssc: Ssc | None = None) -> QuantileModel:
        vcov = vcov or "nid"
        self.vcov_type, self.G, ssc = vcov, [], ssc or self.options.ssc
        tau, n = self.quantile, self.n
        h = bandwidth(tau, n)
        width = dist.norm_ppf(tau + h) - dist.norm_ppf(tau - h)
        u = F.col("__y") - _linear([F.col(c) for c in self.xc], self.beta)
        rows = self.frame.withColumn("__u", u)
        x = [F.col(c) for c in self.xc]
        if isinstance(vcov, dict):
            ((kind, cluster),) = vcov.items()
            if kind.upper() != "CRV1" or "+" in cluster:
                raise VcovTypeNotSupportedError("quantile regression clusters by CRV1 and one variable")
            self._cluster_checks([cluster], self.frame)
            (med,) = exact_quantiles(rows, F.col("__u"), [0.5])
            (kappa,) = exact_quantiles(rows, F.abs(F.col("__u") - F.lit(med)), [0.5])
            delta = kappa * width
            psi = F.lit(tau) - (F.col("__u") <= 0).cast("double")
            by = rows.groupBy(F.col(f"`{cluster}`")).agg(*[F.sum(psi * c).alias(f"g{j}") for j, c in enumerate(x)])
            got = list(by.agg(F.count(F.lit(1)), *product_sums([F.col(f"g{j}") for j in range(self.k)])).first())
            a = square(got[1:], self.k)
            b = square(rows.where(F.abs("__u") < delta).agg(*product_sums(x)).first(), self.k) / (2 * delta)
            inv = spd_inverse(b)
            g = int(got[0])
            adj, _, self.df_t = ssc.factor("CRV", n, self.k, 0, 0, groups=g)
            self.V, self.G, self.clusters = adj * inv @ a @ inv, [g], [cluster]
            return self
        adj, _, self.df_t = ssc.factor("hetero" if vcov != "iid" else "iid", n, self.k, 0, 0)
        if vcov in ("iid", "hetero"):
            q75, q25 = exact_quantiles(rows, F.abs("__u"), [0.75, 0.25])
            hk = min(self.sigma_y, (q75 - q25) / 1.34) * width
            f = float(rows.agg(F.sum((F.abs("__u") < hk).cast("double"))).first()[0]) / (2 * n * hk)
            self.V = adj * tau * (1 - tau) / f**2 * self.bread
        elif vcov == "nid":
            warm = self.beta if n > self.direct_rows else None
            up, down = self._solve_at(tau + h, warm), self._solve_at(tau - h, warm)
            di = _linear(x, up - down) - F.lit(math.sqrt(np.finfo(float).eps))
            f = F.when(di > 0, 2 * h / di).otherwise(0.0)
            inv = spd_inverse(square(self.frame.agg(*product_sums(x, f)).first(), self.k))
            self.V = adj * tau * (1 - tau) * inv @ self.xx @ inv
        else:
            raise VcovTypeNotSupportedError("quantile regression offers iid, hetero, nid and CRV1")
        return self

    def objective(self) -> float:
        u = F.col("__y") - _linear([F.col(c) for c in self.xc], self.beta)
        return float(self.frame.agg(F.sum(F.when(u >= 0, self.quantile * u).otherwise((self.quantile - 1) * u))).first()[0])


def quantreg(fml: str, data: DataFrame, quantile: float | list[float] = 0.5, vcov=None, method: str = "fn", multi_method: str = "cfm1", ssc: Ssc | None = None, collin_tol: float = 1e-9, drop_intercept: bool = False, context: dict | None = None, direct_rows: int | None = None, seed: int = 1):
    """Quantile regression at one quantile or several (a dict by quantile).

    method 'pfn' always preprocesses. For several quantiles 'cfm1' solves each, warm from its neighbour outward from
    the median; 'cfm2' takes one Newton-like step from the neighbour instead.
    """
    if method not in ("fn", "pfn") or multi_method not in ("cfm1", "cfm2"):
        raise ValueError("method is fn or pfn; multi_method is cfm1 or cfm2")
    formulas = Formula.parse(fml)
    if len(formulas) > 1:
        raise ValueError("stepwise formulas are not available for quantile regression")
    direct = direct_rows if direct_rows is not None else (DIRECT_ROWS if method == "fn" else 50_000)
    design = build(formulas[0], data, drop_intercept=drop_intercept, context=context)
    design.frame = design.frame.persist()
    options = Options(ssc or Ssc(), collin_tol=collin_tol)
    many = sorted(quantile) if isinstance(quantile, (list, tuple, np.ndarray)) else [quantile]
    middle = min(many, key=lambda q: abs(q - 0.5))
    out: dict[float, QuantileModel] = {middle: QuantileModel(design, data, options, middle, None, direct, seed)}
    for side in ([q for q in many if q > middle], [q for q in reversed(many) if q < middle]):
        last = out[middle]
        for q in side:
            start = last.beta if direct < last.n else None
            model = QuantileModel.__new__(QuantileModel) if multi_method == "cfm2" else QuantileModel(design, data, options, q, start, direct, seed)
            if multi_method == "cfm2":
                model.__dict__.update(last.__dict__)
                model.quantile, model.beta = q, _one_step(last, q)
            out[q] = last = model
    for m in out.values():
        m.vcov(vcov)
    return out[many[0]] if not isinstance(quantile, (list, tuple, np.ndarray)) else {q: out[q] for q in many}


def _one_step(model: QuantileModel, tau: float) -> np.ndarray:
    """One step from a neighbouring quantile: the density-weighted Gram against the mean check derivative."""
    x = [F.col(c) for c in model.xc]
    u = F.col("__y") - _linear(x, model.beta)
    rows = model.frame.withColumn("__u", u)
    q75, q25 = exact_quantiles(rows, F.abs("__u"), [0.75, 0.25])
    h = bandwidth(model.quantile, model.n)
    hk = min(model.sigma_y, (q75 - q25) / 1.34) * (dist.norm_ppf(model.quantile + h) - dist.norm_ppf(model.quantile - h))
    inside = (F.abs("__u") < hk).cast("double") / (2 * hk)
    j = square(rows.agg(*product_sums(x, inside)).first(), model.k)
    s = np.array(rows.agg(*[F.sum((F.lit(tau) - (F.col("__u") <= 0).cast("double")) * c) for c in x]).first(), dtype=float)
    return model.beta + spd_inverse(j) @ s


def process_frame(models: dict[float, QuantileModel], alpha: float = 0.05) -> pd.DataFrame:
    """quantile, Coefficient and the tidy columns: what a quantile plot shows."""
    return pd.concat({q: m.tidy(alpha) for q, m in models.items()}, names=["quantile"]).reset_index()
