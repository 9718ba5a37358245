"""Difference-in-differences: two-way fixed effects, two-stage, saturated and local projections."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..api import feols
from ..functions import distributions as dist
from ..plans.design import build, project
from ..plans.formula import Formula
from .absorb import solve_cells
from .model import LinearModel, Options, _linear
from .moments import product_sums, square
from .ols import Ssc, spd_inverse

NEVER = float("inf")


def did_columns(data: DataFrame, idname: str, tname: str, gname: str) -> DataFrame:
    """data with is_treated, first_treated_period (infinite for never treated) and rel_time; gname 0 or null: never."""
    t, g = F.col(f"`{tname}`").cast("double"), F.col(f"`{gname}`").cast("double")
    never = g.isNull() | (g == 0) | F.isnan(g)
    first = F.when(never, F.lit(NEVER)).otherwise(g)
    return data.withColumn("first_treated_period", first).withColumn("is_treated", (t >= F.col("first_treated_period")).cast("int")).withColumn("rel_time", t - F.col("first_treated_period"))


def first_treated(data: DataFrame, idname: str, tname: str, treat: str) -> DataFrame:
    """data with the first period in which its unit is treated; null where there is none."""
    w = Window.partitionBy(F.col(f"`{idname}`"))
    return data.withColumn("first_treated_period", F.min(F.when(F.col(f"`{treat}`").cast("int") == 1, F.col(f"`{tname}`"))).over(w))


def event_study(data: DataFrame, yname: str, idname: str, tname: str, gname: str, xfml: str | None = None, cluster: str | None = None, estimator: str = "twfe", att: bool = True, weights: str | None = None, max_cells: int | None = None):
    """An event study by one of twfe, did2s, saturated."""
    for c in (yname, idname, tname, gname, cluster or idname):
        if c not in data.columns:
            raise ValueError(f"no column {c!r} in the data")
    cluster = cluster or idname
    df = did_columns(data, idname, tname, gname)
    extra = f" + {xfml}" if xfml else ""
    if estimator == "twfe":
        main = "is_treated" if att else "i(rel_event, ref=-1.0)"
        if not att:  # never-treated rows have no event time: the reference cell
            df = df.withColumn("rel_event", F.when(F.abs(F.col("rel_time")) == NEVER, F.lit(-1.0)).otherwise(F.col("rel_time")))
        return feols(f"{yname} ~ {main}{extra} | {idname} + {tname}", df, vcov={"CRV1": cluster}, weights=weights, max_cells=max_cells)
    if estimator == "did2s":
        df = df.withColumn("rel_event", F.when(F.abs(F.col("rel_time")) == NEVER, F.lit(-1.0)).otherwise(F.col("rel_time")))
        second = "~ is_treated" if att else "~ i(rel_event, ref=-1.0)"
        return did2s(df, yname, f"~ {xfml or '0'} | {idname} + {tname}", second, "is_treated", cluster, weights, max_cells)
    if estimator == "saturated":
        return SaturatedEventStudy(df, yname, idname, tname, xfml, cluster)
    raise ValueError("estimator is twfe, did2s or saturated")


# --- two stages -----------------------------------------------------------------


def did2s(data: DataFrame, yname: str, first_stage: str, second_stage: str, treatment: str, cluster: str, weights: str | None = None, max_cells: int | None = None) -> LinearModel:
    """Two-stage estimator: effects from untreated rows, then the treatment on what they leave; errors account for both stages."""
    one = feols(f"{yname} {first_stage}", data.where(~F.col(f"`{treatment}`").cast("boolean")), weights=weights, fixef_rm="none", max_cells=max_cells)
    if not isinstance(one, LinearModel):
        raise ValueError("stepwise formulas are not available in the two stages")
    rows, fit, _ = one._linear_predictor(data)
    rows = rows.withColumn("resid_first", F.col(f"`{yname}`").cast("double") - fit)
    lost = rows.where(F.col("resid_first").isNull() & F.col(f"`{yname}`").isNotNull()).limit(1).count()
    if lost:
        raise ValueError("the first stage has levels that only treated rows have")
    user = [F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")]
    frame = rows.select(*user)
    two_formula = Formula.parse(f"resid_first {second_stage}")[0]
    two = LinearModel(build(two_formula, frame, weights=weights, drop_intercept=True), frame, Options(Ssc(), fixef_rm="none"))
    two.vcov("iid")
    two.V, two.G = _two_stage_vcov(one, two, data, frame, treatment, cluster)
    two.V = 0.5 * (two.V + two.V.T)
    two.df_t, two.vcov_type, two.clusters = two.G[0] - 1, {"CRV1": cluster}, [cluster]
    return two


def _two_stage_vcov(one: LinearModel, two: LinearModel, data: DataFrame, frame: DataFrame, treatment: str, cluster: str) -> tuple[np.ndarray, list[int]]:
    """Sandwich of the joint moment conditions; the first stage's indicators are solved over levels, on the driver or by groups, never laid out."""
    d, k = one.design, two.k
    # both designs over all rows: first-stage columns from its formula, second-stage columns from its own
    rows, names = project(d.formula, frame, d.state, fitted=True, with_y=False, context=d.spec.get("context"))
    x1 = [f"__x{names['x'].index(n)}" for n in one.coefnames]
    second, names2 = project(two.formula, rows.withColumnsRenamed({c: c.replace("__", "a_") for c in rows.columns if c.startswith("__")}), two.design.state, fitted=True, drop_intercept=True)
    x1 = [c.replace("__", "a_") for c in x1]
    f1 = [f"a_f{i}" for i in range(len(d.fe))]
    x2 = [F.col(f"__x{names2['x'].index(n)}") for n in two.coefnames]
    w = F.col(f"`{d.spec['weights']}`").cast("double") if d.weighted else F.lit(1.0)
    free = (~F.col(f"`{treatment}`").cast("boolean")).cast("double")
    cols1 = [F.col(c) for c in x1]
    # normal matrix of the untreated rows and right-hand sides over all rows, by cells of the effects
    sums = [F.sum(w * free).alias("w0"), *[F.sum(w * free * c).alias(f"p{j}") for j, c in enumerate(cols1)], *[F.sum(w * v).alias(f"b{m}") for m, v in enumerate(x2)]]
    total = [F.sum(w * free * a * b) for i, a in enumerate(cols1) for b in cols1[i:]] + [F.sum(w * a * v) for a in cols1 for v in x2]
    q = len(cols1)
    got = list(second.agg(F.lit(0.0), *total).first())[1:]
    xx = square(got[: q * (q + 1) // 2], q)
    bx = np.array(got[q * (q + 1) // 2 :], dtype=float).reshape(q, k) if q else np.zeros((0, k))
    if f1:
        cells = second.groupBy(*f1).agg(*sums).persist()
        o = one.options
        found = solve_cells(cells, f1, "w0", [*[f"p{j}" for j in range(q)], *[f"b{m}" for m in range(k)]], o.tol, o.max_iter, max(0, o.max_cells))
        cells.unpersist()
        if found is None:
            raise ValueError("too many levels of the smaller effects for the two-stage covariance")
        gx = spd_inverse(xx - found.cross[:q, :q]) @ (bx - found.cross[:q, q:]) if q else np.zeros((0, k))
        rows2 = second
        for i, (f, table) in enumerate(zip(f1, found.levels, strict=True)):  # the solution for x2 less what the covariates take
            made = [(F.col(f"a{q + m}") - _linear([F.col(f"a{j}") for j in range(q)], gx[:, m])).alias(f"g{i}_{m}") for m in range(k)]
            rows2 = rows2.join(table.select(F.col("__f").alias(f"lv{i}"), *made), F.col(f) == F.col(f"lv{i}"), "inner")
    else:
        gx, rows2 = spd_inverse(xx) @ bx, second
    u2 = F.col("__y") - _linear(x2, two.beta)
    u1 = F.col("resid_first")
    score = []
    for m in range(k):
        back = _linear(cols1, gx[:, m]) if q else F.lit(0.0)
        for i in range(len(f1)):
            back = back + F.col(f"g{i}_{m}")
        score.append(w * (x2[m] * u2 - free * back * u1))
    by = rows2.groupBy(F.col(f"`{cluster}`")).agg(*[F.sum(s).alias(f"s{m}") for m, s in enumerate(score)])
    got = list(by.agg(F.count(F.lit(1)), *product_sums([F.col(f"s{m}") for m in range(k)])).first())
    return two.bread @ square(got[1:], k) @ two.bread, [int(got[0])]


# --- saturated ------------------------------------------------------------------


class SaturatedEventStudy:
    """Cohort by event-time effects, and their share-weighted averages by event time."""

    def __init__(self, df: DataFrame, yname: str, idname: str, tname: str, xfml: str | None, cluster: str):
        treated = F.abs(F.col("rel_time")) != NEVER
        self.df = df.withColumn("rel_cell", F.when(treated, F.col("rel_time")).otherwise(-1.0)).withColumn("cohort_cell", F.when(treated, F.col("first_treated_period")).otherwise(0.0))
        got = self.df.where(treated).select("cohort_cell", "rel_cell").distinct().collect()  # cohorts times periods
        used = sorted((r.cohort_cell, r.rel_cell) for r in got if r.rel_cell != -1.0)
        self.shares = shares_by_period(self.df)
        self.names = {f"rel_time::{r}:first_treated_period::{c}": (c, r) for c, r in used}
        columns = {f"c_{i}": ((F.col("cohort_cell") == c) & (F.col("rel_cell") == r)).cast("double") for i, (c, r) in enumerate(used)}
        frame = self.df.withColumns(columns)
        self.labels = dict(zip(columns, used, strict=True))
        extra = f" + {xfml}" if xfml else ""
        self.model = feols(f"{yname} ~ {' + '.join(columns)}{extra} | {idname} + {tname}", frame, vcov={"CRV1": cluster})

    def tidy(self) -> pd.DataFrame:
        t = self.model.tidy()
        names = {c: f"rel_time::{r}:first_treated_period::{g}" for c, (g, r) in self.labels.items()}
        return t.rename(index=names)

    def weights(self) -> dict[tuple[float, float], float]:
        """Share of each cohort among the rows of its event time."""
        return {(r.cohort, r.period): r.share for r in self.shares.collect()}  # cohorts times periods

    def aggregate(self, agg: str = "period", weighting: str = "shares", alpha: float = 0.05) -> pd.DataFrame:
        """Average effects by event time; inference is normal."""
        if agg != "period" or weighting != "shares":
            raise ValueError("aggregates are by period with shares")
        w, m, out = self.weights(), self.model, []
        at = {self.labels[n]: i for i, n in enumerate(m.coefnames) if n in self.labels}
        z = dist.norm_ppf(1 - alpha / 2)
        for r in sorted({r for _, r in at}):
            v = np.zeros(m.k)
            for (c, rr), i in at.items():
                if rr == r:
                    v[i] = w[c, r]
            v /= v.sum()
            est, se = float(v @ m.beta), float(np.sqrt(v @ m.V @ v))
            out.append((r, est, se, est / se, 2 * dist.norm_sf(abs(est / se)), est - z * se, est + z * se))
        return pd.DataFrame(out, columns=["period", "Estimate", "Std. Error", "t value", "Pr(>|t|)", f"{alpha / 2 * 100:.1f}%", f"{(1 - alpha / 2) * 100:.1f}%"]).set_index("period")

    def test_treatment_heterogeneity(self) -> pd.Series:
        """Chi-squared test that cohorts have equal effects in each event time."""
        m, rows = self.model, []
        at: dict[float, list[int]] = {}
        for i, n in enumerate(m.coefnames):
            if n in self.labels:
                at.setdefault(self.labels[n][1], []).append(i)
        for same in at.values():
            for other in same[1:]:
                r = np.zeros(m.k)
                r[same[0]], r[other] = 1, -1
                rows.append(r)
        return m.wald_test(np.array(rows), distribution="chi2")


# --- local projections ----------------------------------------------------------


def _own(idname: str, tname: str) -> Window:
    return Window.partitionBy(F.col(f"`{idname}`")).orderBy(F.col(f"`{tname}`"))


def switched(df: DataFrame, yname: str, idname: str, tname: str) -> DataFrame:
    """df (from did_columns) with the outcome before (lp_lag) and whether treatment begins (treat_diff, null in a unit's first row)."""
    w, d = _own(idname, tname), F.col("is_treated")
    before = F.lag(d, 1).over(w)
    return df.select("*", F.lag(F.col(f"`{yname}`").cast("double"), 1).over(w).alias("lp_lag"), F.when(before.isNotNull(), F.greatest(d - before, F.lit(0))).alias("treat_diff"))


def horizon(rows: DataFrame, yname: str, idname: str, tname: str, h: int) -> DataFrame:
    """Rows (from switched) that begin treatment, or are clean controls h periods on, with the long difference lp_dy."""
    w, y, d = _own(idname, tname), F.col(f"`{yname}`").cast("double"), F.col("is_treated")
    there, far = (F.lead(y, h).over(w), F.lead(d, h).over(w)) if h >= 0 else (F.lag(y, -h).over(w), d)
    return rows.withColumn("lp_dy", there - F.col("lp_lag")).withColumn("lp_far", far).where("treat_diff = 1 or lp_far = 0")


def lpdid(data: DataFrame, yname: str, idname: str, tname: str, gname: str, att: bool = True, pre_window: int | None = None, post_window: int | None = None, xfml: str | None = None, cluster: str | None = None) -> pd.DataFrame:
    """Effects by horizon: long differences of the outcome on the change of treatment among clean controls, with period effects."""
    cluster = cluster or idname
    df = did_columns(data, idname, tname, gname)
    t = F.col(f"`{tname}`")
    if pre_window is None or post_window is None:
        r = df.where(F.abs(F.col("rel_time")) != NEVER).agg(F.min("rel_time"), F.max("rel_time")).first()
        pre_window = int(-r[0]) if pre_window is None else pre_window
        post_window = int(r[1]) if post_window is None else post_window
    w, y, d = _own(idname, tname), F.col(f"`{yname}`").cast("double"), F.col("is_treated")
    base = switched(df, yname, idname, tname)
    extra, out = f" + {xfml}" if xfml else "", []

    def fit(rows: DataFrame, label) -> None:
        m = feols(f"lp_dy ~ treat_diff{extra} | {tname}", rows, vcov={"CRV1": cluster}, fixef_rm="none")
        row = m.tidy().loc["treat_diff"].to_dict()
        out.append({"Coefficient": label, **row, "N": m.n})

    if att:
        ahead = w.rowsBetween(0, post_window)
        mean = F.when(F.count(y).over(ahead) == post_window + 1, F.avg(y).over(ahead))
        rows = base.withColumn("lp_dy", mean - F.col("lp_lag")).withColumn("lp_far", F.lead(d, post_window).over(w)).where("treat_diff = 1 or lp_far = 0")
        fit(rows, "ATT")
    else:
        for h in range(0, post_window + 1):
            fit(horizon(base, yname, idname, tname, h), f"time_to_treatment::{h}")
        for h in range(2, pre_window + 1):
            fit(horizon(base, yname, idname, tname, -h), f"time_to_treatment::{-h}")
    return pd.DataFrame(out).set_index("Coefficient")


# --- frames for plots -------------------------------------------------------------


def panelview(data: DataFrame, unit: str, time: str, treat: str, outcome: str | None = None, sort_by_timing: bool = False, subsamp: int | None = None, collapse_to_cohort: bool = False, seed: int = 1) -> DataFrame:
    """The frame of a panel view: a row a unit, a column a period, with treatment (or the outcome); by cohort its mean outcome."""
    u, t = F.col(f"`{unit}`"), F.col(f"`{time}`")
    if collapse_to_cohort:
        df = first_treated(data, unit, time, treat)
        return df.groupBy("first_treated_period", t.alias(time)).agg(F.avg(F.col(f"`{outcome}`")).alias("mean_outcome"))
    if subsamp:
        picked = data.select(u).distinct().orderBy(F.xxhash64(u, F.lit(seed))).limit(subsamp)
        data = data.join(picked, unit, "left_semi")
    periods = [r[0] for r in data.select(t).distinct().orderBy(t).limit(2001).collect()]
    if len(periods) > 2000:
        raise ValueError("more than 2000 periods do not make columns")
    out = data.groupBy(u.alias(unit)).pivot(time, periods).agg(F.first(F.col(f"`{outcome or treat}`")))
    if sort_by_timing:
        first = first_treated(data, unit, time, treat).groupBy(u.alias(unit)).agg(F.first("first_treated_period").alias("first_treated_period"))
        out = out.join(first, unit).orderBy(F.col("first_treated_period").asc_nulls_last(), unit)
    return out


def shares_by_period(rows: DataFrame) -> DataFrame:
    """cohort, period, n, share of rows that did_columns made: ever-treated rows by cohort, as shares within the event time.

    Every cohort has every period; those without rows count zero.
    """
    n = rows.where(F.abs(F.col("rel_time")) != NEVER).groupBy(F.col("first_treated_period").alias("cohort"), F.col("rel_time").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    periods = [r[0] for r in n.select("period").distinct().orderBy("period").limit(4001).collect()]
    if len(periods) > 4000:
        raise ValueError("more than 4000 event times")
    grid = n.select("cohort").distinct().select("cohort", F.explode(F.lit(periods) if periods else F.array().cast("array<double>")).alias("period"))
    full = grid.join(n, ["cohort", "period"], "left").na.fill(0, ["n"])
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("period")))


def interaction_weights(data: DataFrame, idname: str, tname: str, gname: str) -> DataFrame:
    """cohort, period, n, share: treated rows after, ever-treated untreated rows before, as shares within the event time."""
    return shares_by_period(did_columns(data, idname, tname, gname))


__all__ = ["NEVER", "SaturatedEventStudy", "did2s", "did_columns", "event_study", "first_treated", "horizon", "interaction_weights", "lpdid", "panelview", "shares_by_period", "switched"]
