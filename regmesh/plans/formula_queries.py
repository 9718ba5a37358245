"""Queries of formula terms, samples, instruments, tables, inputs and input checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import _IV, _ONE, _TWO, _coefs, _items, _query, _rows, _t

_EST = "coefficient string, estimate double"


def _estimates(spark: SparkSession, m) -> DataFrame:
    return _rows(spark, [(n, round(float(b), 6)) for n, b in zip(m.coefnames, m.beta, strict=True)], _EST)


# --- terms --------------------------------------------------------------------------------

_CELLS = "WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice / 1000) AS my FROM lineitem GROUP BY 1) "


@_query(_CELLS + "SELECT 'Intercept' AS coefficient, round(my, 6) AS estimate FROM m WHERE f = 'A' UNION ALL SELECT 'C(l_returnflag)[T.' || f || ']', round(my - (SELECT my FROM m WHERE f = 'A'), 6) FROM m WHERE f <> 'A'")
def formula_c_factor(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _estimates(spark, feols("price ~ C(l_returnflag)", _items(spark, sf)))


@_query("WITH m AS (SELECT CASE WHEN l_linenumber IN (1, 2, 3) THEN 'low' WHEN l_linenumber IN (6, 7) THEN 'high' ELSE l_linenumber::VARCHAR END AS f, avg(l_extendedprice / 1000) AS my FROM lineitem GROUP BY 1) SELECT 'Intercept' AS coefficient, round(my, 6) AS estimate FROM m WHERE f = 'low' UNION ALL SELECT 'l_linenumber::' || f, round(my - (SELECT my FROM m WHERE f = 'low'), 6) FROM m WHERE f <> 'low'")
def formula_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Levels put together before they become indicators."""
    from ..api import feols

    return _estimates(spark, feols("price ~ i(l_linenumber, bin={'low': [1, 2, 3], 'high': [6, 7]}, ref='low')", _items(spark, sf)))


@_query("WITH m AS (SELECT l_returnflag AS a, l_linestatus AS b, avg(l_extendedprice / 1000) AS my FROM lineitem GROUP BY 1, 2) SELECT 'Intercept' AS coefficient, round(my, 6) AS estimate FROM m WHERE a = 'A' AND b = 'F' UNION ALL SELECT 'l_returnflag::' || a || ':l_linestatus::' || b, round(my - (SELECT my FROM m WHERE a = 'A' AND b = 'F'), 6) FROM m WHERE NOT (a = 'A' AND b = 'F')")
def formula_i_by_factor(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _estimates(spark, feols("price ~ i(l_returnflag, l_linestatus)", _items(spark, sf)))


@_query(
    """
WITH m AS (SELECT l_linestatus AS f, regr_slope(l_extendedprice / 1000, l_quantity) AS b, regr_intercept(l_extendedprice / 1000, l_quantity) AS a FROM lineitem GROUP BY 1), f AS (SELECT * FROM m WHERE f = 'F'), o AS (SELECT * FROM m WHERE f = 'O')
SELECT 'Intercept' AS coefficient, round(f.a, 6) AS estimate FROM f UNION ALL SELECT 'l_quantity', round(f.b, 6) FROM f
UNION ALL SELECT 'l_linestatus[T.O]', round(o.a - f.a, 6) FROM o, f UNION ALL SELECT 'l_quantity:l_linestatus[T.O]', round(o.b - f.b, 6) FROM o, f"""
)
def formula_interaction(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _estimates(spark, feols("price ~ l_quantity * l_linestatus", _items(spark, sf)))


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x FROM lineitem), c AS (SELECT y, x - (SELECT avg(x) FROM d) AS x FROM d),
     p AS (SELECT sum(x ^ 3) / sum(x * x) AS k, avg(x * x) AS v FROM c), q AS (SELECT y, x, x * x - k * x - v AS z FROM c, p)
SELECT 'poly(l_quantity, 2)[1]' AS coefficient, round(sum(x * y) / sqrt(sum(x * x)), 3) AS estimate FROM q UNION ALL SELECT 'poly(l_quantity, 2)[2]', round(sum(z * y) / sqrt(sum(z * z)), 3) FROM q"""
)
def formula_poly(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ poly(l_quantity, 2)", _items(spark, sf))
    return _rows(spark, [(n, round(float(b), 3)) for n, b in zip(m.coefnames, m.beta, strict=True) if n != "Intercept"], _EST)


_FUNCTIONS = {"sqrt": "sqrt(l_quantity)", "log1p": "ln(1 + l_quantity)", "exp": "exp(l_discount)", "abs": "abs(l_quantity - 25)", "log2": "log2(l_quantity)", "sign": "sign(l_quantity - 25)"}


@_query(" UNION ALL ".join(f"SELECT '{k}' AS function, round(regr_slope(l_extendedprice / 1000, {v}), 6) AS estimate FROM lineitem" for k, v in _FUNCTIONS.items()))
def formula_functions(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    terms = {"sqrt": "sqrt(l_quantity)", "log1p": "log1p(l_quantity)", "exp": "exp(l_discount)", "abs": "abs(l_quantity - 25)", "log2": "log2(l_quantity)", "sign": "sign(l_quantity - 25)"}
    d = _items(spark, sf)
    return _rows(spark, [(k, round(float(feols(f"price ~ {t}", d).beta[1]), 6)) for k, t in terms.items()], "function string, estimate double")


@_query("SELECT round(regr_slope(l_extendedprice / 1000, 2 * l_quantity), 6) AS estimate FROM lineitem")
def formula_context(spark: SparkSession, sf: str) -> DataFrame:
    """A function of the caller's own inside a formula."""
    from ..api import feols

    return _rows(spark, [(round(float(feols("price ~ twice(l_quantity)", _items(spark, sf), context={"twice": lambda c: 2 * c}).beta[1]), 6),)], "estimate double")


@_query("WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_returnflag || l_linestatus AS f FROM lineitem), c AS (SELECT y - avg(y) OVER (PARTITION BY f) AS y, x - avg(x) OVER (PARTITION BY f) AS x FROM d) SELECT 'l_quantity' AS coefficient, round(sum(x * y) / sum(x * x), 6) AS estimate, 6::BIGINT AS levels FROM c")
def legacy_crossed_effect(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity | l_returnflag^l_linestatus", _items(spark, sf))
    return _rows(spark, [(m.coefnames[0], round(float(m.beta[0]), 6), int(m.k_fe[0]))], "coefficient string, estimate double, levels long")


@_query("SELECT l_returnflag || '/' || y AS model, round(regr_slope(v, l_tax), 6) AS estimate FROM (SELECT l_returnflag, l_tax, 'price' AS y, l_extendedprice / 1000 AS v FROM lineitem UNION ALL SELECT l_returnflag, l_tax, 'l_quantity', l_quantity FROM lineitem) GROUP BY l_returnflag, y")
def several_outcomes_split(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    ms = feols("price + l_quantity ~ l_tax", _items(spark, sf), split="l_returnflag").to_list()
    return _rows(spark, [(f"{m.sample[1]}/{m.formula.depvar}", round(float(m.beta[1]), 6)) for m in ms], "model string, estimate double")


_STEPS = _TWO + """, s AS (SELECT 'l_quantity' AS x, round(s1y / s11, 6) AS estimate, 'one' AS k FROM e UNION ALL SELECT 'l_discount', round(s2y / s22, 6), 'one' FROM e UNION ALL SELECT 'l_quantity', round(b1, 6), 'both' FROM e UNION ALL SELECT 'l_discount', round(b2, 6), 'both' FROM e) """


def _steps(kind: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, 'price ~ {f}' AS fml, '{x}' AS coefficient, (SELECT estimate FROM s WHERE x = '{x}' AND k = '{k}') AS estimate" for f, x, k in rows)


_A, _B, _AB = ("l_quantity", "l_quantity", "one"), ("l_discount", "l_discount", "one"), [("l_quantity + l_discount", "l_quantity", "both"), ("l_quantity + l_discount", "l_discount", "both")]


@_query(_STEPS + " UNION ALL ".join([_steps("sw", [_A, _B]), _steps("sw0", [_A, _B]), _steps("csw0", [_A, *_AB]), _steps("mvsw", [_A, _B, *_AB])]))
def stepwise_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """sw, sw0, csw0 and mvsw expand to their models; the empty one has an intercept alone."""
    from ..api import feols

    d, out = _items(spark, sf), []
    for kind in ("sw", "sw0", "csw0", "mvsw"):
        for name, m in feols(f"price ~ {kind}(l_quantity, l_discount)", d).models.items():
            out += [(kind, name, n, round(float(b), 6)) for n, b in zip(m.coefnames, m.beta, strict=True) if n != "Intercept"]
    return _rows(spark, out, "kind string, fml string, coefficient string, estimate double")


# --- samples ----------------------------------------------------------------------------------


@_query("SELECT round(regr_slope(l_quantity, x), 6) AS estimate, count(*) AS n FROM (SELECT l_quantity, 1 / l_discount AS x FROM lineitem WHERE l_discount <> 0)")
def infinite_rows_drop(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    d = _items(spark, sf).withColumn("inv", F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(1 / F.col("l_discount")))
    m = feols("l_quantity ~ inv", d)
    return _rows(spark, [(round(float(m.beta[1]), 6), int(m.n))], "estimate double, n long")


@_query(_ONE + "SELECT 'l_quantity' AS kept, 'I(2 * l_quantity)' AS dropped, round(max(b), 6) AS estimate FROM r")
def collinear_drop(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity + I(2 * l_quantity)", _items(spark, sf))
    return _rows(spark, [(m.coefnames[1], m.collinear[0], round(float(m.beta[1]), 6))], "kept string, dropped string, estimate double")


@_query("SELECT l_suppkey, round(var_pop(l_extendedprice / 1000), 6) AS mean_square FROM lineitem GROUP BY 1")
def empty_model_resid(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ 1 | l_suppkey", _items(spark, sf))
    return m.resid().groupBy("l_suppkey").agg(F.round(F.avg(F.col("resid") * F.col("resid")), 6).alias("mean_square"))


@_query("SELECT 2::BIGINT AS unseen, (SELECT round(avg(l_extendedprice / 1000), 6) FROM lineitem WHERE l_returnflag = 'N') AS fit")
def predict_new_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Levels that the model has not seen give null, others their coefficient."""
    from ..api import feols

    m = feols("price ~ 1 | l_returnflag", _items(spark, sf))
    new = spark.createDataFrame([("N",), ("X",), ("Y",)], "l_returnflag string")
    return m.predict(new).agg(F.sum(F.col("fit").isNull().cast("int")).alias("unseen"), F.round(F.max("fit"), 6).alias("fit"))


@_query(_ONE + ", v AS (SELECT sum(u * u) / (max(n) - 2) AS s2 FROM r) SELECT l_linenumber, round(avg(sqrt(s2 * (1.0 / n + xc * xc / sxx))), 8) AS se_fit FROM r, v GROUP BY 1")
def predict_errors(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity", _items(spark, sf))
    return m.predict(se_fit=True).groupBy("l_linenumber").agg(F.round(F.avg("se_fit"), 8).alias("se_fit"))


_SEPARATED = "(0, 1.0, 0), (0, 2.0, 0), (1, 0.0, 0), (2, 0.0, 0), (3, 0.0, 0), (0, 0.0, 0), (0, 1.0, 1), (0, 2.0, 1), (1, 0.0, 1), (2, 0.0, 1), (3, 0.0, 1), (0, 0.0, 1)"


@_query(f"SELECT count(*) FILTER (WHERE x1 > 0) AS separated, count(*) FILTER (WHERE x1 = 0) AS kept FROM (VALUES {_SEPARATED}) t(y, x1, id1)")
def separation_rectifier(spark: SparkSession, sf: str) -> DataFrame:
    """A regressor that is positive only where the outcome is zero separates those rows."""
    from ..api import fepois

    m = fepois("y ~ x1 | id1", spark.sql(f"SELECT * FROM VALUES {_SEPARATED} AS t(y, x1, id1)"), separation_check=["ir"])
    return _rows(spark, [(int(m.n_separated), int(m.n_rows))], "separated long, kept long")


# --- instruments, quantiles, solvers -----------------------------------------------------------


@_query(
    _IV + """, r AS (SELECT z - mz AS zc, x - p0 - p * z AS u, p, szz, n FROM d, m)
SELECT round(max(p) ^ 2 * max(szz) ^ 2 * max(n) ^ 2 / (sum(zc * zc * u * u) * max(n) / (max(n) - 2)), 3) AS effective_f FROM r"""
)
def iv_effective_f(spark: SparkSession, sf: str) -> DataFrame:
    """With one instrument the effective F is the squared robust t of the first stage."""
    from ..api import feols

    d = _items(spark, sf).withColumn("z", F.col("l_quantity") + 100 * F.col("l_tax") + F.col("l_linenumber"))
    return _rows(spark, [(round(feols("price ~ 1 | l_quantity ~ z", d, vcov="hetero").iv_diag()["effective_f"], 3),)], "effective_f double")


@_query("WITH q AS (SELECT l_linestatus AS s, quantile_disc(l_extendedprice / 1000, 0.33337) AS v FROM lineitem GROUP BY 1) SELECT 'Intercept' AS coefficient, round(v, 6) AS estimate FROM q WHERE s = 'F' UNION ALL SELECT 'l_linestatus[T.O]', round(v - (SELECT v FROM q WHERE s = 'F'), 6) FROM q WHERE s = 'O'")
def quantile_two_groups(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quantreg import quantreg

    return _estimates(spark, quantreg("price ~ l_linestatus", _items(spark, sf), 0.33337, vcov="iid"))


@_query(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, round(quantile_disc(l_extendedprice / 1000, {q}), 6) AS estimate FROM lineitem" for q in (0.11113, 0.50003, 0.87773)))
def quantile_process(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quantreg import quantreg

    ms = quantreg("price ~ 1", _items(spark, sf), [0.11113, 0.50003, 0.87773], vcov="iid")
    return _rows(spark, [(q, round(float(m.beta[0]), 6)) for q, m in ms.items()], "quantile double, estimate double")


@_query(_TWO + "SELECT 'Intercept' AS coefficient, round(b0, 6) AS estimate FROM e UNION ALL SELECT 'l_quantity', round(b1, 6) FROM e UNION ALL SELECT 'l_discount', round(b2, 6) FROM e")
def ols_lstsq(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _estimates(spark, feols("price ~ l_quantity + l_discount", _items(spark, sf), solver="np.linalg.lstsq"))


@_query("SELECT 'Intercept' AS coefficient, round(regr_intercept(l_extendedprice / 1000, l_quantity), 6) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice / 1000, l_quantity), 6) FROM lineitem")
def update_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Rows added to a fitted model: its moments and those of the new rows."""
    from ..api import feols
    from ..streaming.update import update

    d = _items(spark, sf)
    beta = update(feols("price ~ l_quantity", d.where("l_suppkey % 3 <> 0")), d.where("l_suppkey % 3 = 0"))
    return _rows(spark, [(n, round(float(b), 6)) for n, b in zip(("Intercept", "l_quantity"), beta, strict=True)], _EST)


@_query("WITH w AS (SELECT l_extendedprice / 1000 AS y, l_discount AS x, l_linenumber AS k FROM lineitem), r AS (SELECT y, x FROM w, range(7) t(i) WHERE i < k) SELECT count(*)::DOUBLE AS n, round(regr_slope(y, x), 6) AS estimate, round(sqrt((regr_syy(y, x) - regr_sxy(y, x) ^ 2 / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 6) AS std_error FROM r")
def frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency weights stand for repeated rows."""
    from ..api import feols

    m = feols("price ~ l_discount", _items(spark, sf), weights="l_linenumber", weights_type="fweights")
    return _rows(spark, [(float(m.n), round(float(m.beta[1]), 6), round(float(m.se()[1]), 6))], "n double, estimate double, std_error double")


# --- tables and frames ---------------------------------------------------------------------------


@_query(
    _ONE + """, v AS (SELECT sum(u * u) / (max(n) - 2) AS s2, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx, max(a) AS a, max(b) AS b, 1 - sum(u * u) / sum((y - (SELECT avg(y) FROM d)) ^ 2) AS r2 FROM r)
SELECT line, printf('%.3f', b) || (CASE WHEN abs(b / se) > 3.2905 THEN '***' WHEN abs(b / se) > 2.5758 THEN '**' WHEN abs(b / se) > 1.96 THEN '*' ELSE '' END) || ' (' || printf('%.3f', se) || ')' AS cell
FROM (SELECT 'Age' AS line, b, sqrt(s2 / sxx) AS se FROM v UNION ALL SELECT 'Intercept', a, sqrt(s2 * (1.0 / n + mx * mx / sxx)) FROM v)
UNION ALL SELECT 'Observations', n::VARCHAR FROM v UNION ALL SELECT 'R2', printf('%.3f', r2) FROM v"""
)
def etable_cells(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..report import etable

    t = etable(feols("price ~ l_quantity", _items(spark, sf)), labels={"l_quantity": "Age"})
    return _rows(spark, [(k, str(t.loc[k].iloc[0])) for k in ("Age", "Intercept", "Observations", "R2")], "line string, cell string")


@_query(
    _TWO + """SELECT 'l_quantity' AS coefficient, 'Size' AS label, round(b1, 6) AS estimate, round(b1 - q * s1, 6) AS ci_low, round(b1 + q * s1, 6) AS ci_high FROM (
  SELECT *, sqrt(rss / (n - 3) / n * s22 / det) AS s1, 1.959963984540054 + 2.3722712 / (n - 3) AS q FROM e)"""
)
def coefplot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients picked by pattern, with labels and intervals."""
    from ..api import feols
    from ..report import coefplot_frame

    t = coefplot_frame(feols("price ~ l_quantity + l_discount", _items(spark, sf)), keep="^l_", drop="disc", labels={"l_quantity": "Size"})
    return _rows(spark, [(r.Coefficient, r.label, round(float(r.Estimate), 6), round(float(r.ci_low), 6), round(float(r.ci_high), 6)) for r in t.itertuples()], "coefficient string, label string, estimate double, ci_low double, ci_high double")


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_quantity * l_discount AS x2 FROM lineitem),
     m AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM d),
     b AS (SELECT s1y / s11 AS direct, s12 / s11 * (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS qd FROM m)
SELECT 'direct_effect' AS part, 0.0 AS start, round(direct, 6) AS stop FROM b UNION ALL SELECT 'qd', round(direct, 6), round(direct - qd, 6) FROM b UNION ALL SELECT 'unexplained_effect', 0.0, round(direct - qd, 6) FROM b"""
)
def decomposition_bars(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.decompose import decompose
    from ..report import decomposition_frame

    t = decomposition_frame(decompose(feols("price ~ l_quantity + qd", _items(spark, sf).withColumn("qd", F.col("l_quantity") * F.col("l_discount"))), "l_quantity"))
    return _rows(spark, [(r.part, round(float(r.start), 6), round(float(r.end), 6)) for r in t.itertuples()], "part string, start double, stop double")


@_query("SELECT source, n, round(s, 4) AS total FROM (SELECT 'pandas' AS source, count(*) AS n, sum(n_nationkey)::DOUBLE AS s FROM nation UNION ALL SELECT 'arrow', count(*), sum(n_nationkey) FROM nation UNION ALL SELECT 'parquet', count(*), sum(o_totalprice) FROM orders)")
def intake_frames(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import frames

    nation = _t(spark, sf, "nation")
    parts = [("pandas", frames.intake(spark, nation.toPandas()), "n_nationkey"), ("arrow", frames.intake(spark, nation.toArrow()), "n_nationkey"), ("parquet", frames.read_table(spark, f"{sf}/orders.parquet", columns=["o_totalprice"]), "o_totalprice")]
    out = [d.agg(F.lit(s).alias("source"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col(c).cast("double")), 4).alias("total")) for s, d, c in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@_query("SELECT * FROM (VALUES ('get_data', 500, 498, 499), ('gelbach_data', 300, 300, 300), ('get_bartik_data', 200, 200, 200)) t(generator, n, complete, outcomes)")
def generator_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, rows without nulls in the outcome and first regressor, and outcomes: the generators' promises."""
    from ..sources import generators as g

    parts = [("get_data", g.get_data(spark, 500), "Y", "X1"), ("gelbach_data", g.gelbach_data(spark, 300), "y", "x1"), ("get_bartik_data", g.get_bartik_data(spark, 200), "wages", "immigration")]
    out = [d.agg(F.lit(n).alias("generator"), F.count(F.lit(1)).cast("int").alias("n"), F.sum((F.col(y).isNotNull() & F.col(x).isNotNull()).cast("int")).cast("int").alias("complete"), F.count(y).cast("int").alias("outcomes")) for n, d, y, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- what the engine refuses ------------------------------------------------------------------------


@_query(
    """SELECT * FROM (VALUES ('binary outcome', 'DepvarOutsideDomainError'), ('count outcome', 'DepvarOutsideDomainError'), ('text outcome', 'DepvarIsNotNumericError'), ('weights', 'NonPositiveWeightsError'), ('null cluster', 'NanInClusterVarError'),
 ('HC2 with effects', 'VcovTypeNotSupportedError'), ('two endogenous', 'FormulaSyntaxError'), ('endogenous covariate', 'EndogVarsAsCovarsError'), ('instrument covariate', 'InstrumentsAsCovarsError'), ('unknown column', 'FormulaSyntaxError'), ('no rows', 'EmptySampleError')) t(input, error)"""
)
def refused_inputs(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm, feols, fepois
    from ..errors import RegmeshError

    d = _items(spark, sf).limit(500).withColumn("zero", F.lit(0.0)).withColumn("minus", -F.col("price")).withColumn("gap", F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))).withColumn("none", F.lit(None).cast("double")).cache()
    cases = {
        "binary outcome": lambda: feglm("price ~ l_tax", d, "logit"), "count outcome": lambda: fepois("minus ~ l_tax", d), "text outcome": lambda: feols("l_returnflag ~ l_tax", d), "weights": lambda: feols("price ~ l_tax", d, weights="zero"),
        "null cluster": lambda: feols("price ~ l_tax", d, vcov={"CRV1": "gap"}), "HC2 with effects": lambda: feols("price ~ l_tax | l_returnflag", d, vcov="HC2"), "two endogenous": lambda: feols("price ~ 1 | l_tax + l_discount ~ l_quantity", d),
        "endogenous covariate": lambda: feols("price ~ l_tax | l_tax ~ l_quantity", d), "instrument covariate": lambda: feols("price ~ l_quantity | l_tax ~ l_quantity", d), "unknown column": lambda: feols("price ~ nowhere", d), "no rows": lambda: feols("price ~ none", d),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "none"))
        except RegmeshError as e:
            out.append((name, type(e).__name__))
    d.unpersist()
    return _rows(spark, out, "input string, error string")


@_query("SELECT * FROM (VALUES (1, 0.25), (2, 0.75), (3, 0.75)) t(hypothesis, p_value)")
def step_down_values(spark: SparkSession, sf: str) -> DataFrame:
    """Romano-Wolf's step-down on three statistics and three draws: largest first, and never falling."""
    from ..operators.multiple import step_down_max_t

    p = step_down_max_t(np.array([3.0, 1.0, 0.5]), np.array([[1.0, 2.0, 0.1], [0.2, 0.1, 0.9], [0.1, 1.5, 0.2]]))
    return _rows(spark, [(i + 1, round(float(v), 6)) for i, v in enumerate(p)], "hypothesis int, p_value double")
