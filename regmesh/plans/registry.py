"""The engine's queries over the test tables, each with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return keep


def _replace_sql(name: str, sql: str) -> None:
    """SQL for a query that stands elsewhere."""
    _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the price in thousands."""
    return _t(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    clean = [tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)


def _coefs(spark: SparkSession, m, extra: list[tuple] | None = None) -> DataFrame:
    return _rows(spark, [(n, round(float(b), 6), round(float(s), 6)) for n, b, s in zip(m.coefnames, m.beta, m.se(), strict=True)], "coefficient string, estimate double, std_error double")


# shared SQL: y on one regressor, its coefficient, residuals and moments
_ONE = """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, * FROM lineitem),
     f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum((x - (SELECT avg(x) FROM d)) ^ 2) AS sxx FROM d),
     r AS (SELECT d.*, y - a - b * x AS u, x - mx AS xc, n, mx, a, b, sxx FROM d, f)
"""


def _one_tail(meat: str, factor: str) -> str:
    """Sandwich of slope and intercept from cluster sums g0 (of u) and g1 (of u * xc)."""
    return f"""
     , s AS ({meat})
     , v AS (SELECT {factor} * sum(g1 * g1) / max(sxx) ^ 2 AS vb,
                    {factor} * sum((g0 / n - mx / sxx * g1) ^ 2) AS va, max(a) AS a, max(b) AS b FROM s)
SELECT 'Intercept' AS coefficient, round(a, 6) AS estimate, round(sqrt(va), 6) AS std_error FROM v
UNION ALL SELECT 'l_quantity', round(b, 6), round(sqrt(vb), 6) FROM v"""


@_query(
    _ONE + """
     , v AS (SELECT sum(u * u) / (max(n) - 2) AS s2, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx, max(a) AS a, max(b) AS b FROM r)
SELECT 'Intercept' AS coefficient, round(a, 6) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 6) AS std_error FROM v
UNION ALL SELECT 'l_quantity', round(b, 6), round(sqrt(s2 / sxx), 6) FROM v"""
)
def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf)))


_TWO = """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_discount AS x2 FROM lineitem),
     m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, var_pop(y) AS syy FROM d),
     b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, s11 * s22 - s12 * s12 AS det FROM m),
     e AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS rss FROM b)
"""


@_query(
    _TWO + """
SELECT 'Intercept' AS coefficient, round(b0, 6) AS estimate, round(sqrt(rss / (n - 3) / n * (1 + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 6) AS std_error FROM e
UNION ALL SELECT 'l_quantity', round(b1, 6), round(sqrt(rss / (n - 3) / n * s22 / det), 6) FROM e
UNION ALL SELECT 'l_discount', round(b2, 6), round(sqrt(rss / (n - 3) / n * s11 / det), 6) FROM e"""
)
def ols_multi(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity + l_discount", _items(spark, sf)))


@_query(_ONE + "SELECT round(1 - sum(u * u) / sum((y - (SELECT avg(y) FROM d)) ^ 2), 9) AS r2, round(sqrt(sum(u * u) / count(*)), 6) AS rmse, round(1 - sum(u * u) / sum((y - (SELECT avg(y) FROM d)) ^ 2) * (count(*) - 1) / (count(*) - 2), 9) AS adj_r2, count(*) AS n FROM r")
def fit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity", _items(spark, sf))
    return _rows(spark, [(round(m.r2, 9), round(m.rmse, 6), round(m.adj_r2, 9), int(m.n))], "r2 double, rmse double, adj_r2 double, n long")


@_query(_ONE + _one_tail("SELECT u AS g0, u * xc AS g1, n, mx, a, b, sxx FROM r", "max(n) / (max(n) - 2)"))
def ols_hc1(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf), vcov="HC1"))


@_query(_ONE + _one_tail("SELECT u / (1 - 1.0 / n - xc * xc / sxx) AS g0, u * xc / (1 - 1.0 / n - xc * xc / sxx) AS g1, n, mx, a, b, sxx FROM r", "max(n) / (max(n) - 2)"))
def ols_hc3(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf), vcov="HC3"))


@_query(_ONE + _one_tail("SELECT sum(u) AS g0, sum(u * xc) AS g1, max(n) AS n, max(mx) AS mx, max(a) AS a, max(b) AS b, max(sxx) AS sxx FROM r GROUP BY l_suppkey", "count(*) / (count(*) - 1) * (max(n) - 1) / (max(n) - 2)"))
def ols_crv1(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf), vcov={"CRV1": "l_suppkey"}))


def _cluster(name: str, keys: str) -> str:
    return f"{name} AS (SELECT sum(g1 * g1) / max(sxx) ^ 2 AS vb, count(*) AS g, max(n) AS n, max(b) AS b FROM (SELECT sum(u * xc) AS g1, max(sxx) AS sxx, max(n) AS n, max(b) AS b FROM r GROUP BY {keys}))"


@_query(
    _ONE + f""", {_cluster("c1", "l_suppkey")}, {_cluster("c2", "l_returnflag, l_linenumber")}, {_cluster("c3", "l_suppkey, l_returnflag, l_linenumber")}
SELECT 'l_quantity' AS coefficient, round(c1.b, 6) AS estimate,
       round(sqrt((c1.vb + c2.vb - c3.vb) * least(c1.g, c2.g, c3.g) / (least(c1.g, c2.g, c3.g) - 1) * (c1.n - 1) / (c1.n - 2)), 6) AS std_error FROM c1, c2, c3"""
)
def ols_crv1_twoway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    d = _items(spark, sf).withColumn("cell", F.concat_ws("-", "l_returnflag", "l_linenumber"))
    return _coefs(spark, feols("price ~ l_quantity", d, vcov={"CRV1": "l_suppkey + cell"})).where("coefficient = 'l_quantity'")


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_discount AS x, l_quantity AS w FROM lineitem),
     m AS (SELECT sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, count(*) AS n FROM d),
     f AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) ^ 2) AS b, sum(w * (x - mx) ^ 2) AS sxx, max(mx) AS mx, max(my) AS my, max(n) AS n, max(sw) AS sw FROM d, m),
     r AS (SELECT sum(w * (y - (my - b * mx) - b * x) ^ 2) AS rss FROM d, f)
SELECT 'Intercept' AS coefficient, round(my - b * mx, 6) AS estimate, round(sqrt(rss / (n - 2) * (1 / sw + mx * mx / sxx)), 6) AS std_error FROM f, r
UNION ALL SELECT 'l_discount', round(b, 6), round(sqrt(rss / (n - 2) / sxx), 6) FROM f, r"""
)
def wls(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_discount", _items(spark, sf), weights="l_quantity"))


_FE = """
WITH d AS (SELECT l_extendedprice / 1000 AS y0, l_quantity AS x0, * FROM lineitem),
     c AS (SELECT *, y0 - avg(y0) OVER (PARTITION BY l_suppkey) AS y, x0 - avg(x0) OVER (PARTITION BY l_suppkey) AS x FROM d),
     f AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS sxx, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM c),
     r AS (SELECT c.*, y - b * x AS u, b, sxx, n, k FROM c, f)
"""


@_query(_FE + "SELECT 'l_quantity' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum(u * u) / (max(n) - 1 - max(k)) / max(sxx)), 6) AS std_error FROM r")
def fe_oneway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity | l_suppkey", _items(spark, sf)))


@_query(_FE + ", g AS (SELECT sum(u * x) AS s, max(sxx) AS sxx, max(n) AS n, max(b) AS b FROM r GROUP BY l_suppkey) SELECT 'l_quantity' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum(s * s) / max(sxx) ^ 2 * count(*) / (count(*) - 1) * (max(n) - 1) / (max(n) - 2)), 6) AS std_error FROM g")
def fe_oneway_crv1_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Effects nested in the clusters do not count as parameters, but for one."""
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity | l_suppkey", _items(spark, sf), vcov={"CRV1": "l_suppkey"}))


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y0, l_quantity AS x0, (l_linestatus = 'O')::DOUBLE AS z0, l_suppkey FROM lineitem),
     c AS (SELECT y0 - avg(y0) OVER w AS y, x0 - avg(x0) OVER w AS x, z0 - avg(z0) OVER w AS z, l_suppkey FROM d WINDOW w AS (PARTITION BY l_suppkey)),
     m AS (SELECT sum(x * x) AS xx, sum(x * z) AS xz, sum(z * z) AS zz, sum(x * y) AS xy, sum(z * y) AS zy, sum(y * y) AS yy, count(*) AS n, count(DISTINCT l_suppkey) AS k FROM c),
     b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS g, xx * zz - xz * xz AS det FROM m)
SELECT 'l_quantity' AS coefficient, round(b, 6) AS estimate, round(sqrt((yy - b * xy - g * zy) / (n - 1 - k - 1) * zz / det), 6) AS std_error FROM b"""
)
def fe_twoway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity | l_suppkey + l_linestatus", _items(spark, sf)))


@_query()
def fe_threeway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity + l_discount | l_suppkey + l_partkey + l_returnflag", _items(spark, sf), vcov={"CRV1": "l_suppkey"}))


@_query(_FE + "SELECT 'l_suppkey' AS variable, CAST(l_suppkey AS VARCHAR) AS level, round(avg(y0) - max(b) * avg(x0), 6) AS coefficient FROM r GROUP BY l_suppkey")
def fe_coefs_oneway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return feols("price ~ l_quantity | l_suppkey", _items(spark, sf)).fixef().withColumn("coefficient", F.round("coefficient", 6))


@_query("SELECT l_returnflag, round(avg(p), 6) AS mean_fit, count(*) AS n FROM (" + _FE + "SELECT l_returnflag, avg(y0) OVER (PARTITION BY l_suppkey) + b * x AS p FROM r) GROUP BY l_returnflag")
def predict_oneway(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity | l_suppkey", _items(spark, sf))
    return m.predict().groupBy("l_returnflag").agg(F.round(F.avg("fit"), 6).alias("mean_fit"), F.count(F.lit(1)).alias("n"))


@_query(_ONE + "SELECT l_returnflag, round(sum(u * u) / count(*), 6) AS mean_square, count(*) AS n FROM r GROUP BY l_returnflag")
def resid_by_group(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity", _items(spark, sf))
    return m.resid().groupBy("l_returnflag").agg(F.round(F.avg(F.col("resid") * F.col("resid")), 6).alias("mean_square"), F.count(F.lit(1)).alias("n"))


@_query("WITH k AS (SELECT o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT count(*) AS kept, count(DISTINCT o_custkey) AS levels, (SELECT count(*) FROM k WHERE n = 1) AS dropped FROM k WHERE n > 1")
def singleton_filter(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.absorb import drop_singletons

    kept, dropped = drop_singletons(_t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"])
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.count_distinct("o_custkey").alias("levels"), F.lit(dropped).cast("long").alias("dropped"))


@_query("SELECT 'p_partkey' AS effect, min(a = b) AS nested FROM (SELECT min(p_brand) AS a, max(p_brand) AS b FROM part GROUP BY p_partkey) UNION ALL SELECT 'p_type', min(a = b) FROM (SELECT min(p_brand) AS a, max(p_brand) AS b FROM part GROUP BY p_type)")
def nested_fe_check(spark: SparkSession, sf: str) -> DataFrame:
    """Which effects the model takes as nested in its clusters."""
    from ..api import feols

    p = _t(spark, sf, "part")
    p = p.unionByName(p)  # two rows a part: no level is alone
    out = [(f, bool(feols(f"p_retailprice ~ p_size | {f}", p, vcov={"CRV1": "p_brand"})._nested(["p_brand"])[1])) for f in ("p_partkey", "p_type")]
    return _rows(spark, out, "effect string, nested boolean")


_IV = """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_quantity + 100 * l_tax + l_linenumber AS z FROM lineitem),
     m AS (SELECT count(*) AS n, covar_pop(z, y) / covar_pop(z, x) AS b, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(z, x) AS szx, var_pop(z) AS szz, regr_slope(x, z) AS p, regr_intercept(x, z) AS p0 FROM d)
"""


@_query(_IV + "SELECT 'l_quantity' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum((y - (my - b * mx) - b * x) ^ 2) / (max(n) - 2) * max(szz) / (max(szx) ^ 2 * max(n))), 6) AS std_error FROM d, m")
def iv_wald(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    d = _items(spark, sf).withColumn("z", F.col("l_quantity") + 100 * F.col("l_tax") + F.col("l_linenumber"))
    return _coefs(spark, feols("price ~ 1 | l_quantity ~ z", d)).where("coefficient = 'l_quantity'")


@_query(_IV + "SELECT round(max(p) ^ 2 * max(szz) * max(n) / (sum((x - p0 - p * z) ^ 2) / (max(n) - 2)), 3) AS f_stat FROM d, m")
def first_stage_f(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    d = _items(spark, sf).withColumn("z", F.col("l_quantity") + 100 * F.col("l_tax") + F.col("l_linenumber"))
    return _rows(spark, [(round(feols("price ~ 1 | l_quantity ~ z", d).iv_diag()["f_stat"], 3),)], "f_stat double")


@_query(
    _TWO + """
SELECT 'price ~ l_quantity' AS fml, 'l_quantity' AS coefficient, round(s1y / s11, 6) AS estimate FROM e
UNION ALL SELECT 'price ~ l_quantity + l_discount', 'l_quantity', round(b1, 6) FROM e
UNION ALL SELECT 'price ~ l_quantity + l_discount', 'l_discount', round(b2, 6) FROM e"""
)
def stepwise_csw(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    ms = feols("price ~ csw(l_quantity, l_discount)", _items(spark, sf))
    return ms.tidy_frame().where("coefficient <> 'Intercept'").select("fml", "coefficient", F.round("estimate", 6).alias("estimate"))


@_query("SELECT l_returnflag, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS estimate, count(*) AS n FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'all', round(regr_slope(l_extendedprice / 1000, l_quantity), 6), count(*) FROM lineitem")
def split_by_returnflag(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    ms = feols("price ~ l_quantity", _items(spark, sf), fsplit="l_returnflag")
    return _rows(spark, [(str(m.sample[1]), round(float(m.coef()["l_quantity"]), 6), int(m.n)) for m in ms.to_list()], "l_returnflag string, estimate double, n long")


@_query(
    """
WITH m AS (SELECT l_returnflag AS f, avg(l_extendedprice / 1000) AS my FROM lineitem GROUP BY 1)
SELECT 'Intercept' AS coefficient, round(my, 6) AS estimate FROM m WHERE f = 'N'
UNION ALL SELECT 'l_returnflag::' || f, round(my - (SELECT my FROM m WHERE f = 'N'), 6) FROM m WHERE f <> 'N'"""
)
def i_factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ i(l_returnflag, ref='N')", _items(spark, sf))).drop("std_error")


@_query("SELECT 'l_returnflag::' || l_returnflag || ':l_quantity' AS coefficient, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) AS estimate FROM lineitem GROUP BY l_returnflag")
def i_factor_slopes(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ i(l_returnflag, l_quantity) | l_returnflag", _items(spark, sf))).drop("std_error")


@_query("SELECT round(regr_slope(l_extendedprice / 1000, ln(l_discount)), 6) AS estimate, count(*) AS n FROM lineitem WHERE l_discount > 0")
def log_na_drop(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ log(l_discount)", _items(spark, sf))
    return _rows(spark, [(round(float(m.beta[1]), 6), int(m.n))], "estimate double, n long")


@_query("WITH c AS (SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS hit, count(*) AS n FROM orders GROUP BY o_custkey) SELECT coalesce(sum(n) FILTER (WHERE hit = 0), 0)::BIGINT AS separated, coalesce(sum(n) FILTER (WHERE hit = 1), 0)::BIGINT AS kept FROM c")
def separation_fe(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import fepois

    d = _t(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 100000)
    m = fepois("hit ~ x | o_custkey", d, fixef_rm="none")
    return _rows(spark, [(int(m.n_separated), int(m.n_rows))], "separated long, kept long")


@_query(
    """
WITH m AS (SELECT l_returnflag AS f, ln(avg(l_quantity)) AS l FROM lineitem GROUP BY 1)
SELECT 'Intercept' AS coefficient, round(l, 6) AS estimate FROM m WHERE f = 'A'
UNION ALL SELECT 'l_returnflag::' || f, round(l - (SELECT l FROM m WHERE f = 'A'), 6) FROM m WHERE f <> 'A'"""
)
def poisson_saturated(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import fepois

    return _coefs(spark, fepois("l_quantity ~ i(l_returnflag, ref='A')", _items(spark, sf))).drop("std_error")


@_query(
    """
WITH m AS (SELECT o_orderpriority AS f, avg((o_orderstatus = 'F')::DOUBLE) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT 'o_orderpriority::' || f AS coefficient, round(ln(p / (1 - p)), 6) AS estimate, round(sqrt(1 / (n * p * (1 - p))), 6) AS std_error FROM m"""
)
def logit_saturated(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm
    from ..operators.ols import ssc

    d = _t(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int"))
    return _coefs(spark, feglm("hit ~ 0 + i(o_orderpriority)", d, "logit", ssc=ssc(k_adj=False)))


@_query()
def probit_fit(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm

    d = _t(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 100000)
    return _coefs(spark, feglm("hit ~ x", d, "probit", vcov="hetero"))


@_query()
def poisson_fe(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import fepois

    return _coefs(spark, fepois("l_quantity ~ l_discount + l_tax | l_suppkey + l_returnflag", _items(spark, sf), vcov={"CRV1": "l_suppkey"}))


_DAILY = """
WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS y, count(*)::DOUBLE AS x FROM events GROUP BY 1),
     f AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum((x - (SELECT avg(x) FROM d)) ^ 2) AS sxx FROM d),
     r AS (SELECT day, (y - a - b * x) * (x - mx) AS s, n, b, sxx FROM d, f),
     l AS (SELECT *, lag(s, 1) OVER (ORDER BY day) AS s1, lag(s, 2) OVER (ORDER BY day) AS s2, lag(s, 3) OVER (ORDER BY day) AS s3 FROM r)
"""


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))


@_query(_DAILY + "SELECT 'x' AS coefficient, round(max(b), 6) AS estimate, round(sqrt((sum(s * s) + 2 * (0.75 * sum(s * s1) + 0.5 * sum(s * s2) + 0.25 * sum(s * s3))) / max(sxx) ^ 2 * (max(n) - 1) / (max(n) - 2) * max(n) / (max(n) - 1)), 6) AS std_error FROM l")
def nw_daily(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("y ~ x", _daily(spark, sf), vcov="NW", vcov_kwargs={"time_id": "day", "lag": 3})).where("coefficient = 'x'")


_PANEL = """
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS y, count(*)::DOUBLE AS x FROM events GROUP BY 1, 2),
     f AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, sum((x - (SELECT avg(x) FROM p)) ^ 2) AS sxx FROM p),
     r AS (SELECT user_id, day, (y - a - b * x) * (x - mx) AS s, n, b, sxx FROM p, f)
"""


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("y"), F.count(F.lit(1)).cast("double").alias("x"))


@_query(
    _PANEL + """, g AS (SELECT day, sum(s) AS s, max(n) AS n, max(b) AS b, max(sxx) AS sxx FROM r GROUP BY day),
     l AS (SELECT *, lag(s, 1) OVER (ORDER BY day) AS s1, lag(s, 2) OVER (ORDER BY day) AS s2 FROM g)
SELECT 'x' AS coefficient, round(max(b), 6) AS estimate, round(sqrt((sum(s * s) + 2 * (2.0 / 3 * sum(s * s1) + 1.0 / 3 * sum(s * s2))) / max(sxx) ^ 2 * (max(n) - 1) / (max(n) - 2) * count(*) / (count(*) - 1)), 6) AS std_error FROM l"""
)
def dk_panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("y ~ x", _panel(spark, sf), vcov="DK", vcov_kwargs={"time_id": "day", "panel_id": "user_id", "lag": 2})).where("coefficient = 'x'")


@_query(
    _PANEL + """, l AS (SELECT *, lag(s, 1) OVER (PARTITION BY user_id ORDER BY day) AS s1 FROM r)
SELECT 'x' AS coefficient, round(max(b), 6) AS estimate, round(sqrt((sum(s * s) + 2 * 0.5 * sum(s * s1)) / max(sxx) ^ 2 * (max(n) - 1) / (max(n) - 2) * count(DISTINCT day) / (count(DISTINCT day) - 1)), 6) AS std_error FROM l"""
)
def nw_panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("y ~ x", _panel(spark, sf), vcov="NW", vcov_kwargs={"time_id": "day", "panel_id": "user_id", "lag": 1})).where("coefficient = 'x'")


_G = "CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 20 END"


def _did(spark: SparkSession, sf: str) -> DataFrame:
    """User by calendar day counted from the first, users adopting on day 10, 20 or never."""
    e = _t(spark, sf, "events")
    first = e.agg(F.min(F.to_date("ts"))).first()[0]
    p = e.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit(first)).alias("t")).agg(F.avg("value").alias("y"))
    k = F.col("user_id") % 3
    return p.withColumn("g", F.when(k == 0, 0).when(k == 1, 10).otherwise(20))


_DID = f"WITH p AS (SELECT user_id, CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS t, avg(value) AS y, {_G} AS g FROM events GROUP BY 1, 2)"


@_query(_DID + ", n AS (SELECT g, t - g AS r, count(*) AS n FROM p WHERE g > 0 GROUP BY 1, 2), f AS (SELECT c.g, q.r, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT g FROM n) c CROSS JOIN (SELECT DISTINCT r FROM n) q LEFT JOIN n ON n.g = c.g AND n.r = q.r) SELECT g::DOUBLE AS cohort, r::DOUBLE AS period, n, round(n * 1.0 / sum(n) OVER (PARTITION BY r), 9) AS share FROM f")
def interaction_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import did

    return did.interaction_weights(_did(spark, sf), "user_id", "t", "g").withColumn("share", F.round("share", 9))


@_query(
    _DID + """, e AS (SELECT *, (g > 0 AND t >= g)::INT AS d FROM p), w AS (SELECT *, lag(y) OVER u AS y_lag, CASE WHEN lag(d) OVER u IS NOT NULL THEN greatest(d - lag(d) OVER u, 0) END AS step, lead(y, 2) OVER u AS y2, lead(d, 2) OVER u AS d2, lag(y, 3) OVER u AS y_3 FROM e WINDOW u AS (PARTITION BY user_id ORDER BY t))
SELECT 2 AS h, step AS treat_diff, count(*) AS n, count(y2 - y_lag) AS n_full, round(sum(y2 - y_lag), 4) AS long_diff FROM w WHERE step = 1 OR d2 = 0 GROUP BY step
UNION ALL SELECT -3, step, count(*), count(y_3 - y_lag), round(sum(y_3 - y_lag), 4) FROM w WHERE step = 1 OR d = 0 GROUP BY step"""
)
def lag_diff_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that local projections stand on: long differences of switchers and clean controls."""
    from ..operators.did import did_columns, horizon, switched

    base = switched(did_columns(_did(spark, sf), "user_id", "t", "g"), "y", "user_id", "t")
    one = lambda h: horizon(base, "y", "user_id", "t", h).groupBy("treat_diff").agg(F.count(F.lit(1)).alias("n"), F.count("lp_dy").alias("n_full"), F.round(F.sum("lp_dy"), 4).alias("long_diff")).select(F.lit(h).alias("h"), "*")
    return one(2).unionByName(one(-3))


@_query(_DID + ", q AS (SELECT user_id, min(t) FILTER (WHERE g > 0 AND t >= g) AS first_treated_period FROM p GROUP BY user_id) SELECT first_treated_period::DOUBLE AS first_treated_period, count(*) AS users FROM q GROUP BY 1")
def first_treated(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import did

    d = _did(spark, sf).withColumn("d", ((F.col("g") > 0) & (F.col("t") >= F.col("g"))).cast("int"))
    return did.first_treated(d, "user_id", "t", "d").groupBy("user_id").agg(F.first("first_treated_period").cast("double").alias("first_treated_period")).groupBy("first_treated_period").agg(F.count(F.lit(1)).alias("users"))


@_query()
def event_study_twfe(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import event_study

    return _coefs(spark, event_study(_did(spark, sf), "y", "user_id", "t", "g"))


@_query()
def event_study_did2s(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import event_study

    return _coefs(spark, event_study(_did(spark, sf), "y", "user_id", "t", "g", estimator="did2s"))


@_query()
def lpdid_att(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import lpdid

    t = lpdid(_did(spark, sf), "y", "user_id", "t", "g", att=True, pre_window=2, post_window=2)
    return _rows(spark, [(str(i), round(float(r["Estimate"]), 6), round(float(r["Std. Error"]), 6)) for i, r in t.iterrows()], "coefficient string, estimate double, std_error double")


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_quantity * l_discount AS x2 FROM lineitem),
     m AS (SELECT var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM d),
     b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT 'direct_effect' AS part, round(s1y / s11, 6) AS coefficient FROM b
UNION ALL SELECT 'full_effect', round(b1, 6) FROM b
UNION ALL SELECT 'explained_effect', round(s12 / s11 * b2, 6) FROM b
UNION ALL SELECT 'unexplained_effect', round(s1y / s11 - s12 / s11 * b2, 6) FROM b
UNION ALL SELECT 'qd', round(s12 / s11 * b2, 6) FROM b"""
)
def gelbach_point(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.decompose import decompose

    d = _items(spark, sf).withColumn("qd", F.col("l_quantity") * F.col("l_discount"))
    t = decompose(feols("price ~ l_quantity + qd", d), "l_quantity").tidy()
    return _rows(spark, [(str(i), round(float(v), 6)) for i, v in t["coefficients"].items()], "part string, coefficient double")


@_query("SELECT round(quantile_disc(l_extendedprice / 1000, 0.33337), 6) AS estimate, count(*) AS n FROM lineitem")
def quantile_intercept(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.quantreg import quantreg

    m = quantreg("price ~ 1", _items(spark, sf), 0.33337, vcov="iid")
    return _rows(spark, [(round(float(m.beta[0]), 6), int(m.n))], "estimate double, n long")


@_query(_ONE + ", t AS (SELECT max(b) ^ 2 / (sum(u * u) / (max(n) - 2) / max(sxx)) AS f, max(n) AS n FROM r) SELECT round(0.5 * ln(1.0 / (1 + n)) + 0.5 * (n - 2 + 1) * (ln(1 + f / (n - 2)) - ln(1 + f / (n - 2) / (1 + n))), 6) AS log_e FROM t")
def savi_evalue(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.savi import log_e_value

    m = feols("price ~ l_quantity", _items(spark, sf))
    t = float(m.tstat()[1])
    return _rows(spark, [(round(log_e_value(t * t, 1, m.n - m.k, m.n, 1.0), 6),)], "log_e double")


@_query(_ONE + "SELECT round(max(b) ^ 2 / (sum(u * u) / (max(n) - 2) / max(sxx)), 6) AS statistic, max(n) - 2 AS dfd FROM r")
def wald_slope(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    m = feols("price ~ l_quantity", _items(spark, sf))
    w = m.wald_test(np.array([[0.0, 1.0]]))
    return _rows(spark, [(round(float(w["statistic"]), 6), int(w["dfd"]))], "statistic double, dfd long")


@_query("SELECT count(*) AS n, round(sum(l_quantity) / 1e6, 6) AS s1, round(sum(l_quantity * l_discount) / 1e6, 6) AS s12, round(sum(l_quantity * l_extendedprice / 1000) / 1e6, 6) AS s1y FROM lineitem")
def gram_products(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.moments import moments

    n, s, m = moments(_items(spark, sf), [F.col("l_quantity"), F.col("l_discount"), F.col("price")], F.lit(1.0))
    return _rows(spark, [(int(n), round(s[1] / 1e6, 6), round(m[1, 2] / 1e6, 6), round(m[1, 3] / 1e6, 6))], "n long, s1 double, s12 double, s1y double")


@_query(_TWO + "SELECT 'Intercept' AS coefficient, round(b0, 6) AS estimate FROM e UNION ALL SELECT 'l_quantity', round(b1, 6) FROM e UNION ALL SELECT 'l_discount', round(b2, 6) FROM e")
def streaming_update(spark: SparkSession, sf: str) -> DataFrame:
    """Sufficient statistics gathered over micro-batches give the coefficients of all rows."""
    from ..streaming.update import stream_ols

    m = stream_ols(spark, f"{sf}/lineitem.parquet", _t(spark, sf, "lineitem").schema, "l_extendedprice / 1000", ["l_quantity", "l_discount"])
    return _rows(spark, [(n, round(float(b), 6)) for n, b in zip(m.names, m.coef(), strict=True)], "coefficient string, estimate double")


@_query()
def wild_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.resample import wildboottest

    r = wildboottest(feols("price ~ l_quantity", _items(spark, sf), vcov={"CRV1": "l_suppkey"}), 999, "l_quantity", seed=1)
    return _rows(spark, [(round(float(r["t value"]), 6), float(r["Pr(>|t|)"]))], "t_value double, p_value double")


@_query()
def randomisation_inference(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.resample import ritest

    r = ritest(feols("price ~ l_linenumber", _items(spark, sf)), "l_linenumber", reps=32)
    return _rows(spark, [(round(float(r["Estimate"]), 6), float(r["Pr(>|t|)"]))], "estimate double, p_value double")


@_query(
    """
WITH d AS (SELECT CAST(user_id AS DOUBLE) AS x, value AS y FROM events)
SELECT 'price' AS what, round(regr_slope(y, x), 9) AS estimate FROM d"""
)
def formula_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """I() and arithmetic in formulas leave the slope as it is."""
    from ..api import feols

    m = feols("I(value + 0) ~ I(2 * user_id - user_id)", _t(spark, sf, "events"))
    return _rows(spark, [("price", round(float(m.beta[1]), 9))], "what string, estimate double")


from . import formula_queries, more_queries  # noqa: E402, F401  they register their queries with the functions above
