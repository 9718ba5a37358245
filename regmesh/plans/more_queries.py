"""Queries of estimators without a closed form in one pass, of inference and of formula terms; their SQL iterates where it must."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import _DID, _ONE, _TWO, _coefs, _did, _items, _one_tail, _query, _replace_sql, _rows, _t

# --- SQL for what DuckDB lacks ------------------------------------------------------


def _pdf(x: str) -> str:
    return f"(exp(-0.5 * ({x}) * ({x})) / sqrt(2 * pi()))"


def _cdf(x: str, terms: int = 60) -> str:
    """The normal distribution function by its power series, for arguments up to about six."""
    series = "1"
    for k in range(terms, 0, -1):
        series = f"(1 + {x} * {x} / {2 * k + 1} * {series})"
    return f"(0.5 + {_pdf(x)} * {x} * {series})"


def _two_sided(t: str, df: str) -> str:
    """p-value of t, by Hill's normal approximation (1970); t is a column name."""
    a, w = f"({df} - 0.5)", f"sqrt(({df} - 0.5) * ln(1 + {t} * {t} / {df}))"
    b = f"(48 * {a} * {a})"
    z = f"({w} + ({w} ^ 3 + 3 * {w}) / {b} - (4 * {w} ^ 7 + 33 * {w} ^ 5 + 240 * {w} ^ 3 + 855 * {w}) / (10 * {b} * ({b} + 0.8 * {w} ^ 4 + 100)))"
    return f"(SELECT 2 * (1 - {_cdf('z')}) FROM (SELECT {z} AS z))"


def _t975(df: str) -> str:
    """The 0.975 quantile of t, by Cornish and Fisher's expansion about the normal one."""
    z = 1.959963984540054
    return f"({z} + {(z**3 + z) / 4} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / {df} ^ 2 + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / {df} ^ 3)"


def _probit(p: str) -> str:
    """The normal quantile function, by Acklam's rational approximation and one Newton step."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    poly = lambda c: "(" + " + ".join(f"({v}) * {r} ^ {len(c) - 1 - i}" for i, v in enumerate(c)) + ")"
    first = f"({q} * {poly(a)} / {poly(b)})"
    return f"(SELECT z - ({_cdf('z')} - {p}) / {_pdf('z')} FROM (SELECT {first} AS z))"


def _swept(source: str, keys: list[str], effects: list[str], cols: list[str], rounds: int, name: str = "swept", weight: str = "1") -> str:
    """A recursive table of the columns less the (weighted) means of each effect, turn by turn."""
    inner, now = f"SELECT {', '.join([*keys, *cols])} FROM {name} WHERE it < {rounds}", cols
    for f in effects:
        inner = f"SELECT {', '.join(keys)}, " + ", ".join(f"{c} - sum({weight} * {c}) OVER (PARTITION BY {f}) / sum({weight}) OVER (PARTITION BY {f}) AS {c}" for c in now) + f" FROM ({inner})"
    return f"{name} AS (SELECT 0 AS it, {', '.join(keys)}, {', '.join(f'{c}::DOUBLE AS {c}' for c in cols)} FROM {source} UNION ALL SELECT it, {', '.join([*keys, *cols])} FROM (SELECT (SELECT max(it) FROM {name}) + 1 AS it, * FROM ({inner})))"


def _last(name: str = "swept") -> str:
    return f"(SELECT * FROM {name} WHERE it = (SELECT max(it) FROM {name}))"


# --- several effects ------------------------------------------------------------------

_SWEPT3 = _swept("d", ["l_suppkey", "l_partkey", "l_returnflag"], ["l_suppkey", "l_partkey", "l_returnflag"], ["y", "x1", "x2"], 25)
_replace_sql(
    "fe_threeway",
    f"""
WITH RECURSIVE d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x1, l_discount AS x2, l_suppkey, l_partkey, l_returnflag FROM lineitem),
     {_SWEPT3}, s AS {_last()},
     m AS (SELECT count(*) AS n, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, count(DISTINCT l_suppkey) AS g, count(DISTINCT l_partkey) AS kp, count(DISTINCT l_returnflag) AS kf FROM s),
     b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
     c AS (SELECT sum(x1 * (y - b1 * x1 - b2 * x2)) AS g1, sum(x2 * (y - b1 * x1 - b2 * x2)) AS g2 FROM s, b GROUP BY l_suppkey),
     v AS (SELECT sum((s22 * g1 - s12 * g2) ^ 2) / max(det) ^ 2 AS v1, sum((s11 * g2 - s12 * g1) ^ 2) / max(det) ^ 2 AS v2, max(g) / (max(g) - 1) * (max(n) - 1) / (max(n) - (2 + 1 + max(kp) - 1 + max(kf) - 1)) AS adj, max(b1) AS b1, max(b2) AS b2 FROM c, b)
SELECT 'l_quantity' AS coefficient, round(b1, 6) AS estimate, round(sqrt(adj * v1), 6) AS std_error FROM v
UNION ALL SELECT 'l_discount', round(b2, 6), round(sqrt(adj * v2), 6) FROM v""",
)


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y0, l_quantity AS x0, (l_linestatus = 'O')::DOUBLE AS z0, l_suppkey FROM lineitem),
     c AS (SELECT y0 - avg(y0) OVER w AS y, x0 - avg(x0) OVER w AS x, z0 - avg(z0) OVER w AS z FROM d WINDOW w AS (PARTITION BY l_suppkey))
SELECT 'l_quantity' AS coefficient, round((sum(z * z) * sum(x * y) - sum(x * z) * sum(z * y)) / (sum(x * x) * sum(z * z) - sum(x * z) ^ 2), 6) AS estimate FROM c"""
)
def fe_twoway_sweeps(spark: SparkSession, sf: str) -> DataFrame:
    """Two effects absorbed by tables alone, without cells on the driver."""
    from ..api import feols
    from ..operators.absorb import Demeaner

    return _coefs(spark, feols("price ~ l_quantity | l_suppkey + l_linestatus", _items(spark, sf), demeaner=Demeaner(method="map"))).drop("std_error")


# --- generalised linear models ----------------------------------------------------------


def _fisher(link: str) -> str:
    """Binary model of hit on x by Fisher scoring: f (estimate, information), one row."""
    mean, slope = (_cdf("e"), _pdf("e")) if link == "probit" else ("(1 / (1 + exp(-e)))", "(1 / (1 + exp(-e)) * (1 - 1 / (1 + exp(-e))))")
    return f"""
WITH RECURSIVE d AS (SELECT (o_orderstatus = 'F')::INT AS y, o_totalprice / 100000 AS x FROM orders),
     f(it, a, b, i11, i12, i22) AS (
       SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
       UNION ALL
       SELECT it + 1, a + (i22 * s1 - i12 * s2) / (i11 * i22 - i12 * i12), b + (i11 * s2 - i12 * s1) / (i11 * i22 - i12 * i12), i11, i12, i22 FROM (
         SELECT it, a, b, sum(k) AS s1, sum(k * x) AS s2, sum(w) AS i11, sum(w * x) AS i12, sum(w * x * x) AS i22 FROM (
           SELECT it, a, b, x, (y - m) * s / (m * (1 - m)) AS k, s * s / (m * (1 - m)) AS w FROM (
             SELECT it, a, b, x, y, {mean} AS m, {slope} AS s FROM (SELECT f.it, f.a, f.b, d.x, d.y, f.a + f.b * d.x AS e FROM f, d WHERE f.it < 9))) GROUP BY it, a, b)),
     z AS (SELECT * FROM f WHERE it = 9),
     r AS (SELECT x, (y - m) * s / (m * (1 - m)) AS k FROM (SELECT x, y, {mean} AS m, {slope} AS s FROM (SELECT d.x, d.y, a + b * d.x AS e FROM d, z))),
     v AS (SELECT max(a) AS a, max(b) AS b, count(*) * 1.0 / (count(*) - 2) AS adj, sum((i22 * k - i12 * k * x) ^ 2) / max(i11 * i22 - i12 * i12) ^ 2 AS v1, sum((i11 * k * x - i12 * k) ^ 2) / max(i11 * i22 - i12 * i12) ^ 2 AS v2 FROM r, z)
SELECT 'Intercept' AS coefficient, round(a, 6) AS estimate, round(sqrt(adj * v1), 6) AS std_error FROM v UNION ALL SELECT 'x', round(b, 6), round(sqrt(adj * v2), 6) FROM v"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").withColumn("hit", (F.col("o_orderstatus") == "F").cast("int")).withColumn("x", F.col("o_totalprice") / 100000)


_replace_sql("probit_fit", _fisher("probit"))


@_query(_fisher("logit"))
def logit_fit(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm

    return _coefs(spark, feglm("hit ~ x", _hits(spark, sf), "logit", vcov="hetero"))


@_query(
    f"""
WITH m AS (SELECT o_orderpriority AS f, avg((o_orderstatus = 'F')::DOUBLE) AS p, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT *, {_probit('p')} AS z FROM m)
SELECT 'o_orderpriority::' || f AS coefficient, round(z, 6) AS estimate, round(sqrt(p * (1 - p) / n) / {_pdf('z')}, 6) AS std_error FROM q"""
)
def probit_saturated(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm
    from ..operators.ols import ssc

    return _coefs(spark, feglm("hit ~ 0 + i(o_orderpriority)", _hits(spark, sf), "probit", ssc=ssc(k_adj=False)))


@_query(_ONE + "SELECT 'Intercept' AS coefficient, round(max(a), 6) AS estimate, round(sqrt(sum(u * u) / (max(n) - 2) * (1.0 / max(n) + max(mx) ^ 2 / max(sxx))), 6) AS std_error FROM r UNION ALL SELECT 'l_quantity', round(max(b), 6), round(sqrt(sum(u * u) / (max(n) - 2) / max(sxx)), 6) FROM r")
def gaussian_glm(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feglm

    return _coefs(spark, feglm("price ~ l_quantity", _items(spark, sf), "gaussian"))


_replace_sql(
    "poisson_fe",
    f"""
WITH RECURSIVE d AS (SELECT l_quantity AS y, l_discount AS x1, l_tax AS x2, l_suppkey AS s, l_returnflag AS f FROM lineitem),
     p AS (
       SELECT 0 AS it, y, x1, x2, s, f, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS g, y AS mu FROM d
       UNION ALL
       SELECT it + 1, y, x1, x2, s, f, b1 + (i22 * k1 - i12 * k2) / (i11 * i22 - i12 * i12), b2 + (i11 * k2 - i12 * k1) / (i11 * i22 - i12 * i12), g, mu FROM (
         SELECT it, y, x1, x2, s, f, b1, b2, g, mu, sum(c1 * (y - mu)) OVER () AS k1, sum(c2 * (y - mu)) OVER () AS k2, sum(mu * c1 * c1) OVER () AS i11, sum(mu * c1 * c2) OVER () AS i12, sum(mu * c2 * c2) OVER () AS i22 FROM (
           SELECT *, x1 - sum(mu * x1) OVER w / sum(mu) OVER w AS c1, x2 - sum(mu * x2) OVER w / sum(mu) OVER w AS c2 FROM (
             SELECT it, y, x1, x2, s, f, b1, b2, g + h AS g, m * exp(h) * sum(y) OVER (PARTITION BY s) / sum(m * exp(h)) OVER (PARTITION BY s) AS mu FROM (
               SELECT *, ln(sum(y) OVER (PARTITION BY f) / sum(nu) OVER (PARTITION BY f)) AS h FROM (
                 SELECT *, m * sum(y) OVER (PARTITION BY s) / sum(m) OVER (PARTITION BY s) AS nu FROM (SELECT *, exp(b1 * x1 + b2 * x2 + g) AS m FROM p WHERE it < 14))))
           WINDOW w AS (PARTITION BY s)))),
     e AS (SELECT * FROM p WHERE it = 14),
     {_swept('e', ['s', 'f', 'y', 'mu', 'b1', 'b2'], ['s', 'f'], ['x1', 'x2'], 10, weight='mu')}, q AS {_last()},
     i AS (SELECT count(*) AS n, sum(mu * x1 * x1) AS i11, sum(mu * x1 * x2) AS i12, sum(mu * x2 * x2) AS i22, count(DISTINCT s) AS g, count(DISTINCT f) AS kf, max(b1) AS b1, max(b2) AS b2 FROM q),
     c AS (SELECT sum(x1 * (y - mu)) AS g1, sum(x2 * (y - mu)) AS g2 FROM q GROUP BY s),
     v AS (SELECT sum((i22 * g1 - i12 * g2) ^ 2) / max(i11 * i22 - i12 * i12) ^ 2 AS v1, sum((i11 * g2 - i12 * g1) ^ 2) / max(i11 * i22 - i12 * i12) ^ 2 AS v2, max(g) / (max(g) - 1) * (max(n) - 1) / (max(n) - (2 + 1 + max(kf) - 1)) AS adj, max(b1) AS b1, max(b2) AS b2 FROM c, i)
SELECT 'l_discount' AS coefficient, round(b1, 6) AS estimate, round(sqrt(adj * v1), 6) AS std_error FROM v UNION ALL SELECT 'l_tax', round(b2, 6), round(sqrt(adj * v2), 6) FROM v""",
)


@_query(
    """
WITH m AS (SELECT l_returnflag AS f, avg(l_quantity) AS mu FROM lineitem GROUP BY 1),
     r AS (SELECT l_quantity AS y, mu, (SELECT avg(l_quantity) FROM lineitem) AS m0 FROM lineitem JOIN m ON l_returnflag = f),
     s AS (SELECT sum(y * ln(mu) - mu - lgamma(y + 1)) AS l1, sum(y * ln(m0) - m0 - lgamma(y + 1)) AS l0, sum((y - mu) ^ 2 / mu) AS chi, sum(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))) AS dev FROM r)
SELECT round(l1, 2) AS loglik, round(l0, 2) AS loglik_null, round(1 - l1 / l0, 8) AS pseudo_r2, round(chi, 2) AS pearson_chi2, round(dev, 2) AS deviance FROM s"""
)
def poisson_loglik(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import fepois

    r = fepois("l_quantity ~ i(l_returnflag, ref='A')", _items(spark, sf)).loglik()
    return _rows(spark, [tuple(round(float(r[k]), 8 if k == "pseudo_r2" else 2) for k in ("loglik", "loglik_null", "pseudo_r2", "pearson_chi2", "deviance"))], "loglik double, loglik_null double, pseudo_r2 double, pearson_chi2 double, deviance double")


@_query("SELECT 'l_returnflag::' || l_returnflag AS coefficient, round(ln(sum(l_quantity) / sum(exp(l_tax))), 6) AS estimate FROM lineitem GROUP BY l_returnflag")
def poisson_offset(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import fepois

    return _coefs(spark, fepois("l_quantity ~ 0 + i(l_returnflag)", _items(spark, sf), offset="l_tax")).drop("std_error")


@_query(
    """
WITH c AS (SELECT l_linenumber AS g, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS yf, count(*) FILTER (WHERE l_linestatus = 'F') AS nf, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS yo, count(*) FILTER (WHERE l_linestatus = 'O') AS no FROM lineitem GROUP BY 1),
     t AS (SELECT sum(yf) AS tf, sum(nf) AS kf, sum(yo) AS t_o, sum(no) AS ko, count(*) AS g FROM c),
     d AS (SELECT ln((tf - yf) / (kf - nf)) AS a, ln((t_o - yo) / (ko - no)) AS o, ln(tf / kf) AS a0, ln(t_o / ko) AS o0, g.* FROM c, (SELECT * FROM t) g),
     v AS (SELECT sum((a - a0) ^ 2) AS va, sum((o - a - o0 + a0) ^ 2) AS vb, max(a0) AS a, max(o0 - a0) AS b, max(g) * 1.0 / (max(g) - 1) * (max(kf + ko) - 1) / (max(kf + ko) - 2) AS adj FROM d)
SELECT 'Intercept' AS coefficient, round(a, 6) AS estimate, round(sqrt(adj * va), 8) AS std_error FROM v UNION ALL SELECT 'l_linestatus[T.O]', round(b, 6), round(sqrt(adj * vb), 8) FROM v"""
)
def poisson_crv3(spark: SparkSession, sf: str) -> DataFrame:
    """The jackknife of a generalised model refits without each cluster."""
    from ..api import fepois

    m = fepois("l_quantity ~ l_linestatus", _items(spark, sf), vcov={"CRV3": "l_linenumber"})
    return _rows(spark, [(n, round(float(b), 6), round(float(s), 8)) for n, b, s in zip(m.coefnames, m.beta, m.se(), strict=True)], "coefficient string, estimate double, std_error double")


@_query("SELECT l_returnflag, round(avg(m), 6) AS mean_fit FROM (SELECT l_returnflag, avg(l_quantity) OVER (PARTITION BY l_linenumber) AS m FROM lineitem) GROUP BY 1")
def poisson_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of a model that is an effect alone are the means by level."""
    from ..api import fepois

    m = fepois("l_quantity ~ 0 + i(l_linenumber)", _items(spark, sf))
    return m.predict(type="response").groupBy("l_returnflag").agg(F.round(F.avg("fit"), 6).alias("mean_fit"))


# --- inference ------------------------------------------------------------------------------

_TAX = _ONE.replace("l_quantity AS x,", "l_tax AS x,")


@_query(
    _TAX + f""", v AS (SELECT sum(u * u) / (max(n) - 2) AS s2, max(n)::DOUBLE AS n, max(mx) AS mx, max(sxx) AS sxx, max(a) AS a, max(b) AS b FROM r),
     e AS (SELECT 'Intercept' AS coefficient, a AS est, sqrt(s2 * (1 / n + mx * mx / sxx)) AS se, n - 2 AS df FROM v UNION ALL SELECT 'l_tax', b, sqrt(s2 / sxx), n - 2 FROM v),
     t AS (SELECT *, least(est / se, 12.0) AS tv, {_t975('df')} AS q FROM e)
SELECT coefficient, round(est / se, 6) AS t_value, round(CASE WHEN tv >= 12 THEN 0 ELSE {_two_sided('tv', 'df')} END, 8) AS p_value, round(est - q * se, 6) AS ci_low, round(est + q * se, 6) AS ci_high FROM t"""
)
def tidy_inference(spark: SparkSession, sf: str) -> DataFrame:
    """t, p and the interval of a regressor without effect."""
    from ..api import feols

    m = feols("price ~ l_tax", _items(spark, sf))
    return m.tidy_frame().select("coefficient", F.round("t_value", 6).alias("t_value"), F.round("p_value", 8).alias("p_value"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


@_query(
    _TAX + f""", v AS (SELECT max(b) / sqrt(sum(u * u) / (max(n) - 2) / max(sxx)) AS tv, max(n)::DOUBLE - 2 AS df FROM r)
SELECT 'est1' AS model, round(least(1, 2 * {_two_sided('tv', 'df')}), 8) AS p_value FROM v
UNION ALL SELECT 'est2', round(least(1, 2 * {_two_sided('tv', 'df')}), 8) FROM (SELECT b / sqrt(s2 / sxx) AS tv, df FROM (
  SELECT regr_slope(l_quantity, l_tax) AS b, regr_sxx(l_quantity, l_tax) AS sxx, (regr_syy(l_quantity, l_tax) - regr_sxy(l_quantity, l_tax) ^ 2 / regr_sxx(l_quantity, l_tax)) / (count(*) - 2) AS s2, count(*)::DOUBLE - 2 AS df FROM lineitem))"""
)
def bonferroni_two(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols
    from ..operators.multiple import bonferroni

    t = bonferroni(feols("price + l_quantity ~ l_tax", _items(spark, sf)), "l_tax")
    return _rows(spark, [(str(c), round(float(t.loc["Bonferroni Pr(>|t|)", c]), 8)) for c in t.columns], "model string, p_value double")


@_query(_ONE + _one_tail("SELECT u / sqrt(1 - 1.0 / n - xc * xc / sxx) AS g0, u * xc / sqrt(1 - 1.0 / n - xc * xc / sxx) AS g1, n, mx, a, b, sxx FROM r", "max(n) / (max(n) - 2)"))
def ols_hc2(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf), vcov="HC2"))


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_suppkey FROM lineitem),
     c AS (SELECT count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM d GROUP BY l_suppkey),
     t AS (SELECT sum(n) AS n0, sum(x) AS x0, sum(y) AS y0, sum(xx) AS xx0, sum(xy) AS xy0, count(*) AS g FROM c),
     j AS (SELECT (xy0 - xy - (x0 - x) * (y0 - y) / (n0 - n)) / (xx0 - xx - (x0 - x) ^ 2 / (n0 - n)) AS b, (xy0 - x0 * y0 / n0) / (xx0 - x0 * x0 / n0) AS b0, (y0 - y) / (n0 - n) AS my, (x0 - x) / (n0 - n) AS mx, y0 / n0 AS my0, x0 / n0 AS mx0, g, n0 FROM c, t),
     v AS (SELECT max(g) * 1.0 / (max(g) - 1) * (max(n0) - 1) / (max(n0) - 2) AS adj, sum((b - b0) ^ 2) AS vb, sum((my - b * mx - my0 + b0 * mx0) ^ 2) AS va, max(b0) AS b, max(my0 - b0 * mx0) AS a FROM j)
SELECT 'Intercept' AS coefficient, round(a, 6) AS estimate, round(sqrt(adj * va), 6) AS std_error FROM v UNION ALL SELECT 'l_quantity', round(b, 6), round(sqrt(adj * vb), 6) FROM v"""
)
def ols_crv3(spark: SparkSession, sf: str) -> DataFrame:
    from ..api import feols

    return _coefs(spark, feols("price ~ l_quantity", _items(spark, sf), vcov={"CRV3": "l_suppkey"}))


@_query(
    """
WITH d AS (SELECT l_extendedprice / 1000 AS y, l_tax AS x, l_linenumber AS g FROM lineitem),
     m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM d),
     c AS (SELECT row_number() OVER (ORDER BY g) - 1 AS i, sum((x - mx) * (y - my)) AS a, sum((x - mx) ^ 2) AS bx, sum(x - mx) AS b0, sum(y - my) AS s0, sum((x - mx) * (y - my - b * (x - mx))) AS plain, max(n) AS n, max(sxx) AS sxx, max(b) AS b FROM d, m GROUP BY g),
     v AS (SELECT k, i, (CASE WHEN (k >> i) & 1 = 1 THEN 1.0 ELSE -1.0 END) AS e, c.* FROM c, range(128) r(k)),
     t AS (SELECT k, sum(e * a) / max(sxx) AS est, sum(e * s0) / max(n) AS shift FROM v GROUP BY k),
     s AS (SELECT t.k, max(est) AS est, sqrt(sum((e * a - bx * est - b0 * shift) ^ 2)) / max(sxx) AS se FROM v JOIN t ON v.k = t.k GROUP BY t.k),
     o AS (SELECT max(b) / (sqrt(sum(plain ^ 2)) / max(sxx)) AS raw, count(*)::DOUBLE / (count(*) - 1) * (max(n) - 1) / (max(n) - 2) AS adj FROM c)
SELECT round(max(raw) / sqrt(max(adj)), 6) AS t_value, round(avg((abs(est / se) >= abs(raw) * (1 - 1e-9))::INT), 9) AS p_value FROM s, o"""
)
def wild_bootstrap_listed(spark: SparkSession, sf: str) -> DataFrame:
    """Seven clusters have 128 signs: all of them are drawn once."""
    from ..api import feols
    from ..operators.resample import wildboottest

    r = wildboottest(feols("price ~ l_tax", _items(spark, sf), vcov={"CRV1": "l_linenumber"}), 128, "l_tax")
    return _rows(spark, [(round(float(r["t value"]), 6), round(float(r["Pr(>|t|)"]), 9))], "t_value double, p_value double")


# --- differences in differences ----------------------------------------------------------------

_replace_sql(
    "event_study_twfe",
    "WITH RECURSIVE " + _DID.removeprefix("WITH ") + f""", d AS (SELECT user_id, t, y, (g > 0 AND t >= g)::DOUBLE AS x FROM p),
     {_swept('d', ['user_id', 't'], ['user_id', 't'], ['y', 'x'], 60)}, s AS {_last()},
     m AS (SELECT count(*) AS n, sum(x * x) AS sxx, sum(x * y) / sum(x * x) AS b, count(DISTINCT t) AS kt, count(DISTINCT user_id) AS g FROM s),
     c AS (SELECT sum(x * (y - b * x)) AS q FROM s, m GROUP BY user_id)
SELECT 'is_treated' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum(q * q) / max(sxx) ^ 2 * max(g) / (max(g) - 1) * (max(n) - 1) / (max(n) - (1 + 1 + max(kt) - 1))), 6) AS std_error FROM c, m""",
)

_replace_sql(
    "event_study_did2s",
    "WITH RECURSIVE " + _DID.removeprefix("WITH ") + """, d AS (SELECT user_id, t, y, (g > 0 AND t >= g)::INT AS x FROM p),
     z AS (SELECT d.*, sum(x) OVER (PARTITION BY user_id) AS ri, sum(x) OVER (PARTITION BY t) AS rt FROM d),
     l AS (
       SELECT 0 AS it, user_id, t, y, ri, rt, 0.0::DOUBLE AS a, 0.0::DOUBLE AS g, 0.0::DOUBLE AS ca, 0.0::DOUBLE AS cg FROM z WHERE x = 0
       UNION ALL
       SELECT it + 1, user_id, t, y, ri, rt, a, avg(y - a) OVER w, ca, (rt - sum(ca) OVER w) / count(*) OVER w FROM (
         SELECT it, user_id, t, y, ri, rt, avg(y - g) OVER u AS a, (ri - sum(cg) OVER u) / count(*) OVER u AS ca FROM l WHERE it < 150 WINDOW u AS (PARTITION BY user_id)) WINDOW w AS (PARTITION BY t)),
     e AS (SELECT * FROM l WHERE it = 150),
     i AS (SELECT user_id, max(a) AS a, max(ca) AS ca FROM e GROUP BY 1), j AS (SELECT t, max(g) AS g, max(cg) AS cg FROM e GROUP BY 1),
     r AS (SELECT d.user_id, d.x, d.y - i.a - j.g AS u, i.ca + j.cg AS back FROM d JOIN i ON d.user_id = i.user_id JOIN j ON d.t = j.t),
     m AS (SELECT avg(u) FILTER (WHERE x = 1) AS b, sum(x) AS n1 FROM r),
     c AS (SELECT sum(CASE WHEN x = 1 THEN u - b ELSE -back * u END) AS q FROM r, m GROUP BY user_id)
SELECT 'is_treated' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum(q * q)) / max(n1), 6) AS std_error FROM c, m""",
)


def _lp(dy: str, keep: str, label: str) -> str:
    """One local projection, from rows w with the outcome's leads and lags: within periods, clustered by user."""
    return f"""(WITH s AS (SELECT user_id, t, {dy} AS dy, treat_diff AS x FROM w WHERE {dy} IS NOT NULL AND treat_diff IS NOT NULL AND ({keep})),
  q AS (SELECT user_id, t, dy - avg(dy) OVER (PARTITION BY t) AS y, x - avg(x) OVER (PARTITION BY t) AS x FROM s),
  m AS (SELECT count(*) AS n, sum(x * x) AS sxx, sum(x * y) / sum(x * x) AS b, count(DISTINCT t) AS kt, count(DISTINCT user_id) AS g FROM q),
  c AS (SELECT sum(x * (y - b * x)) AS k FROM q, m GROUP BY user_id)
SELECT '{label}' AS coefficient, round(max(b), 6) AS estimate, round(sqrt(sum(k * k) / max(sxx) ^ 2 * max(g) / (max(g) - 1) * (max(n) - 1) / (max(n) - 1 - max(kt))), 6) AS std_error FROM c, m)"""


_LP = _DID + """, e AS (SELECT *, (g > 0 AND t >= g)::INT AS d FROM p),
     w AS (SELECT *, lag(y) OVER u AS y_lag, greatest(d - lag(d) OVER u, 0) AS treat_diff, lead(d, 2) OVER u AS far2, lead(d, 1) OVER u AS far1, lead(y, 1) OVER u AS y1, lag(y, 2) OVER u AS y_2,
                  CASE WHEN count(y) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 THEN avg(y) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) END AS ahead
           FROM e WINDOW u AS (PARTITION BY user_id ORDER BY t)) """
_replace_sql("lpdid_att", _LP.replace("greatest(d - lag(d) OVER u, 0)", "CASE WHEN lag(d) OVER u IS NOT NULL THEN greatest(d - lag(d) OVER u, 0) END") + "SELECT * FROM " + _lp("(ahead - y_lag)", "treat_diff = 1 OR far2 = 0", "ATT"))
_LPH = _LP.replace("greatest(d - lag(d) OVER u, 0)", "CASE WHEN lag(d) OVER u IS NOT NULL THEN greatest(d - lag(d) OVER u, 0) END")


@_query(_LPH + " UNION ALL ".join([_lp("(y - y_lag)", "treat_diff = 1 OR d = 0", "time_to_treatment::0"), _lp("(y1 - y_lag)", "treat_diff = 1 OR far1 = 0", "time_to_treatment::1"), _lp("(y_2 - y_lag)", "treat_diff = 1 OR d = 0", "time_to_treatment::-2")]))
def lpdid_horizons(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import lpdid

    t = lpdid(_did(spark, sf), "y", "user_id", "t", "g", att=False, pre_window=2, post_window=1)
    return _rows(spark, [(str(i), round(float(r["Estimate"]), 6), round(float(r["Std. Error"]), 6)) for i, r in t.iterrows()], "coefficient string, estimate double, std_error double")


def _balanced(spark: SparkSession, sf: str) -> DataFrame:
    """User by ten periods of three days, empty cells zero; users adopt in period 4 or 6, or never."""
    e = _t(spark, sf, "events")
    cell = e.select("user_id", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 3).cast("int").alias("t"), "value").where("t between 0 and 9")
    wide = cell.groupBy("user_id").pivot("t", list(range(10))).agg(F.avg("value")).na.fill(0.0)
    p = wide.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col(str(k)).alias("y")) for k in range(10)])).alias("r")).select("user_id", "r.t", "r.y")
    k = F.col("user_id") % 3
    return p.withColumn("g", F.when(k == 0, 0).when(k == 1, 4).otherwise(6)).persist()  # ten rows a user, read by every pass of a fit


_BAL = """
WITH p AS (SELECT u.user_id, r.t, coalesce(c.y, 0) AS y, CASE u.user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 6 END AS g
           FROM (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31') u CROSS JOIN range(10) r(t)
           LEFT JOIN (SELECT user_id, CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 3) AS INT) AS t, avg(value) AS y FROM events GROUP BY 1, 2) c ON c.user_id = u.user_id AND c.t = r.t),
     c AS (SELECT g, t, avg(y) AS m, count(*) AS n FROM p GROUP BY 1, 2),
     x AS (SELECT a.g, a.t - a.g AS r, a.n, (a.m - b.m) - (z.m - y.m) AS est FROM c a JOIN c b ON b.g = a.g AND b.t = a.g - 1 JOIN c z ON z.g = 0 AND z.t = a.t JOIN c y ON y.g = 0 AND y.t = a.g - 1 WHERE a.g > 0 AND a.t <> a.g - 1)
"""


@_query(_BAL + "SELECT g::DOUBLE AS cohort, r::DOUBLE AS period, round(est, 6) AS estimate FROM x")
def saturated_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort by event-time effects on a balanced panel are differences of cohort means."""
    from ..operators.did import event_study

    m = event_study(_balanced(spark, sf), "y", "user_id", "t", "g", estimator="saturated")
    return _rows(spark, [(float(m.labels[n][0]), float(m.labels[n][1]), round(float(b), 6)) for n, b in zip(m.model.coefnames, m.model.beta, strict=True)], "cohort double, period double, estimate double")


@_query(_BAL + "SELECT r::DOUBLE AS period, round(sum(n * est) / sum(n), 6) AS estimate FROM x GROUP BY r")
def saturated_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import event_study

    t = event_study(_balanced(spark, sf), "y", "user_id", "t", "g", estimator="saturated").aggregate()
    return _rows(spark, [(float(r), round(float(e), 6)) for r, e in t["Estimate"].items()], "period double, estimate double")


@_query(_BAL + "SELECT user_id, " + ", ".join(f'max(CASE WHEN t = {k} THEN (g > 0 AND t >= g)::INT END) AS "{k}"' for k in range(10)) + " FROM p GROUP BY user_id")
def panelview_frame(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import did_columns, panelview

    return panelview(did_columns(_balanced(spark, sf), "user_id", "t", "g"), "user_id", "t", "is_treated")


@_query(_BAL + "SELECT CASE WHEN g > 0 THEN g END AS first_treated_period, t, round(m, 6) AS mean_outcome FROM c")
def panelview_cohorts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.did import did_columns, panelview

    d = did_columns(_balanced(spark, sf), "user_id", "t", "g").drop("first_treated_period")
    return panelview(d, "user_id", "t", "is_treated", "y", collapse_to_cohort=True).withColumn("mean_outcome", F.round("mean_outcome", 6))
