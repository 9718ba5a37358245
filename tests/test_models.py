import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regmesh.api import feglm, feols, fepois
from regmesh.errors import DepvarIsNotNumericError, DepvarOutsideDomainError, NanInClusterVarError, NonPositiveWeightsError, VcovTypeNotSupportedError
from regmesh.operators.absorb import Demeaner, drop_singletons
from regmesh.sources.generators import akm_panel, get_bartik_data, get_data


@pytest.fixture(scope="module")
def data(spark):
    return get_data(spark, 1000).cache()


@pytest.fixture(scope="module")
def frame(data):
    return data.toPandas()


def dummies(p, fe):
    return np.column_stack([pd.get_dummies(p[f]).to_numpy(float) for f in fe])


def brute(p, y, x, fe=(), w=None, intercept=True):
    """Dummy-variable least squares: coefficients of x, their bread, residuals and the design."""
    p = p.dropna(subset=[y, *x, *fe, *([w] if w else [])])
    while True:
        keep = np.ones(len(p), bool)
        for f in fe:
            keep &= p[f].map(p[f].value_counts()).to_numpy() > 1
        if keep.all():
            break
        p = p[keep]
    ws = p[w].to_numpy() if w else np.ones(len(p))
    m = p[list(x)].to_numpy(float)
    if fe:
        m = np.column_stack([m, dummies(p, fe)])
    elif intercept:
        m = np.column_stack([np.ones(len(p)), m])
    s = np.sqrt(ws)[:, None]
    beta = np.linalg.lstsq(m * s, p[y].to_numpy() * s[:, 0], rcond=None)[0]
    u = p[y].to_numpy() - m @ beta
    return p, beta, np.linalg.pinv((m * s).T @ (m * s)), u, m, ws


@pytest.mark.parametrize("fe", [[], ["f1"], ["f1", "f2"], ["f1", "f2", "f3"]])
@pytest.mark.parametrize("w", [None, "weights"])
def test_least_squares_with_effects(data, frame, fe, w):
    m = feols("Y ~ X1 + X2" + (" | " + " + ".join(fe) if fe else ""), data, weights=w)
    p, beta, bread, u, x, ws = brute(frame, "Y", ["X1", "X2"], fe, w)
    k = slice(0, 2) if fe else slice(0, 3)
    assert np.allclose(m.beta, beta[k], atol=1e-8) and m.n == len(p)
    assert np.allclose(m.rss, (ws * u * u).sum())
    rank = np.linalg.matrix_rank(x)
    k_fe = sum(m.k_fe) - (len(fe) - 1) if len(fe) > 1 else sum(m.k_fe)
    assert np.allclose(m.se(), np.sqrt(np.diag(bread)[k] * (ws * u * u).sum() / (len(p) - m.k - k_fe)), rtol=1e-6) and rank <= m.k + k_fe
    xd = np.delete(x * np.sqrt(ws)[:, None], np.s_[k], axis=1)
    part = (x * np.sqrt(ws)[:, None])[:, k]
    part = part - xd @ np.linalg.lstsq(xd, part, rcond=None)[0] if fe else part
    s = part * (np.sqrt(ws) * u)[:, None]
    br = np.linalg.inv(part.T @ part)
    m.vcov("hetero")
    assert np.allclose(m.V, br @ s.T @ s @ br * len(p) / (len(p) - m.k - k_fe), rtol=1e-6)
    g = pd.DataFrame(s).groupby(p["group_id"].to_numpy()).sum().to_numpy()
    m.vcov({"CRV1": "group_id"})
    assert np.allclose(m.V, br @ g.T @ g @ br * len(g) / (len(g) - 1) * (len(p) - 1) / (len(p) - m.k - k_fe), rtol=1e-6)


def test_sweeps_match_the_level_solve(data):
    a, b = (feols("Y ~ X1 + X2 | f1 + f2", data, demeaner=Demeaner(method=c, tol=1e-12)) for c in ("cg", "map"))
    assert np.allclose(a.beta, b.beta, atol=1e-6) and a.n == b.n


@pytest.mark.parametrize("fe", ["f1 + f2", "f1 + f2 + f3"])
def test_levels_solved_by_groups_match_the_driver(data, fe):
    """max_cells=0: no cell comes to the driver."""
    for w in (None, "weights"):
        a, b = (feols(f"Y ~ X1 + X2 | {fe}", data, weights=w, vcov={"CRV1": "group_id"}, max_cells=c) for c in (None, 0))
        assert np.allclose(a.beta, b.beta, atol=1e-8) and np.allclose(a.V, b.V, atol=1e-8) and a.n == b.n and a.k_fe == b.k_fe
        assert b.absorbed.local is None and b.absorbed.gap < 1e-8
    fx = [m.fixef().orderBy("variable", "level").toPandas() for m in (a, b)]
    assert np.allclose(fx[0].coefficient, fx[1].coefficient, atol=1e-6) and (fx[0].level == fx[1].level).all()


def test_other_estimators_without_cells_on_the_driver(spark, data):
    from regmesh.operators.did import event_study

    d = get_data(spark, 500, model="Fepois")
    a, b = (fepois("Y ~ X1 + X2 | f1 + f2", d, max_cells=c) for c in (None, 0))
    assert np.allclose(a.beta, b.beta, atol=1e-7) and np.allclose(a.se(), b.se(), atol=1e-7)
    rng = np.random.default_rng(3)
    p = pd.DataFrame([(u, t, (0, 5, 7)[u % 3]) for u in range(60) for t in range(10) if rng.random() < 0.95], columns=["u", "t", "g"])
    p["y"] = rng.normal(size=len(p)) + p.u * 0.1 + p.t * 0.2 + ((p.g > 0) & (p.t >= p.g))
    panel = spark.createDataFrame(p)
    from regmesh.operators import absorb as module

    one, two = (event_study(panel, "y", "u", "t", "g", estimator="did2s", att=False, max_cells=c) for c in (None, 0))
    assert np.allclose(one.beta, two.beta, atol=1e-8) and np.allclose(one.se(), two.se(), atol=1e-8)
    cells = panel.groupBy("u", "t").agg(F.count(F.lit(1)).alias("w"), F.sum("y").alias("s0"), F.sum(F.col("y") * F.col("t")).alias("s1"))
    x, z = (module.solve_cells(cells, ["u", "t"], "w", ["s0", "s1"], 1e-12, 1000, c) for c in (10**6, 0))
    assert np.allclose(x.cross, z.cross, atol=1e-6) and z.local is None


def test_sparse_graphs_leave_no_gap(spark):
    m = feols("y ~ x1 | indiv_id + firm_id + year", akm_panel(spark, 300, 40, 6, move=0.05))
    assert m.absorbed.gap < 1e-6 and abs(m.beta[0] - 1) < 0.1


def test_crv3_and_hc(data, frame):
    m = feols("Y ~ X1 + X2", data, vcov={"CRV3": "group_id"})
    p, beta, *_ = brute(frame, "Y", ["X1", "X2"])
    groups = p["group_id"].unique()
    d = np.array([brute(p[p["group_id"] != g], "Y", ["X1", "X2"])[1] - beta for g in groups])
    assert np.allclose(m.V, d.T @ d * len(groups) / (len(groups) - 1) * (len(p) - 1) / (len(p) - 3), rtol=1e-6)
    few = data.where("group_id < 4")
    a = feols("Y ~ X1 + X2 | f2", few, vcov={"CRV3": "group_id"})
    assert (a.se() > 0).all()
    for bad in ("HC2", {"CRV2": "f1"}, "unknown"):
        with pytest.raises(VcovTypeNotSupportedError):
            feols("Y ~ X1 | f1", data, vcov=bad)


@pytest.mark.parametrize("family", ["poisson", "logit", "probit", "gaussian"])
def test_crv3_of_other_families_refits(spark, family):
    rng = np.random.default_rng(7)
    g = rng.integers(0, 5, 400)
    x = rng.normal(size=400)
    eta = 0.4 * x + 0.3 * rng.normal(size=5)[g]
    y = rng.poisson(np.exp(eta)) if family == "poisson" else (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(int) if family != "gaussian" else eta + rng.normal(size=400)
    p = pd.DataFrame({"y": y.astype(float), "x": x, "g": g, "o": 0.1 * x if family == "poisson" else 0.0, "w": rng.uniform(0.5, 2, 400)})
    d = spark.createDataFrame(p)
    how = {"offset": "o"} if family == "poisson" else {}
    m = feglm("y ~ x", d, family, vcov={"CRV3": "g"}, weights="w", **how)
    dev = np.array([feglm("y ~ x", spark.createDataFrame(p[p.g != k]), family, weights="w", iwls_tol=1e-12, **how).beta - m.beta for k in range(5)])
    assert np.allclose(m.V, dev.T @ dev * 5 / 4 * 399 / 398, rtol=1e-4)


def test_crv3_with_effects_refits_the_same_family(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"g": np.arange(300) % 4, "f": np.arange(300) % 3, "x": rng.normal(size=300)})
    p["y"] = (rng.random(300) < 1 / (1 + np.exp(-0.5 * p.x))).astype(float)
    m = feglm("y ~ x | f", spark.createDataFrame(p), "logit", vcov={"CRV3": "g"})
    dev = np.array([feglm("y ~ x | f", spark.createDataFrame(p[p.g != k]), "logit").beta - m.beta for k in range(4)])
    assert np.allclose(m.V, dev.T @ dev * 4 / 3 * 299 / (300 - 4), rtol=1e-6)


def test_frequency_weights_are_rows(spark, data):
    d = data.select("Y", "X1", "X2").dropna().limit(300).withColumn("n", (F.pmod(F.xxhash64("Y"), F.lit(3)) + 1).cast("int"))
    rows = d.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    for v in ("iid", "hetero"):
        a, b = feols("Y ~ X1 + X2", d, vcov=v, weights="n", weights_type="fweights"), feols("Y ~ X1 + X2", rows, vcov=v)
        assert np.allclose(a.beta, b.beta) and np.allclose(a.se(), b.se(), rtol=1e-6) and a.n == b.n


def test_instruments(spark):
    d = get_bartik_data(spark, 500)
    m = feols("wages ~ log_population | immigration ~ bartik_instrument", d, vcov="hetero")
    p = d.toPandas()
    x = np.column_stack([np.ones(500), p.log_population, p.immigration])
    z = np.column_stack([np.ones(500), p.log_population, p.bartik_instrument])
    hat = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    beta = np.linalg.solve(hat.T @ x, hat.T @ p.wages)
    u = p.wages.to_numpy() - x @ beta
    br = np.linalg.inv(hat.T @ hat)
    assert m.coefnames == ["Intercept", "log_population", "immigration"] and np.allclose(m.beta, beta)
    assert np.allclose(m.V, br @ (hat.T * u**2) @ hat @ br * 500 / 497, rtol=1e-6)
    assert m.iv_diag()["f_stat"] > 10


def test_formula_terms(data, frame):
    m = feols("Y ~ X1 * X2 + I(X2 ** 2) + C(group_id)", data)
    p = frame.dropna(subset=["Y", "X1", "X2", "group_id"])
    cols = [np.ones(len(p)), p.X1, p.X2, p.X1 * p.X2, p.X2**2, *[(p.group_id == g).astype(float) for g in sorted(p.group_id.unique())[1:]]]
    beta = np.linalg.lstsq(np.column_stack(cols), p.Y, rcond=None)[0]
    assert np.allclose(np.sort(m.beta), np.sort(beta), atol=1e-7) and "C(group_id)[T.1.0]" in m.coefnames
    poly = feols("Y ~ poly(X2, 2)", data)
    square = feols("Y ~ X2 + I(X2**2)", data)
    assert np.isclose(poly.rss, square.rss) and poly.coefnames[1:] == ["poly(X2, 2)[1]", "poly(X2, 2)[2]"]
    slopes = feols("Y ~ i(group_id, X1, ref=0) | group_id", data)
    assert "group_id::0.0:X1" not in slopes.coefnames and "group_id::1.0:X1" in slopes.coefnames
    both = feols("Y ~ i(X1, group_id, ref=0, bin2={'low': [0, 1, 2]})", data)
    assert any(n.endswith("::low") for n in both.coefnames)
    own = feols("Y ~ twice(X1)", data, context={"twice": lambda c: 2 * c})
    assert np.isclose(own.beta[1] * 2, feols("Y ~ X1", data).beta[1])


def test_collinear_and_empty(data):
    m = feols("Y ~ X1 + X2 + I(X1 + X2)", data)
    assert m.collinear == ["I(X1 + X2)"]
    e = feols("Y ~ 1 | f1", data)
    assert e.k == 0 and abs(e.resid().agg(F.avg("resid")).first()[0]) < 1e-9


def test_multiple_models_and_samples(data):
    ms = feols("Y + Y2 ~ csw(X1, X2) | sw0(f1, f2)", data)
    assert len(ms) == 12 and set(ms.tidy().index.names) == {"fml", "Coefficient"}
    one = feols("Y ~ X1 + X2 | f2", data)
    assert np.allclose(ms.fetch_model("Y ~ X1 + X2 | f2").beta, one.beta)
    halves = feols("Y ~ X2", data.withColumn("part", F.when(F.col("X1") > 0, "a").when(F.col("X1") == 0, "b")), fsplit="part")
    assert [m.sample[1] for m in halves.to_list()] == ["all", "a", "b"] and halves[0].n == halves[1].n + halves[2].n


def test_samples_share_one_aggregation(data):
    d = data.withColumn("part", F.when(F.col("f2") < 3, "a").when(F.col("f2") < 6, "b").when(F.col("f2") < 8, "all"))
    for w in (None, "weights"):
        ms = feols("Y + Y2 ~ X1 + I(X2**2)", d, fsplit="part", weights=w, vcov="HC1").to_list()
        assert len(ms) == 8 and sum(m._given is not None for m in ms) == 8
        for m in ms:
            one = feols(f"{m.formula.depvar} ~ X1 + I(X2**2)", d.where(F.col("part").isNotNull() if m is ms[0] or m is ms[1] else F.col("part") == m.sample[1]), weights=w, vcov="HC1")
            assert np.allclose(m.beta, one.beta, atol=1e-9) and np.allclose(m.V, one.V, atol=1e-9) and m.n == one.n and np.isclose(m.r2, one.r2)
    assert feols("Y ~ C(f1)", d, split="part").to_list()[0]._given is None
    full = data.dropna()
    for d, shared in ((full, 4), (data, 0)):  # with gaps that differ by regressor, models keep their own rows
        ms = feols("Y2 ~ csw0(X1, X2, Z1)", d, vcov="HC1").to_list()
        assert sum(m._given is not None for m in ms) == (shared if shared else sum(m.n == ms[-1].n for m in ms))
        for m in ms:
            one = feols(m.formula.text, d, vcov="HC1")
            assert np.allclose(m.beta, one.beta, atol=1e-9) and np.allclose(m.V, one.V, atol=1e-9) and m.n == one.n


def test_prediction_and_effects(spark, data, frame):
    m = feols("Y ~ X1 + X2 | f1 + f2", data)
    got = m.predict().select("Y", "fit").join(m.resid().select("Y", "resid"), "Y").toPandas()
    assert np.allclose(got.Y - got.fit, got.resid, atol=1e-8)
    fx = m.fixef().toPandas()
    assert fx[fx.variable == "f2"].sort_values("level", key=lambda s: s.astype(float)).coefficient.iloc[0] == pytest.approx(0, abs=1e-9)
    new = data.limit(3).withColumn("f1", F.lit(-99.0))
    assert m.predict(new).where("fit is null").count() == 3
    plain = feols("Y ~ X1 + X2", data)
    t = plain.predict(se_fit=True, interval="prediction").toPandas().dropna()
    x = np.column_stack([np.ones(len(t)), t.X1, t.X2])
    assert np.allclose(t.se_fit, np.sqrt(np.einsum("ij,jk,ik->i", x, plain.V, x))) and (t.ci_low < t.fit).all()


def test_inference_helpers(data):
    m = feols("Y ~ X1 + X2", data)
    assert m.wald_test()["pvalue"] < 1e-6 and m.wald_test(distribution="chi2")["dfn"] == 3
    joint, own = m.confint(joint=True, seed=1), m.confint()
    assert (joint.iloc[:, 1] - joint.iloc[:, 0] > own.iloc[:, 1] - own.iloc[:, 0]).all()
    f = m.tidy_frame()
    assert f.columns == ["coefficient", "estimate", "std_error", "t_value", "p_value", "ci_low", "ci_high"] and f.count() == 3


def test_rejected_inputs(data):
    with pytest.raises(NonPositiveWeightsError):
        feols("Y ~ X1", data.withColumn("w", F.lit(0.0)), weights="w")
    with pytest.raises(NanInClusterVarError):
        feols("Y ~ X2", data, vcov={"CRV1": "f1"})
    with pytest.raises(DepvarIsNotNumericError):
        feols("s ~ X1", data.withColumn("s", F.lit("a")))
    with pytest.raises(DepvarOutsideDomainError):
        feglm("Y ~ X1", data, "logit")
    with pytest.raises(DepvarOutsideDomainError):
        fepois("Y ~ X1", data)


SINGLETONS = [
    ([(0, 2, 1), (0, 2, 1), (0, 1, 3), (0, 1, 2), (0, 1, 2)], [2]),
    ([(0, 2, 1), (0, 2, 1), (3, 1, 2), (0, 1, 1), (0, 1, 2)], [2, 3, 4]),
    ([(0, 2, 1), (0, 2, 1), (0, 1, 1), (0, 1, 2), (0, 1, 2)], []),
]


@pytest.mark.parametrize("rows, gone", SINGLETONS)
@pytest.mark.parametrize("cells", [5_000_000, 0])
def test_singletons_cascade(spark, rows, gone, cells):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, b int, c int")
    kept, n = drop_singletons(df, ["a", "b", "c"], cells)
    assert sorted(set(range(len(rows))) - {r.i for r in kept.collect()}) == gone and n == len(gone)


def irls(p, x, y, inverse, weight, response, rounds=60):
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        eta = x @ beta
        mu = inverse(eta)
        w, z = weight(mu, eta), response(eta, mu, y)
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
    return beta, np.linalg.pinv((x * w[:, None]).T @ x)


def test_poisson_with_effects(spark):
    d = get_data(spark, 600, model="Fepois")
    p = d.toPandas().dropna(subset=["Y", "X1", "X2", "f1", "f2"])
    m = fepois("Y ~ X1 + X2 | f1 + f2", d, fixef_rm="none", separation_check=[])
    x = np.column_stack([p.X1, p.X2, dummies(p, ["f1", "f2"])])
    beta, cov = irls(p, x, p.Y.to_numpy(), np.exp, lambda mu, e: mu, lambda e, mu, y: e + (y - mu) / mu)
    assert np.allclose(m.beta, beta[:2], atol=1e-6) and m.converged
    fit = m.predict(type="response").agg(F.sum("fit"), F.sum("Y")).first()
    assert fit[0] == pytest.approx(fit[1], rel=1e-6)
    assert m.loglik()["pseudo_r2"] > 0


@pytest.mark.parametrize("family", ["logit", "probit"])
def test_binary_families(data, frame, family):
    from regmesh.functions.distributions import norm_cdf, norm_pdf

    d = data.withColumn("b", (F.col("Y") > 1).cast("int")).where("Y is not null")
    m = feglm("b ~ X1 + X2", d, family)
    p = d.toPandas().dropna(subset=["X1"])
    x = np.column_stack([np.ones(len(p)), p.X1, p.X2])
    if family == "logit":
        inv, w = lambda e: 1 / (1 + np.exp(-e)), lambda mu, e: mu * (1 - mu)
        beta, cov = irls(p, x, p.b.to_numpy(), inv, w, lambda e, mu, y: e + (y - mu) / (mu * (1 - mu)))
    else:
        cdf, pdf = np.vectorize(norm_cdf), np.vectorize(norm_pdf)
        beta, cov = irls(p, x, p.b.to_numpy(), cdf, lambda mu, e: pdf(e) ** 2 / (mu * (1 - mu)), lambda e, mu, y: e + (y - mu) / pdf(e))
    assert np.allclose(m.beta, beta, atol=1e-6)
    assert np.allclose(m.V, cov * (len(p) - 1) / (len(p) - 3), rtol=1e-4)


def test_gaussian_family_and_offset(spark, data):
    a, b = feglm("Y ~ X1 + X2 | f1", data, "gaussian"), feols("Y ~ X1 + X2 | f1", data)
    assert np.allclose(a.beta, b.beta, atol=1e-8) and np.allclose(a.se(), b.se(), rtol=1e-6)
    d = get_data(spark, 400, model="Fepois").withColumn("o", F.col("X2") * 0.1)
    with_offset, without = fepois("Y ~ X1 + X2", d, offset="o"), fepois("Y ~ X1 + X2", d)
    assert with_offset.beta[2] == pytest.approx(without.beta[2] - 0.1, abs=1e-6)


def test_separation(spark):
    rows = [(0, "a", 1.0), (0, "a", 2.0), (0, "b", 0.5), (1, "b", 1.5), (2, "b", 0.1), (3, "c", 1.0), (4, "c", 2.0)]
    d = spark.createDataFrame(rows, "Y int, fe1 string, x double")
    with pytest.warns(UserWarning, match="separation"):
        m = fepois("Y ~ x | fe1", d)
    assert m.n_separated == 2 and m.n_rows == 5
    # a regressor that is positive only where the outcome is zero
    sep = spark.createDataFrame([(y, x, f) for f in (0, 1) for y, x in [(0, 1.0), (0, 2.0), (1, 0.0), (2, 0.0), (3, 0.0), (0, 0.0)]], "y int, x1 double, id1 int")
    with pytest.warns(UserWarning, match="separation"):
        m = fepois("y ~ x1 | id1", sep, separation_check=["ir"])
    assert m.n_separated == 4
