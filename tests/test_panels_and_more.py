import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regmesh.api import feols
from regmesh.operators.decompose import decompose
from regmesh.operators.did import did2s, event_study, interaction_weights, lpdid, panelview
from regmesh.operators.multiple import bonferroni, rwolf, wyoung
from regmesh.operators.quantreg import quantreg
from regmesh.operators.resample import ccv, ritest, wildboottest
from regmesh.operators.savi import joint_e_value, optimal_precision, savi
from regmesh.report import coefplot_frame, decomposition_frame, etable, iplot_frame, qplot_frame, relabel, summary
from regmesh.sources import frames, generators
from regmesh.streaming.update import OlsState, coefficients_of, stream_ols, update, windowed_moments


@pytest.fixture(scope="module")
def panel(spark):
    return generators.get_panel_dgp_stagg(spark, 120, 16, cohorts=(6, 10)).cache()


def test_two_stages_match_dummies(panel):
    m = event_study(panel, "Y_it", "unit_id", "time_id", "g", estimator="did2s")
    p = panel.toPandas()
    d = np.column_stack([pd.get_dummies(p.unit_id), pd.get_dummies(p.time_id)]).astype(float)
    free = p.W_it.to_numpy() == 0
    first = np.linalg.lstsq(d[free], p.Y_it.to_numpy()[free], rcond=None)[0]
    y1 = p.Y_it.to_numpy() - d @ first
    x2 = p.W_it.to_numpy(float)[:, None]
    beta = np.linalg.lstsq(x2, y1, rcond=None)[0]
    d0 = d * free[:, None]
    gamma = np.linalg.pinv(d0.T @ d0) @ (d.T @ x2)
    score = x2 * (y1 - x2 @ beta)[:, None] - (d0 @ gamma) * y1[:, None]
    g = pd.DataFrame(score).groupby(p.unit_id).sum().to_numpy()
    br = np.linalg.inv(x2.T @ x2)
    assert np.allclose(m.beta, beta) and np.allclose(m.V, br @ g.T @ g @ br, rtol=1e-6)


def test_two_stages_with_covariates_and_weights(panel):
    d = panel.withColumn("x", F.col("time_intercept") * F.pmod(F.col("unit_id"), F.lit(5))).withColumn("w", 1.0 + F.pmod(F.col("unit_id"), F.lit(3)))
    m = did2s(d, "Y_it", "~ x | unit_id + time_id", "~ i(W_it, ref=0)", "W_it", "unit_id", weights="w")
    assert m.k == 1 and m.se()[0] > 0


def test_estimators_agree_on_the_effect(panel):
    saturated = event_study(panel, "Y_it", "unit_id", "time_id", "g", estimator="saturated")
    a = saturated.aggregate()
    assert abs(a.loc[a.index < -1, "Estimate"]).max() < 0.6 and a.loc[a.index >= 0, "Estimate"].mean() > 0.3
    assert 0 <= saturated.test_treatment_heterogeneity()["pvalue"] <= 1
    assert event_study(panel, "Y_it", "unit_id", "time_id", "g").beta[0] > 0.2
    assert len(event_study(panel, "Y_it", "unit_id", "time_id", "g", att=False).beta) > 5
    assert lpdid(panel, "Y_it", "unit_id", "time_id", "g", post_window=2).loc["ATT", "Estimate"] > 0.2
    long = lpdid(panel, "Y_it", "unit_id", "time_id", "g", att=False, pre_window=2, post_window=1)
    assert list(long.index) == ["time_to_treatment::0", "time_to_treatment::1", "time_to_treatment::-2"]
    with pytest.raises(ValueError):
        event_study(panel, "Y_it", "unit_id", "time_id", "g", estimator="other")


def test_panel_frames(panel):
    v = panelview(panel, "unit_id", "time_id", "W_it", sort_by_timing=True, subsamp=10)
    assert v.count() == 10 and "16" in v.columns
    assert panelview(panel, "unit_id", "time_id", "W_it", outcome="Y_it", collapse_to_cohort=True).count() == 3 * 16
    shares = interaction_weights(panel, "unit_id", "time_id", "g").groupBy("period").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in shares)


def test_hac_panels(panel):
    nw = feols("Y_it ~ W_it", panel, vcov="NW", vcov_kwargs={"time_id": "time_id", "panel_id": "unit_id", "lag": 2})
    p = panel.toPandas().sort_values(["unit_id", "time_id"])
    x = np.column_stack([np.ones(len(p)), p.W_it])
    s = pd.DataFrame(x * (p.Y_it.to_numpy() - x @ nw.beta)[:, None]).assign(u=p.unit_id.to_numpy())
    meat = s[[0, 1]].T.to_numpy() @ s[[0, 1]].to_numpy()
    for lag, w in ((1, 2 / 3), (2, 1 / 3)):
        gamma = sum(g[[0, 1]].to_numpy()[lag:].T @ g[[0, 1]].to_numpy()[:-lag] for _, g in s.groupby("u"))
        meat = meat + w * (gamma + gamma.T)
    br = np.linalg.inv(x.T @ x)
    n = len(p)
    assert np.allclose(nw.V, br @ meat @ br * (n - 1) / (n - 2) * 16 / 15, rtol=1e-6)
    with pytest.raises(ValueError):
        feols("Y_it ~ W_it", panel, vcov="NW", vcov_kwargs={"time_id": "time_id", "lag": 1})


@pytest.fixture(scope="module")
def data(spark):
    return generators.get_data(spark, 800).cache()


def test_a_long_series_is_numbered_by_ranges(spark, data):
    m = feols("Y ~ X1 + X2", data)
    rng = np.random.default_rng(1)
    series = spark.createDataFrame(pd.DataFrame({"__t": rng.permutation(500), **{f"g{j}": rng.normal(size=500) for j in range(3)}})).repartition(7)
    assert np.allclose(m._bartlett_series(series, 3), m._bartlett_series(series, 3, most=0), atol=1e-9)


def test_quantiles_by_brackets_are_exact(spark):
    from regmesh.operators.quantreg import exact_quantiles

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=30_000), np.full(9_000, 0.25), rng.integers(-3, 3, 5_000)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    probs = [0.0, 0.001, 0.25, 0.5, 0.61803, 1.0]
    got = exact_quantiles(df, F.col("v"), probs, few=0, accuracy=500)
    assert np.allclose(got, np.quantile(v, probs), atol=1e-12) and np.allclose(exact_quantiles(df, F.col("v"), probs), got, atol=1e-12)


def test_wild_bootstrap(data):
    null = data.withColumn("noise", F.rand(3)).cache()
    m = feols("Y ~ noise + X2", null, vcov={"CRV1": "group_id"})
    r = wildboottest(m, 499, "noise", seed=1)
    assert abs(r["Pr(>|t|)"] - m.pvalue()[1]) < 0.25
    assert wildboottest(m, 199, "X2", seed=1)["Pr(>|t|)"] < 0.05
    with pytest.raises(ValueError, match="one cluster variable"):
        wildboottest(feols("Y ~ X2", data.dropna(), vcov={"CRV1": "group_id + f1"}), 9, "X2")
    kept = m.V.copy()
    wildboottest(m, 9, "X2", cluster="f2")
    assert np.array_equal(kept, m.V)


def brute_wild(x, y, groups, at, signs):
    """Sample t and drawn t, by refits of every drawn outcome. x: all regressors, dummies too."""
    g, codes = len(np.unique(groups)), np.unique(groups, return_inverse=True)[1]
    bread = np.linalg.pinv(x.T @ x)
    rest = np.delete(x, at, axis=1)

    def t_of(y):
        beta = bread @ x.T @ y
        u = y - x @ beta
        s = np.stack([x[codes == c].T @ u[codes == c] for c in range(g)])
        return beta[at] / np.sqrt((bread @ s.T @ s @ bread)[at, at])

    fit = rest @ np.linalg.pinv(rest) @ y
    return t_of(y), np.array([t_of(fit + v[codes] * (y - fit)) for v in signs])


@pytest.mark.parametrize("fe", ["", " | f2", " | seven"])
def test_wild_bootstrap_lists_all_signs_and_takes_effects(data, fe):
    d = data.dropna().withColumn("seven", F.pmod("group_id", F.lit(7))).withColumn("noise", F.rand(5) + F.col("X1") * 0.1).cache()
    p = d.toPandas()
    m = feols(f"Y ~ noise + X2{fe}", d, vcov={"CRV1": "seven"}, fixef_rm="none")
    x = np.column_stack([p.noise, p.X2, *([pd.get_dummies(p[fe[3:]]).to_numpy(float)] if fe else [np.ones(len(p))])])
    signs = np.array(np.meshgrid(*[[-1.0, 1.0]] * 7)).reshape(7, -1).T
    t, drawn = brute_wild(x, p.Y.to_numpy(), p.seven.to_numpy(), 0, signs)
    r = wildboottest(m, 128, "noise")
    assert r["Pr(>|t|)"] == pytest.approx(np.mean(np.abs(drawn) >= abs(t) * (1 - 1e-9)))


def test_cluster_variance_by_a_plain_loop(spark, data):
    """The published sums, cluster by cluster, on the same split."""
    d = data.dropna().withColumn("D", (F.col("Z1") > 1).cast("double")).select("Y", "D", "X1", "group_id").cache()
    m = feols("Y ~ D + X1", d, vcov={"CRV1": "group_id"})
    rows = m.score_rows().withColumn("__row", F.monotonically_increasing_id()).withColumn("z", F.pmod(F.xxhash64("__row", F.lit(0), F.lit(0)), F.lit(2)) == 1).toPandas()
    ols = lambda t: np.linalg.lstsq(np.column_stack([np.ones(len(t)), t.D, t.X1]), t.Y, rcond=None)[0]
    fit, score, n = rows[rows.z], rows[~rows.z], len(rows)
    coef = ols(fit)
    w, z = fit.D.mean(), len(score) / n
    parts = spread = 0.0
    for c, t in rows.groupby("group_id"):
        a, b = t[t.z], t[~t.z]
        near = ols(a)[1] if a.D.nunique() > 1 else coef[1]
        full = ols(t)[1] if t.D.nunique() > 1 else m.beta[1]
        e = (b.D - w) * (b.Y - coef[0] - coef[1] * b.D - coef[2] * b.X1) - (near - coef[1]) * w * (1 - w)
        parts += e.sum() ** 2 / z**2 - (1 - z) / z**2 * (e**2).sum()
        spread += len(t) / n * (full - coef[1]) ** 2
    groups = rows.group_id.nunique()
    for pk in (1.0, 0.5):
        v = (parts / (n * w**2 * (1 - w) ** 2) + groups * (1 - pk) * spread) / n
        assert ccv(m, "D", "group_id", pk=pk, n_splits=1).loc["CCV", "Std. Error"] == pytest.approx(np.sqrt(v))
    with pytest.raises(ValueError, match="binary"):
        ccv(feols("Y ~ X1", d, vcov={"CRV1": "group_id"}), "X1", "group_id")


def test_randomisation_and_cluster_variance(data):
    d = data.withColumn("D", (F.col("Z1") > 1).cast("double"))
    m = feols("Y ~ D", d, vcov={"CRV1": "group_id"})
    r = ritest(m, "D", reps=48, seed=3)
    again = ritest(m, "D", reps=48, seed=3, batch=20)
    assert r["Pr(>|t|)"] < 0.1 and r["Pr(>|t|)"] == again["Pr(>|t|)"]
    assert 0 <= ritest(m, "D", reps=16, cluster="group_id", type="randomization-t")["Pr(>|t|)"] <= 1
    assert ccv(m, "D", "group_id", pk=0.5, qk=0.5, n_splits=2).loc["CCV", "Std. Error"] > 0


def test_several_hypotheses(data):
    ms = feols("Y + Y2 ~ X1 + X2", data, vcov={"CRV1": "group_id"})
    for fn, row in ((bonferroni, "Bonferroni Pr(>|t|)"), (lambda m, p: rwolf(m, p, 99, 1), "RW Pr(>|t|)"), (lambda m, p: wyoung(m, p, 99, 1), "WY Pr(>|t|)"), (lambda m, p: rwolf(m, p, 32, 1, "ri"), "RW Pr(>|t|)"), (lambda m, p: wyoung(m, p, 32, 1, "ri"), "WY Pr(>|t|)")):
        t = fn(ms, "X1")
        assert (t.loc[row].astype(float) >= t.loc["Pr(>|t|)"].astype(float) - 0.02).all()


def test_decomposition(spark):
    g = generators.gelbach_data(spark, 400)
    m = feols("y ~ x1 + x21 + x22 + x23", g)
    d = decompose(m, "x1", combine_covariates={"one": ["x21"], "rest": "x2[23]"}, reps=30)
    t = d.tidy()["coefficients"]
    assert t["direct_effect"] == pytest.approx(feols("y ~ x1", g).beta[1]) and t["explained_effect"] == pytest.approx(t["one"] + t["rest"])
    assert decomposition_frame(d)["end"].iloc[-1] == pytest.approx(t["unexplained_effect"]) and len(d.etable()) == 6


def test_decomposition_draws_rows_that_repeat(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=4000), np.full(2000, 3.0)])
    y = x + np.concatenate([rng.normal(size=4000), np.full(2000, 0.5)])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x}))
    draws = decompose(feols("y ~ x", df), "x", reps=300, seed=1).draws[:, 0]
    c = x - x.mean()
    beta = c @ y / (c @ c)
    u = y - y.mean() - beta * c
    assert draws.std() == pytest.approx(np.sqrt((c * u) @ (c * u)) / (c @ c), rel=0.2) and draws.mean() == pytest.approx(beta, abs=0.01)


def test_sequential_inference(data):
    m = feols("Y ~ X1 + X2", data)
    t = savi(m)
    ci = m.confint()
    assert (t.ci_low.to_numpy() < ci.iloc[:, 0].to_numpy()).all() and joint_e_value(m) > 20 and optimal_precision(500, 1) > 0
    with pytest.raises(ValueError):
        savi(feols("Y ~ X1 | f1", data))


def test_quantiles(data):
    whole, cut = quantreg("Y ~ X1 + X2", data, 0.3, vcov="nid"), quantreg("Y ~ X1 + X2", data, 0.3, direct_rows=200, vcov="iid")
    assert np.allclose(whole.beta, cut.beta, atol=1e-8) and (whole.se() > 0).all()
    many = quantreg("Y ~ X1 + X2", data, [0.25, 0.5, 0.75], vcov={"CRV1": "group_id"})
    assert many[0.25].beta[0] < many[0.5].beta[0] < many[0.75].beta[0] and len(qplot_frame(many)) == 9
    step = quantreg("Y ~ X1 + X2", data, [0.45, 0.5], multi_method="cfm2", vcov="hetero")
    assert np.allclose(step[0.45].beta, quantreg("Y ~ X1 + X2", data, 0.45).beta, atol=0.3)


def test_streams(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "value")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    s = stream_ols(spark, str(tmp_path / "in"), rows.schema, "value", ["user_id"])
    m = feols("value ~ user_id", rows)
    assert np.allclose(s.coef(), m.beta) and s.n == m.n and len(s.tidy()) == 2
    before = s.n
    s.add(rows, "value", batch=s.last_batch)
    assert s.n == before and s.merge(OlsState(["user_id"]).add(rows, "value")).n == 2 * before
    half = rows.where("user_id < 70")
    assert np.allclose(update(feols("value ~ user_id", half), rows.where("user_id >= 70")), m.beta)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_moments(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 days", "value", ["user_id"]).writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select * from wins").collect()
    assert sum(r.m0_0 for r in got) == rows.count() and len(coefficients_of(got[0], 3)) == 2


def test_tables_and_frames(data, capsys, tmp_path):
    ms = feols("Y + Y2 ~ X1 + i(group_id, ref=0)", data)
    t = etable(ms, keep="X1", labels={"X1": "Age"}, custom_model_stats={"Note": ["a", "b"]})
    assert "Age" in t.index and t.loc["Note"].tolist() == ["a", "b"]
    for kind in ("md", "html", "tex", "typst"):
        assert "X1" in etable(ms, type=kind, keep="X1", file_name=str(tmp_path / kind)) and (tmp_path / kind).exists()
    summary(ms)
    assert "Dep. var.: Y2" in capsys.readouterr().out
    assert set(coefplot_frame(ms, joint=True, seed=1)) >= {"joint_low", "label"} and iplot_frame(ms)["at"].is_monotonic_increasing is False
    assert relabel("C(f1)[T.2.0]", {"f1": "Firm"}, "{variable}={value_int}") == "Firm=2"


def test_sources(spark, tmp_path):
    for name in ("get_ivf_data", "get_bartik_data", "get_encouragement_data", "get_sharkfin", "get_blw", "get_twin_data", "get_worker_panel", "get_motherhood_event_study_data", "gelbach_data", "base_dgp", "akm_panel"):
        assert getattr(generators, name)(spark).limit(5).count() == 5
    df = generators.base_dgp(spark, 100, kind="difficult")
    for fmt in ("parquet", "csv", "json", "orc"):
        frames.write_table(df, str(tmp_path / f"t.{fmt}"), fmt)
        assert frames.read_table(spark, str(tmp_path / f"t.{fmt}"), columns=["y", "x1"]).count() == 100
    assert frames.intake(spark, df.toPandas()).count() == 100 and frames.intake(spark, df) is df
