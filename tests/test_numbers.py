import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regmesh.functions import columns, distributions as dist
from regmesh.operators.absorb import solve_levels
from regmesh.operators.multiple import step_down_max_t, step_down_min_p
from regmesh.operators.ols import Ssc, independent_columns, spd_inverse
from regmesh.operators.quantreg import interior_point


@pytest.mark.parametrize(
    "got, want",
    [
        (dist.t_sf(2.0, 10), 0.0366940174), (dist.t_ppf(0.975, 5), 2.5705818366), (dist.f_sf(3.0, 2, 10), 0.0953674316), (dist.chi2_sf(5.0, 3), 0.1717971443),
        (dist.chi2_ppf(0.95, 3), 7.8147279033), (dist.norm_ppf(0.975), 1.9599639845), (dist.norm_sf(1.0), 0.1586552539), (dist.t_sf(-1.0, 3), 0.8044988905),
    ],
)
def test_distributions(got, want):
    assert got == pytest.approx(want, abs=1e-9)


def test_columns(spark):
    xs = [-9.0, -7.5, -3.0, -0.4, 0.0, 0.7, 2.5, 8.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", columns.norm_cdf(F.col("x")).alias("p"), columns.log_gamma(F.abs("x") + 0.3).alias("g"), columns.clean_log(F.col("x")).alias("l")).collect()
    for r in got:
        assert r.p == pytest.approx(dist.norm_cdf(r.x), rel=1e-7)
        assert r.g == pytest.approx(math.lgamma(abs(r.x) + 0.3), abs=1e-10)
        assert (r.l is None) == (r.x <= 0)


def test_collinear_columns_go_left_to_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.zeros(50)])
    assert independent_columns(x.T @ x).tolist() == [True, True, True, False, False]
    a = x[:, :3].T @ x[:, :3]
    assert np.allclose(spd_inverse(a) @ a, np.eye(3))


def test_small_sample_factor():
    s = Ssc()
    assert s.factor("iid", 100, 3, 0, 0) == (99 / 97, 3, 97)
    assert s.factor("hetero", 100, 3, 0, 0)[0] == 100 / 97
    assert s.factor("CRV", 100, 2, 25, 2, 20, 1, 20) == (99 / (100 - 2 - 24 + 20 - 1) * 20 / 19, 7, 19)
    assert Ssc(k_adj=False, G_adj=False).factor("CRV", 100, 2, 0, 0, groups=20)[0] == 1.0


def test_level_solves_match_dummies():
    rng = np.random.default_rng(1)
    n = 400
    codes = [rng.integers(0, m, n) for m in (30, 12, 5)]
    codes = [np.unique(c, return_inverse=True)[1] for c in codes]
    sizes = [c.max() + 1 for c in codes]
    w, y = rng.uniform(0.5, 2, n), rng.normal(size=(n, 2))
    alphas, _, gap = solve_levels(codes, sizes, w, w[:, None] * y, 1e-12, 5000)
    d = np.column_stack([np.eye(m)[c] for c, m in zip(codes, sizes)])
    fitted = d @ np.linalg.lstsq(d * np.sqrt(w)[:, None], y * np.sqrt(w)[:, None], rcond=None)[0]
    assert np.allclose(sum(a[c] for a, c in zip(alphas, codes)), fitted, atol=1e-8) and gap < 1e-9


def test_quantile_vertices():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(301), rng.normal(size=301)])
    y = x @ [1.0, 2.0] + rng.standard_t(3, 301)
    for tau in (0.1, 0.5, 0.8):
        b = interior_point(x, y, tau)
        r = y - x @ b
        assert (np.abs(r) < 1e-8).sum() == 2
        loss = lambda v: np.sum(np.where(y - x @ v >= 0, tau * (y - x @ v), (tau - 1) * (y - x @ v)))
        assert all(loss(b) <= loss(b + d) + 1e-9 for d in rng.normal(scale=0.05, size=(200, 2)))


def test_step_down():
    rng = np.random.default_rng(3)
    t, draws = np.array([3.0, 1.0, 0.2]), rng.normal(size=(999, 3))
    p = step_down_max_t(t, draws)
    assert p[0] <= p[1] <= p[2] and p[0] < 0.05
    q = step_down_min_p(np.array([0.001, 0.3, 0.9]), rng.uniform(size=(999, 3)))
    assert q[0] <= q[1] <= q[2] and q[0] < 0.05
