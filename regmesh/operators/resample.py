"""Resampling: wild (cluster) bootstrap, randomisation inference, causal cluster variance."""

from __future__ import annotations

import math
import re
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as dist
from ..plans.design import build
from ..plans.formula import Node
from ..scratch import cut
from .absorb import absorb
from .model import LinearModel, _linear
from .moments import pairs
from .ols import independent_columns, spd_inverse

MAX_CLUSTERS = 1_000_000


# --- wild bootstrap -------------------------------------------------------------


def _one_hot(model: LinearModel, most: int = 2000) -> LinearModel:
    """The same model with its fixed effects laid out as indicators, for few levels."""
    if sum(model.k_fe) > most:
        raise ValueError(f"the fixed effects have {sum(model.k_fe)} levels; the wild bootstrap lays out at most {most}, or any number nested in the clusters")
    f = model.formula
    names = [f"__one{i}" for i in range(len(f.fixed_effects))]
    data = model.frame.select(*[F.col(f"`{c}`") for c in model.data.columns], *[F.col(c).alias(n.lstrip("_")) for c, n in zip(model.design.f, names, strict=True)])
    terms = tuple((Node("call", "C", (Node("name", n.lstrip("_")),)),) for n in names)
    plain = type(f)(f.text, f.dependent, f.exogenous + terms, True, ())
    spec = model.design.spec
    return LinearModel(build(plain, data, weights=spec["weights"], context=spec["context"]), data, model.options)


def _prepared(model: LinearModel, clusters: list[str] | None) -> LinearModel:
    """A model whose score sums by cluster are all that a draw needs: effects inside the clusters drop out of the sums, others are laid out."""
    if model.is_iv:
        raise ValueError("the wild bootstrap is not available with instruments")
    if clusters and len(clusters) > 1:
        raise ValueError("the wild bootstrap takes one cluster variable")
    if model.design.fe and not (clusters and model._nested(clusters)[1] == len(model.design.fe)):
        model = _one_hot(model)
    return model


def _cluster_parts(model: LinearModel, param: str, clusters: list[str] | None, impose_null: bool, r: float = 0.0):
    """By cluster: sums of (the other-regressor residual of param) times residual, the same by regressors, and score sums.

    Everything that a wild bootstrap needs is then k-sized by cluster.
    """
    j = model.coefnames.index(param)
    rows = model.score_rows()
    k, w = model.k, F.col("__w")
    m = [F.col(f"__m{i}") for i in range(k)]
    proj = model.bread[j] / model.bread[j, j]  # weights of the regressors in the residual of param on the others
    ortho = _linear(m, proj)
    u = F.col("__u")
    if impose_null:  # the residual of the model with beta_j held at r: the estimate moves along the residual of param
        u = u + (float(model.beta[j]) - r) * ortho
    keys = [F.col(f"`{c}`") for c in clusters] if clusters else [F.monotonically_increasing_id()]
    keys = [c.alias(f"k{i}") for i, c in enumerate(keys)]
    base = rows.select(*keys, (w * ortho * u).alias("a"), *[(w * ortho * x).alias(f"b{i}") for i, x in enumerate(m)], *[(w * x * u).alias(f"s{i}") for i, x in enumerate(m)])
    names = ["a", *[f"b{i}" for i in range(k)], *[f"s{i}" for i in range(k)]]
    parts = base.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(*[F.sum(c).alias(c) for c in names]) if clusters else base
    got = parts.orderBy(*[f"k{i}" for i in range(len(keys))]).select(*names).limit(MAX_CLUSTERS + 1).toPandas().to_numpy(float)
    if len(got) > MAX_CLUSTERS:
        raise ValueError(f"the bootstrap's draws are made on the driver for at most {MAX_CLUSTERS} clusters")
    return j, got[:, 0], got[:, 1 : 1 + k], got[:, 1 + k :]


def _draw(rng: np.random.Generator, n: int, reps: int, kind: str) -> np.ndarray:
    if kind == "rademacher":
        return rng.integers(0, 2, (n, reps)) * 2.0 - 1.0
    if kind == "webb":
        values = np.sqrt([0.5, 1.0, 1.5])
        return rng.choice(np.concatenate([-values, values]), (n, reps))
    if kind == "mammen":
        s5 = math.sqrt(5)
        return np.where(rng.random((n, reps)) < (s5 + 1) / (2 * s5), (1 - s5) / 2, (1 + s5) / 2)
    if kind == "normal":
        return rng.standard_normal((n, reps))
    raise ValueError("weights are rademacher, webb, mammen or normal")


def _blocks(n: int, reps: int, kind: str, seed: int | None, cells: int = 4_000_000):
    """Draws, clusters by replicates, a bounded block at a time. Signs that are fewer than the replicates are listed whole."""
    if kind == "rademacher" and n < 60 and 1 << n <= reps:
        yield (np.arange(1 << n)[None, :] >> np.arange(n)[:, None] & 1) * 2.0 - 1.0
        return
    rng, each = np.random.default_rng(seed), max(1, cells // max(1, n))
    for low in range(0, reps, each):
        yield _draw(rng, n, min(each, reps - low), kind)


def _t_draws(model: LinearModel, parts, reps: int, kind: str, seed: int | None, clusters: list[str] | None) -> np.ndarray:
    j, a, b, s = parts
    g, fe = len(a), (sum(model.k_fe), len(model.k_fe))
    nested = model._nested(clusters) if clusters and fe[1] and model.options.ssc.k_fixef == "nonnested" else (0, 0)
    scale = math.sqrt(model.options.ssc.factor("CRV" if clusters else "hetero", model.n, model.k, *fe, *nested, groups=g)[0])
    out = []
    for v in _blocks(g, reps, kind, seed):
        top = model.bread[j, j] * (a @ v)  # what a draw adds to the estimate
        back = b @ (model.bread @ (s.T @ v))  # clusters by draws: regressors' part of the drawn residual
        err = model.bread[j, j] * np.sqrt(((v * a[:, None] - back) ** 2).sum(axis=0))
        out.append(top / np.where(err > 0, err * scale, np.nan))
    return np.concatenate(out)


def bootstrap_t(model: LinearModel, param: str, reps: int, seed: int | None, weights: str = "rademacher", impose_null: bool = True, r: float = 0.0) -> np.ndarray:
    """Drawn t statistics under the null; clusters are those of the model's covariance."""
    clusters = getattr(model, "clusters", None) if isinstance(model.vcov_type, dict) else None
    plain = _prepared(model, clusters)
    return _t_draws(plain, _cluster_parts(plain, param, clusters, impose_null, r), reps, weights, seed, clusters)


def wildboottest(model: LinearModel, reps: int, param: str, cluster: str | None = None, weights_type: str = "rademacher", impose_null: bool = True, seed: int | None = None, r: float = 0.0) -> pd.Series:
    """Wild (cluster) bootstrap test of beta = r."""
    clusters = [cluster] if cluster else (getattr(model, "clusters", None) if isinstance(model.vcov_type, dict) else None)
    plain = _prepared(model, clusters)
    drawn = _t_draws(plain, _cluster_parts(plain, param, clusters, impose_null, r), reps, weights_type, seed, clusters)
    plain = copy(plain)  # the caller's model keeps its covariance
    plain.vcov({"CRV1": clusters[0]} if clusters else "hetero")
    at = plain.coefnames.index(param)
    t = float((plain.beta[at] - r) / plain.se()[at])
    p = float(np.mean(np.abs(drawn) >= abs(t) * (1 - 1e-10)))  # the draw that is the sample itself counts, whatever the rounding
    return pd.Series({"param": param, "t value": t, "Pr(>|t|)": p, "bootstrap_type": "11" if impose_null else "31", "inference": f"CRV({clusters[0]})" if clusters else "HC", "impose_null": impose_null})


# --- randomisation inference -----------------------------------------------------


def _hypothesis(text: str) -> tuple[str, str, float]:
    m = re.fullmatch(r"\s*([^=<>]+?)\s*(=|<|>)\s*(-?[\d.eE+-]+)\s*", text) if re.search("[=<>]", text) else None
    return (m[1], m[2], float(m[3])) if m else (text.strip(), "=", 0.0)


def ritest(model: LinearModel, resampvar: str, reps: int = 100, cluster: str | None = None, type: str = "randomization-c", seed: int = 0, batch: int = 16, ci_level: float = 0.95) -> pd.Series:
    """Randomisation inference: the treatment is drawn anew from its own distribution, row by row or cluster by cluster.

    The null 'x=0' is two-sided; 'x>0' and 'x<0' name the null, so the tail is the other one. Draws are hashes of
    the row or cluster and the draw's number, so a recomputed task draws the same.
    """
    name, sign, h0 = _hypothesis(resampvar)
    if name not in model.coefnames:
        raise ValueError(f"no coefficient {name!r}")
    at = model.coefnames.index(name)
    rows = cut(model.frame.withColumn("__row", F.monotonically_increasing_id()), "ritest")  # rows keep their numbers
    values = rows.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count(F.lit(1)).alias("n")) if not cluster else rows.groupBy(F.col(f"`{cluster}`")).agg(F.first(F.col(f"`{name}`")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    table = values.orderBy("v").limit(10_001).collect()
    if len(table) > 10_000:
        raise ValueError(f"{name} has more than 10000 values")
    share = np.cumsum([r.n for r in table]) / sum(r.n for r in table)
    key = F.col(f"`{cluster}`") if cluster else F.col("__row")
    cuts, levels = F.array(*[F.lit(float(s)) for s in share[:-1]]), F.array(*[F.lit(float(r.v)) for r in table])

    def draw(b: int) -> Column:
        u = (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(b)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
        if len(table) <= 8:
            out = F.lit(float(table[-1].v))
            for s, r in list(zip(share[:-1], table[:-1], strict=True))[::-1]:
                out = F.when(u <= float(s), float(r.v)).otherwise(out)
            return out
        return F.element_at(levels, F.size(F.filter(cuts, lambda c: c < u)) + 1)

    d = model.design
    others = [i for i in model.x_at if model.names_all[i] != _column_of(model, name)]
    cols = [model.cols[0], *[model.cols[i] for i in others]]
    stats: list[float] = []
    w_free = not model.intercept and not d.fe
    for low in range(0, reps, batch):
        drawn = [draw(b) for b in range(low, min(reps, low + batch))]
        named = rows.select("*", *[c.alias(f"__b{i}") for i, c in enumerate(drawn)])
        all_cols = [*cols, *[F.col(f"__b{i}") for i in range(len(drawn))]]
        got = absorb(named, all_cols, d.w, d.f, model.options.tol, model.options.max_iter, model.options.max_cells)
        gram = got.gram if d.fe or w_free else got.gram - np.outer(got.sums, got.sums) / got.sum_w
        q = len(cols)
        for i in range(len(drawn)):
            idx = [q + i, *range(1, q)]
            a = gram[np.ix_(idx, idx)]
            ok = independent_columns(a)
            if not ok[0]:
                stats.append(0.0)
                continue
            sel = np.flatnonzero(ok)
            inv = spd_inverse(a[np.ix_(sel, sel)])
            beta = inv @ gram[idx, 0][sel]
            if type == "randomization-c":
                stats.append(float(beta[0]))
            elif type == "randomization-t":
                rss = gram[0, 0] - beta @ gram[idx, 0][sel]
                stats.append(float(beta[0] / math.sqrt(max(rss, 1e-300) / (model.n - model.k) * inv[0, 0])))
            else:
                raise ValueError("type is randomization-c or randomization-t")
    sample = float(model.beta[at]) if type == "randomization-c" else float(model.tstat()[at])
    z = np.array(stats)
    hit = np.abs(z) >= abs(sample - h0) if sign == "=" else (z <= sample if sign == ">" else z >= sample)
    p = float(hit.mean())
    se = math.sqrt(max(p * (1 - p), 0.0) / len(z))
    half = dist.norm_ppf(0.5 + ci_level / 2) * se
    model.ritest_statistics = z
    return pd.Series({"H0": f"{name}{sign}{h0:g}", "ri-type": type, "Estimate": sample, "Pr(>|t|)": p, "Std. Error (Pr(>|t|))": se, f"{(1 - ci_level) / 2 * 100:.1f}% (Pr(>|t|))": p - half, f"{(1 + ci_level) / 2 * 100:.1f}% (Pr(>|t|))": p + half, "Cluster": cluster})


def _column_of(model: LinearModel, name: str) -> str:
    return f"__x{model.design.x_names.index(name)}"


# --- causal cluster variance ------------------------------------------------------


def _split_variance(rows: DataFrame, parts: list[Column], k: int, at: int, everywhere: float, pk: float) -> float:
    """n times the variance by one split. rows: c (cluster) and v0.. (outcome, regressors, one); parts: fitting untreated and treated, scoring untreated and treated."""
    v, upper = [F.col(f"v{i}") for i in range(k + 2)], pairs(k + 2)
    sums = [F.sum(F.when(p, v[i] * v[j]).otherwise(0.0)).alias(f"q{h}_{n}") for h, p in enumerate(parts) for n, (i, j) in enumerate(upper)]
    by_cluster = cut(rows.groupBy("c").agg(*sums).drop("c"), "ccv-split")

    def matrices(flat: np.ndarray) -> np.ndarray:
        """(clusters, parts, k + 2, k + 2) cross products."""
        out = np.zeros((len(flat), 4, k + 2, k + 2))
        for n, (i, j) in enumerate(upper):
            out[:, :, i, j] = out[:, :, j, i] = flat.reshape(len(flat), 4, len(upper))[:, :, n]
        return out

    whole = matrices(np.array([by_cluster.agg(*[F.sum(c) for c in by_cluster.columns]).first()], float))[0]
    fit, n_part = whole[0] + whole[1], whole[:, -1, -1]
    coefs = np.linalg.pinv(fit[1:-1, 1:-1]) @ fit[1:-1, 0]
    n, effect = float(n_part.sum()), float(coefs[at])
    treated, scoring = float(n_part[1] / (n_part[0] + n_part[1])), float((n_part[2] + n_part[3]) / n)
    to_u = np.concatenate([[1.0], -coefs, [0.0]])  # the residual in terms of the columns

    def effects(m: np.ndarray, n0: np.ndarray, n1: np.ndarray, default: float) -> np.ndarray:
        """Effects within clusters; the default where one arm is empty."""
        own = (np.linalg.pinv(m[:, 1:-1, 1:-1], hermitian=True) @ m[:, 1:-1, :1])[:, at, 0]
        return np.where((n0 > 0) & (n1 > 0), own, default)

    def work(batches):
        scores = spread = 0.0
        clusters = 0
        for b in batches:
            q = matrices(b.to_numpy(float))
            size = q[:, :, -1, -1]
            near = effects(q[:, 0] + q[:, 1], size[:, 0], size[:, 1], effect)
            full = effects(q.sum(axis=1), size[:, 0] + size[:, 2], size[:, 1] + size[:, 3], everywhere)
            u_sum, u_square = q[:, 2:, -1] @ to_u, np.einsum("caij,i,j->ca", q[:, 2:], to_u, to_u)
            tilt = np.array([-treated, 1.0 - treated])
            shift, held = (near - effect) * treated * (1 - treated), size[:, 2] + size[:, 3]
            first = u_sum @ tilt - held * shift  # sum of e
            second = u_square @ tilt**2 - 2 * shift * (u_sum @ tilt) + held * shift**2  # sum of e^2
            scores += float((first**2 - (1 - scoring) * second).sum()) / scoring**2
            spread += float((size.sum(axis=1) * (full - effect) ** 2).sum()) / n
            clusters += len(b)
        yield pd.DataFrame({"scores": [scores], "spread": [spread], "clusters": [clusters]})

    got = by_cluster.mapInPandas(work, "scores double, spread double, clusters long").agg(F.sum("scores"), F.sum("spread"), F.sum("clusters")).first()
    return got[0] / (n * treated**2 * (1 - treated) ** 2) + got[2] * (1 - pk) * got[1]


def ccv(model: LinearModel, treatment: str, cluster: str | None = None, pk: float = 1.0, qk: float = 1.0, n_splits: int = 8, seed: int = 0) -> pd.DataFrame:
    """The causal cluster variance of Abadie, Athey, Imbens and Wooldridge (2023), for a binary treatment.

    A split deals the rows by a hashed coin into one part that fits (the coefficients, and the effect in each cluster)
    and one that scores. With W the treated share of the fitting part, Z the share of the scoring part, u the residual
    and d_c = (effect in cluster c - effect) W (1 - W), the score of a row is e = (w - W) u - d_c, and the variance
        ( sum_c (sum e)^2 / Z^2 - (1 - Z) / Z^2 sum_c sum e^2 ) / (n W^2 (1 - W)^2) + (1 - pk) sum_c n_c / n (effect_c - effect)^2.
    The last term is counted once a cluster here, as users of the estimator's ports expect; at pk = 1 it is zero.

    A treated share makes every sum of e a quadratic form in cross products by cluster, part and arm, so a split is one
    aggregation of the rows; clusters are then worked off in batches on the tasks, and three sums come to the driver.
    """
    if model.design.fe or model.is_iv:
        raise ValueError("the causal cluster variance is for OLS without fixed effects")
    cluster = cluster or model.clusters[0]
    at, k = model.coefnames.index(treatment), model.k
    arm = F.col(f"`{treatment}`").cast("double")
    m = [F.col(f"__m{i}") for i in range(k)]
    cols = [F.col("__u") + _linear(m, model.beta), *m, F.lit(1.0)]
    rows = cut(model.score_rows().select(F.col(f"`{cluster}`").alias("c"), arm.alias("w"), F.monotonically_increasing_id().alias("row"), *[c.alias(f"v{i}") for i, c in enumerate(cols)]), "ccv")
    if rows.where("w not in (0, 1)").limit(1).count():
        raise ValueError(f"{treatment} is not binary")
    everywhere = float(model.beta[at])
    total = 0.0
    for split in range(n_splits):
        fits = F.pmod(F.xxhash64("row", F.lit(seed), F.lit(split)), F.lit(2)) == 1
        parts = [(fits & (F.col("w") == 0)), (fits & (F.col("w") == 1)), (~fits & (F.col("w") == 0)), (~fits & (F.col("w") == 1))]
        total += _split_variance(rows, parts, k, at, everywhere, pk)
    model = copy(model).vcov({"CRV1": cluster})
    crv, g = float(model.V[at, at]), model.G[0]
    v = qk * total / n_splits / model.n + (1 - qk) * crv
    rows_out = []
    for name, var in (("CCV", v), ("CRV1", crv)):
        se = math.sqrt(max(var, 0.0))
        half_width = dist.t_ppf(0.975, g - 1) * se
        rows_out.append((name, everywhere, se, everywhere / se if se else np.nan, 2 * dist.t_sf(abs(everywhere / se), g - 1) if se else np.nan, everywhere - half_width, everywhere + half_width))
    return pd.DataFrame(rows_out, columns=["type", "Estimate", "Std. Error", "t value", "Pr(>|t|)", "2.5%", "97.5%"]).set_index("type")


__all__ = ["bootstrap_t", "ccv", "ritest", "wildboottest"]
