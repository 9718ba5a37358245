"""Gelbach's decomposition of how a coefficient moves between a short and a long regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .model import LinearModel
from .moments import pairs, product_sums, square


class Decomposition:
    """direct, full, explained, unexplained and the share of each mediator (or group of mediators)."""

    def __init__(self, names: list[str], estimates: np.ndarray, draws: np.ndarray | None, alpha: float):
        self.names, self.estimates, self.draws, self.alpha = names, estimates, draws, alpha

    def tidy(self) -> pd.DataFrame:
        out = pd.DataFrame({"coefficients": self.estimates}, index=self.names)
        if self.draws is not None:
            out["ci_lower"], out["ci_upper"] = np.quantile(self.draws, [self.alpha / 2, 1 - self.alpha / 2], axis=0)
        return out

    def etable(self, digits: int = 3) -> pd.DataFrame:
        t = self.tidy().round(digits)
        total, direct = t.loc["explained_effect", "coefficients"], t.loc["direct_effect", "coefficients"]
        t["share of explained"] = (t["coefficients"] / total).round(digits) if total else np.nan
        t["share of direct"] = (t["coefficients"] / direct).round(digits) if direct else np.nan
        return t

    coefplot_frame = tidy


def _parts(gram: np.ndarray, d: int, x1: list[int], x2: list[int], groups: list[list[int]]) -> np.ndarray:
    """From cross products with the outcome at 0: direct, full, explained, unexplained, then groups."""
    base, every = [d, *x1], [d, *x1, *x2]
    short = np.linalg.pinv(gram[np.ix_(base, base)]) @ gram[base, 0]
    long = np.linalg.pinv(gram[np.ix_(every, every)]) @ gram[every, 0]
    gamma = np.linalg.pinv(gram[np.ix_(base, base)]) @ gram[np.ix_(base, x2)]
    delta = gamma[0] * long[len(base) :]
    by = [float(sum(delta[x2.index(i)] for i in g)) for g in groups]
    return np.array([short[0], long[0], delta.sum(), short[0] - delta.sum(), *by])


def decompose(model: LinearModel, decomp_var: str, x1_vars: list[str] | None = None, combine_covariates: dict[str, list[str] | str] | None = None, reps: int = 0, cluster: str | None = None, seed: int = 0, alpha: float = 0.05, max_groups: int = 200_000) -> Decomposition:
    """All parts come from one matrix of cross products; intervals redraw it by cluster, or row by row with Poisson(1) weights."""
    if model.is_iv or model.method != "feols":
        raise ValueError("decompositions are for OLS")
    names = [n for n in model.coefnames if n != "Intercept"]
    if decomp_var not in names:
        raise ValueError(f"no coefficient {decomp_var!r}")
    x1 = [n for n in (x1_vars or [])]
    mediators = [n for n in names if n != decomp_var and n not in x1]
    groups = {n: [n] for n in mediators}
    if combine_covariates:
        groups = {}
        for label, members in combine_covariates.items():
            found = [n for n in mediators if re.search(members, n)] if isinstance(members, str) else list(members)
            if set(found) - set(mediators):
                raise ValueError(f"not mediators: {sorted(set(found) - set(mediators))}")
            if any(set(found) & set(g) for g in groups.values()):
                raise ValueError("a mediator is in two groups")
            groups[label] = found
    place = {n: 1 + i for i, n in enumerate(names)}  # outcome first
    at = np.concatenate([[0], model.x_at]).astype(int)
    gram = model.gram[np.ix_(at, at)]
    args = (place[decomp_var], [place[n] for n in x1], [place[n] for n in mediators], [[place[n] for n in g] for g in groups.values()])
    labels = ["direct_effect", "full_effect", "explained_effect", "unexplained_effect", *groups]
    draws = _redraw(model, at, args, reps, cluster, seed, max_groups) if reps else None
    return Decomposition(labels, _parts(gram, *args), draws, alpha)


_POISSON = np.cumsum([1 / math.e / math.factorial(n) for n in range(18)])
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    """SplitMix64."""
    z = z + _ODD[0]
    z = (z ^ (z >> np.uint64(30))) * _ODD[1]
    z = (z ^ (z >> np.uint64(27))) * _ODD[2]
    return z ^ (z >> np.uint64(31))


def _poisson(row: np.ndarray, rep: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (down) is drawn in each replicate (across): hashes, so a recomputed task draws the same."""
    z = _mix(_mix(row.astype(np.uint64) + _mix(np.array([seed % (1 << 64)], np.uint64)))[:, None] ^ _mix(rep.astype(np.uint64))[None, :])
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(float) / float(1 << 53), side="right").astype(float)


def _redraw_rows(rows: DataFrame, cols: list[Column], w: Column, reps: int, seed: int, batch: int = 256) -> np.ndarray:
    """Sums of products (across) of each replicate (down); one pass over the rows for each batch of replicates."""
    k = len(cols)
    named = [c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)]
    kept = cut(rows.select(*named, w.cast("double").alias("w"), F.monotonically_increasing_id().alias("row")), "redraw")  # rows keep their numbers
    left, right = (np.array(x) for x in zip(*pairs(k), strict=True))
    out = []
    for low in range(0, reps, batch):
        rep = np.arange(low, min(reps, low + batch))

        def partial(batches: Iterator[pa.RecordBatch], rep: np.ndarray = rep) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(rep), len(left)))
            for b in batches:
                v = [b.column(i).to_numpy(zero_copy_only=False) for i in range(k + 2)]
                for at in range(0, b.num_rows, 4096):
                    x = np.column_stack([c[at : at + 4096] for c in v[:k]])
                    total += _poisson(v[k + 1][at : at + 4096], rep, seed).T @ (x[:, left] * x[:, right] * v[k][at : at + 4096, None])
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["rep", "q"])

        got = kept.mapInArrow(partial, "rep long, q array<double>").groupBy("rep").agg(*[F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(len(left))])
        out.append(got.orderBy("rep").drop("rep").toPandas().to_numpy(float))
    return np.concatenate(out)


def _redraw(model: LinearModel, at: np.ndarray, args: tuple, reps: int, cluster: str | None, seed: int, max_groups: int) -> np.ndarray:
    rows, v = model._absorbed_rows()
    one = [F.lit(1.0)] if model.intercept else []
    cols = [*one, *[v[i] for i in at]]
    if cluster:
        q = [f"q{i}" for i in range(len(pairs(len(cols))))]
        per = rows.groupBy(F.col(f"`{cluster}`").alias("k")).agg(*[s.alias(n) for n, s in zip(q, product_sums(cols, model.design.w), strict=True)])
        if per.count() > max_groups:
            raise ValueError(f"more than {max_groups} clusters to redraw")
        table = per.orderBy("k").select(*q).toPandas().to_numpy(float)
        rng = np.random.default_rng(seed)
        sums = (np.bincount(rng.integers(0, len(table), len(table)), minlength=len(table)) @ table for _ in range(reps))
    else:
        sums = _redraw_rows(rows, cols, model.design.w, reps, seed)
    out = []
    for total in sums:
        m = square(total, len(cols))
        if model.intercept:
            m = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / m[0, 0]
        out.append(_parts(m, *args))
    return np.array(out)


__all__ = ["Decomposition", "decompose"]
