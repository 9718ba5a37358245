"""Corrections for several hypotheses: Bonferroni, Romano-Wolf, Westfall-Young."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .model import LinearModel
from .resample import bootstrap_t, ritest


def _models(models) -> list[LinearModel]:
    return models.to_list() if hasattr(models, "to_list") else list(models)


def _rows(models, param: str) -> pd.DataFrame:
    found = []
    for i, m in enumerate(_models(models)):
        if param not in m.coefnames:
            raise ValueError(f"model {i} has no coefficient {param!r}")
        found.append(m.tidy().loc[[param]].assign(est=f"est{i + 1}").set_index("est"))
    return pd.concat(found)


def bonferroni(models, param: str) -> pd.DataFrame:
    """The tidy rows of param by model, with p-values times the number of models."""
    out = _rows(models, param)
    out["Bonferroni Pr(>|t|)"] = np.minimum(1.0, out["Pr(>|t|)"] * len(out))
    return out.T


def step_down_max_t(t: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Romano-Wolf p-values: largest first, each against the maximum of the draws of those not yet passed; never falling."""
    order = np.argsort(-np.abs(t), kind="stable")
    out, floor = np.empty(len(t)), 0.0
    for i, j in enumerate(order):
        most = np.abs(draws[:, order[i:]]).max(axis=1)
        floor = max(floor, (np.sum(most >= abs(t[j])) + 1.0) / (len(draws) + 1.0))
        out[j] = floor
    return out


def step_down_min_p(p: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Westfall-Young p-values: smallest first, each against the minimum of the draws' p-values of those not yet passed."""
    order = np.argsort(p, kind="stable")
    out, floor = np.empty(len(p)), 0.0
    for i, j in enumerate(order):
        least = draws[:, order[i:]].min(axis=1)
        floor = max(floor, float(np.mean(least <= p[j])))
        out[j] = floor
    return out


def _draws(models: list[LinearModel], param: str, reps: int, seed: int | None, method: str) -> np.ndarray:
    """t statistics under the null, replicates by models. Models share a replicate's weights, or its drawn treatment."""
    if method == "wild-bootstrap":
        found = [bootstrap_t(m, param, reps, seed, impose_null=False) for m in models]
    elif method == "ri":
        found = []
        for m in models:
            ritest(m, param, reps, type="randomization-t", seed=seed or 0)
            found.append(m.ritest_statistics)
    else:
        raise ValueError("sampling_method is wild-bootstrap or ri")
    return np.column_stack(found)


def rwolf(models, param: str, reps: int = 999, seed: int | None = None, sampling_method: str = "wild-bootstrap") -> pd.DataFrame:
    """Romano-Wolf adjusted p-values, from wild bootstrap draws or a treatment drawn anew (ri)."""
    out, ms = _rows(models, param), _models(models)
    out["RW Pr(>|t|)"] = step_down_max_t(out["t value"].to_numpy(), _draws(ms, param, reps, seed, sampling_method))
    return out.T


def wyoung(models, param: str, reps: int = 999, seed: int | None = None, sampling_method: str = "wild-bootstrap") -> pd.DataFrame:
    """Westfall-Young adjusted p-values, from wild bootstrap draws or a treatment drawn anew (ri)."""
    out, ms = _rows(models, param), _models(models)
    t = _draws(ms, param, reps, seed, sampling_method)
    draws = np.column_stack([np.array([m._p(v) for v in t[:, i]]) for i, m in enumerate(ms)])
    out["WY Pr(>|t|)"] = step_down_min_p(out["Pr(>|t|)"].to_numpy(), draws)
    return out.T
