"""Inference that stays valid while data arrive: e-values, sequential p-values, confidence sequences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from .model import LinearModel


def optimal_precision(n_opt: float, dfn: int, alpha: float = 0.05) -> float:
    """The mixture precision that makes the confidence sequence narrowest at n_opt observations, by golden section."""

    def width(log_phi: float) -> float:
        g = math.exp(log_phi) / (math.exp(log_phi) + n_opt)
        dfd = max(1.0, n_opt - dfn - 1)
        b = (alpha**2 * g) ** (1.0 / (dfd + 1.0))
        return dfd * (1 - b) / (b - g) if b > g else math.inf

    low, high, ratio = math.log(1e-6), math.log(max(10.0, n_opt) * 10), (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(200):
        if width(a) < width(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return math.exp((low + high) / 2)


def log_e_value(f: float, dfn: float, dfd: float, n: float, phi: float) -> float:
    g = phi / (phi + n)
    r = dfn * f / dfd
    return 0.5 * dfn * math.log(g) + 0.5 * (dfd + dfn) * (math.log1p(r) - math.log1p(g * r))


def savi(model: LinearModel, phi: float = 1.0, alpha: float = 0.05) -> pd.DataFrame:
    """By coefficient: e-value, sequential p-value and confidence sequence. Unweighted OLS without effects, iid or robust errors."""
    if model.is_iv or model.design.fe or model.design.weighted or isinstance(model.vcov_type, dict):
        raise ValueError("sequential inference is for unweighted OLS without fixed effects or instruments, with iid or robust errors")
    dfd, n = model.n - model.k, model.n
    g = phi / (phi + n)
    b = (alpha**2 * g) ** (1.0 / (dfd + 1.0))
    radius = math.sqrt(dfd * (1 - b) / (b - g)) if b > g else math.inf
    out = []
    for est, se in zip(model.beta, model.se(), strict=True):
        log_e = log_e_value(float((est / se) ** 2), 1, dfd, n, phi)
        e = math.exp(min(log_e, 700.0))
        out.append((est, e, min(1.0, math.exp(-log_e)) if log_e > -700 else 1.0, est - radius * se, est + radius * se))
    return pd.DataFrame(out, columns=["Estimate", "e-value", "Pr(seq)", "ci_low", "ci_high"], index=model.coefnames)


def joint_e_value(model: LinearModel, phi: float = 1.0) -> float:
    """e-value of all slopes being zero."""
    at = [i for i, n in enumerate(model.coefnames) if n != "Intercept"]
    f = float(model.wald_test(np.eye(model.k)[at])["statistic"])
    return math.exp(min(700.0, log_e_value(f, len(at), model.n - model.k, model.n, phi)))
