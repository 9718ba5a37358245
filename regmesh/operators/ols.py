"""Small algebra on the driver: collinearity, solves, small-sample corrections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def independent_columns(gram: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Which columns are kept, left to right: one goes when what earlier ones leave of it has next to no length."""
    k = len(gram)
    kept: list[int] = []
    factor = np.zeros((0, 0))
    for j in range(k):
        row = np.linalg.solve(factor, gram[kept, j]) if kept else np.zeros(0)
        rest = gram[j, j] - row @ row
        if rest < tol * max(1e-300, min(1.0, gram[j, j])) or rest < 1e-11 * gram[j, j]:
            continue
        grown = np.zeros((len(kept) + 1, len(kept) + 1))
        grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = factor, row, np.sqrt(rest)
        factor = grown
        kept.append(j)
    return np.isin(np.arange(k), kept)


def spd_inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive definite matrix, scaled first."""
    if not len(a):
        return a.copy()
    s = 1.0 / np.sqrt(np.diag(a))
    inv = np.linalg.inv(a * s[:, None] * s[None, :])
    return 0.5 * (inv + inv.T) * s[:, None] * s[None, :]


def solve(a: np.ndarray, b: np.ndarray, solver: str = "scipy.linalg.solve") -> np.ndarray:
    """Solvers by their names: least squares for the ones so called, else the scaled inverse."""
    if solver in ("np.linalg.lstsq", "scipy.sparse.linalg.lsqr"):
        return np.linalg.lstsq(a, b, rcond=None)[0]
    return spd_inverse(a) @ b


@dataclass(frozen=True)
class Ssc:
    """Options of the small-sample correction."""

    k_adj: bool = True
    k_fixef: str = "nonnested"
    G_adj: bool = True
    G_df: str = "min"

    def __post_init__(self):
        if self.k_fixef not in ("none", "nonnested", "full") or self.G_df not in ("conventional", "min"):
            raise ValueError("k_fixef is none, nonnested or full; G_df is conventional or min")

    def factor(self, kind: str, n: float, k: int, k_fe: int, n_fe: int, k_nested: int = 0, n_nested: int = 0, groups: float = 0) -> tuple[float, float, float]:
        """The factor, the parameters it counts and the degrees of freedom of t. kind: iid, hetero, CRV or HAC."""
        fe = k_fe - (n_fe - 1) if n_fe > 1 else k_fe
        used = k
        if n_fe and self.k_fixef != "none":
            used += fe
            if self.k_fixef == "nonnested" and k_nested:
                used += n_nested - k_nested
        out = 1.0
        if self.k_adj:
            out = (n if kind == "hetero" else n - 1) / (n - used)
        if kind in ("CRV", "HAC") and self.G_adj:
            out *= groups / (groups - 1)
        return out, used, (n - used if kind in ("iid", "hetero") else groups - 1)


def ssc(k_adj: bool = True, k_fixef: str = "nonnested", G_adj: bool = True, G_df: str = "min") -> Ssc:
    return Ssc(k_adj, k_fixef, G_adj, G_df)
