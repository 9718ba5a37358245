"""Quality classifier by positive-unlabelled (PU) learning.

Trusted positives are labelled good documents; the other class is never shown:
the second sample is unlabelled web text, and labelled bad documents serve tests
alone. The class prior pi is estimated from the scores of a positive-versus-unlabelled
separator, each row scored by a fit that did not see it (best-bin estimation: the
least ratio of upper-tail masses). The additive model then minimises the non-negative
unbiased risk
    pi*E_p[l(f)] + max(0, E_u[l(-f)] - pi*E_p[l(-f)]).

The fit reads at most ``max_rows`` positives and ``max_rows`` unlabelled rows,
those whose hashed id is smallest; scoring reads every whole text. An id that is
labelled good once is a positive; rows that share an id count once in the fit, by
the least vector of statistics.

Defined results: a null text is the empty text and still gets a score; a null
label is no label; with no positives at all every score is the prior 0.5; an
empty table gives an empty result; repeated rows each get a row; other columns
are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, small_batches, text_of

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>"
PUNCT = b"!?;:=~^_/\\{}[]()+\"'`@"
FEATURES = 14
BINS = 12


def features(text: str) -> list[float]:
    """Style statistics of a whole text; every one a rate, so long and short texts compare."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    joined = b"".join(words)
    size = len(joined)
    count = lambda chars: size - len(joined.translate(None, chars))
    freq = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    short = sum(1 for w in freq if len(w) <= 3)
    stops = sum(c for w, c in freq.items() if len(w) <= 3)
    return [
        float(np.log1p(n)), size / n, count(SYMBOLS) / n, count(UPPER) / n, count(DIGITS) / n, count(PUNCT) / n,
        raw.count(b".") / n, raw.count(b",") / n, len(freq) / n, max(freq.values()) / n,
        sum(map(operator.eq, words, words[1:])) / n, 1.0 - len(set(lines)) / max(1, len(lines)), stops / n, short / len(freq),
    ]


@dataclass
class Model:
    """An additive model on binned features: edges (FEATURES, BINS - 1), weights (FEATURES * BINS,), bias and prior."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(_design(x, self.edges) @ self.weights + self.bias, -30, 30)))


def _design(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Thermometer coding: column (f, b) is 1 where feature f passes edge b."""
    return (x[:, :, None] > edges[None, :, :]).reshape(len(x), -1).astype(np.float64)


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """Best-bin estimate: least upper confidence ratio of the unlabelled to the positive mass above a threshold."""
    cuts = np.quantile(pos, np.linspace(0.0, 0.95, 200))
    qp = 1.0 - np.searchsorted(np.sort(pos), cuts, side="left") / len(pos)
    qu = 1.0 - np.searchsorted(np.sort(unl), cuts, side="left") / len(unl)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(unl))) + np.sqrt(np.log(4 / delta) / (2 * len(pos)))
    at = int(np.argmin((qu + slack) / np.maximum(qp, 1e-9)))
    return float(np.clip(qu[at] / max(qp[at], 1e-9), 0.05, 0.97))


def _fair_scores(dp: np.ndarray, du: np.ndarray, steps: int, rate: float, l2: float, parts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a positive-versus-unlabelled separator, each row by a fit without its part: no row looks more positive for having been fitted."""
    parts = min(parts, len(dp), len(du))
    own_p, own_u = np.arange(len(dp)) % parts, np.arange(len(du)) % parts
    sp, su = np.empty(len(dp)), np.empty(len(du))
    for k in range(parts):
        p, u = (dp[own_p != k], du[own_u != k]) if parts > 1 else (dp, du)

        def separate(w: np.ndarray, p: np.ndarray = p, u: np.ndarray = u) -> np.ndarray:
            return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + l2 * w

        w = _adam(separate, dp.shape[1], steps, rate)
        sp[own_p == k], su[own_u == k] = dp[own_p == k] @ w, du[own_u == k] @ w
    return sp, su


def fit(pos: np.ndarray, unl: np.ndarray, steps: int = 500, rate: float = 0.05, l2: float = 1e-3, prior: float | None = None) -> Model:
    """The non-negative PU fit; the prior is estimated unless it is given."""
    if not len(pos) or not len(unl):
        return Model(np.zeros((FEATURES, BINS - 1)), np.zeros(FEATURES * (BINS - 1)), 0.0, 0.5)
    both = np.vstack([pos, unl])
    edges = np.stack([_edges(both[:, f]) for f in range(FEATURES)])
    dp, du = (np.hstack([_design(x, edges), np.ones((len(x), 1))]) for x in (pos, unl))

    if prior is None:
        prior = estimate_prior(*_fair_scores(dp, du, steps // 4, rate, l2))

    def risk_gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(dp @ w), _sigmoid(du @ w)
        negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
        g_neg = du.T @ su / len(du) - prior * dp.T @ sp / len(dp)
        if negative < 0:  # the empirical negative risk may not pass below zero: step back from there
            return -g_neg + l2 * w
        return -prior * dp.T @ (1 - sp) / len(dp) + g_neg + l2 * w

    w = _adam(risk_gradient, dp.shape[1], steps, rate)
    return Model(edges, w[:-1], float(w[-1]), prior)


def _edges(v: np.ndarray) -> np.ndarray:
    """BINS - 1 cut points: quantiles of all values and of the tails, where junk lies."""
    q = np.quantile(v, [0.005, 0.02, 0.05, 0.1, 0.3, 0.6, 0.85, 0.92, 0.96, 0.985, 0.995])
    return q


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, fold: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on rows outside the held-out fold."""
    outside = lambda d: d.where(F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != fold))
    good = outside(labels.select(F.col(id_col).alias("doc_id"), "quality")).where(F.col("quality") == 1)
    pos = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.lit(1).alias("role"))
    near = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11)
    every = docs.select(F.col(id_col).alias("doc_id"))
    share = min(1.0, 2 * max_rows / max(1, every.count()))  # enough hashes for the sample, so that few ids are made distinct
    unl = outside(every.where(near < F.lit(int(share * (1 << 53))))).distinct().orderBy(near, "doc_id").limit(max_rows).select("doc_id", F.lit(0).alias("role"))
    chosen = pos.unionByName(unl)  # at most 2 * max_rows ids: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = arrow_map(rows.select("doc_id", "role", "text"), lambda c: {"doc_id": c["doc_id"], "role": c["role"], "x": [features(t) for t in c["text"]]}, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, role int, x array<double>")
    got = got.groupBy("doc_id", "role").agg(F.min("x").alias("x")).toPandas()  # a row an id, however often it is repeated
    got = got.sort_values(["doc_id", "role"])  # the fit does not depend on the order in which tasks end
    x = {r: np.array(list(got.loc[got["role"] == r, "x"]), dtype=float).reshape(-1, FEATURES) for r in (1, 0)}
    return fit(x[1], x[0])


def scorer(docs: DataFrame, model: Model):
    """A column function text -> score that applies the model on executors."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes, whatever the input

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t or "") for t in texts], dtype=float).reshape(-1, FEATURES)
        return pd.Series(held.value.score(x))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit_with) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col, **fit_with))
    out = docs.select(F.col(id_col).alias("doc_id"), score(text_of(F.col(text_col))).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    return crc_mod(key, folds) == fold
