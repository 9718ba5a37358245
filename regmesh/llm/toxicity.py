"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed terms: words, and word stems (the first letters),
which carry inflected insults. The machine scores
    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j
so a pair such as an insult and a group mention has a weight of its own. Terms
are first screened by their association with the label over the training sample.

The fit reads at most ``max_rows`` labelled rows of each class, those whose hashed
id is smallest, weighted back to the classes' shares; scoring reads whole texts.
Terms are screened by a distributed count, so the driver gets the kept terms alone.

Defined results: a null text is the empty text and still gets a score; null labels
are skipped; of labels that disagree about an id, toxic counts; rows that share an id
count once in the fit, by the least list of terms; without labelled rows of both classes every score is the share of
label 1 (0 without labels); an empty table gives an empty result; repeated rows
each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, crc_mod, small_batches, text_of

WORDS = re.compile(r"\w+")
BITS = 18
STEM = 4
KEEP = 4096


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one lower-case word."""
    out = [zlib.crc32(word.encode("utf-8", "surrogatepass")) >> (32 - BITS)]
    if len(word) > STEM:
        out.append(zlib.crc32(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) >> (32 - BITS))
    return tuple(out)


def terms(text: str) -> list[int]:
    out: set[int] = set()
    for w in set(WORDS.findall(text.lower())):
        out.update(word_terms(w))
    return sorted(out)


@dataclass
class Machine:
    """slot: bucket -> row of w and v, or -1; w0, w (m,), v (m, k)."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score_terms(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, r in enumerate(rows):
            vs = self.v[r]
            s = vs.sum(axis=0)
            out[i] = self.w0 + self.w[r].sum() + 0.5 * float(s @ s - (vs * vs).sum())
        return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def presence(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many rows of label 1, and of label 0, each bucket occurs."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return tuple(np.bincount(flat, weights=(y[own] == v).astype(float), minlength=1 << BITS) for v in (1, 0))


def screen(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` buckets most associated with either class, by the two-proportion z of their presence."""
    na, nb = max(1.0, n_a), max(1.0, n_b)
    p = (a + b + 1) / (na + nb + 2)
    z = (a / na - b / nb) / np.sqrt(p * (1 - p) * (1 / na + 1 / nb))
    z[a + b < 3] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:keep]
    return best[np.abs(z[best]) > 3]


def _slots(chosen: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    return slot


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, keep: int = KEEP, **how) -> Machine:
    """Screens the terms of rows that are at hand, and fits."""
    chosen = screen(*presence(rows, y), int((y == 1).sum()), int((y == 0).sum()), keep)
    slot = _slots(chosen)
    return fit_screened([s[s >= 0] for s in (slot[r] for r in rows)], y, weight, chosen, **how)


def fit_screened(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, chosen: np.ndarray, k: int = 8, epochs: int = 25, rate: float = 0.1, l2: float = 1e-5, seed: int = 11) -> Machine:
    """AdaGrad over mini-batches; the sums over a document's terms are segment sums. docs: numbers of the chosen terms."""
    total = float(weight.sum()) if len(y) else 0.0
    share = float((weight * y).sum() / total) if total else 0.0
    w0 = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    slot = _slots(chosen)
    if not len(y) or len(set(y.tolist())) < 2:
        return Machine(_slots(chosen[:0]), w0, np.zeros(1), np.zeros((1, k)))
    m = max(1, len(chosen))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, 0.02, (m, k))
    gw, gv, g0 = np.full(m, 1e-6), np.full((m, k), 1e-6), 1e-6
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            flat = np.concatenate([docs[i] for i in part])
            own = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
            vs = v[flat]
            s = np.zeros((len(part), k))
            np.add.at(s, own, vs)
            q = np.zeros(len(part))
            np.add.at(q, own, (vs * vs).sum(axis=1))
            raw = w0 + np.bincount(own, weights=w[flat], minlength=len(part)) + 0.5 * ((s * s).sum(axis=1) - q)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) * weight[part] / len(part)
            d0 = err.sum()
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
            dw = np.bincount(flat, weights=err[own], minlength=m).astype(float)
            dv = np.zeros((m, k))
            np.add.at(dv, flat, err[own][:, None] * (s[own] - vs))
            hit = np.unique(flat)
            dw[hit] += l2 * w[hit]
            dv[hit] += l2 * v[hit]
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= 0.3 * rate * dv / np.sqrt(gv)
    return Machine(slot, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, fold: int = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits on labelled rows outside the held-out fold."""
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}  # two rows
    near = F.xxhash64("doc_id")
    chosen = ids.where("y = 1").orderBy(near, "doc_id").limit(max_rows).unionByName(ids.where("y = 0").orderBy(near, "doc_id").limit(max_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text")).join(F.broadcast(chosen), "doc_id")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    found = arrow_map(rows.select("doc_id", "y", "text"), lambda c: {"doc_id": c["doc_id"], "y": c["y"], "t": [terms(t) for t in c["text"]]}, f"doc_id {id_type}, y int, t array<int>")
    found = Scratch(docs.sparkSession, "terms").cut(found.groupBy("doc_id", "y").agg(F.min("t").alias("t")))  # a row an id, however often it is repeated
    n = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    held = found.select("y", F.explode("t").alias("t")).groupBy("t").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n")).toPandas()  # 1 << BITS rows at most
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    a[held["t"]], b[held["t"]] = held["a"], held["n"] - held["a"]
    chosen = screen(a, b, n.get(1, 0), n.get(0, 0))
    slot = docs.sparkSession.sparkContext.broadcast(_slots(chosen))

    def kept(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "y": c["y"], "s": [(lambda s: s[s >= 0].tolist())(slot.value[np.asarray(t, np.int64)]) for t in c["t"]]}

    got = arrow_map(found, kept, f"doc_id {id_type}, y int, s array<int>").toPandas()
    got = got.sort_values(["doc_id", "y"]).reset_index(drop=True)
    y = got["y"].to_numpy(dtype=int)
    weight = np.ones(len(y))
    for label in (0, 1):
        own = y == label
        if own.any():
            weight[own] = counts.get(label, 0) / own.sum()
    if len(weight):
        weight /= weight.mean()
    return fit_screened([np.asarray(x, np.int64) for x in got["s"]], y, weight, chosen)


def scorer(docs: DataFrame, machine: Machine):
    """A column function text -> score; its size is set by BITS and the kept terms."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        slot = m.slot
        cache: dict[str, tuple[int, ...]] = {}
        rows = []
        for t in texts:
            out: set[int] = set()
            for w in set(WORDS.findall((t or "").lower())):
                got = cache.get(w)
                if got is None:
                    got = tuple(int(slot[b]) for b in word_terms(w) if slot[b] >= 0)
                    if len(cache) < 200_000:
                        cache[w] = got
                if got:
                    out.update(got)
            rows.append(np.fromiter(sorted(out), np.int64, len(out)))
        return pd.Series(m.score_terms(rows))

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **fit_with) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    score = scorer(docs, train(docs, labels, id_col=id_col, text_col=text_col, **fit_with))
    out = docs.select(F.col(id_col).alias("doc_id"), score(text_of(F.col(text_col))).alias("score"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
