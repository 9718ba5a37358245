"""Absorption of fixed effects: column minus the sum of its effects' levels.

One effect: the group means, in closed form and fully distributed. More effects: rows
collapse to cells (one for each combination of levels), which are exact sufficient
statistics; the normal equations are solved over levels by conjugate gradients for all
columns at once, with the effect of most levels eliminated. Up to ``max_cells`` cells
the driver works on the cells themselves (the bound is checked by a count first). Beyond,
each level of the eliminated effect becomes one row that holds its cells, and a step is
one pass over those rows: the driver keeps vectors over the other effects' levels alone.
Where even those are too many, sweeps of group means run as joins over the cell table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NonConvergenceError
from ..scratch import cut, drop
from .moments import WIDE, moments, pairs, product_sums, square

MAX_CELLS = 2_000_000
MAX_NUMBERS = 30_000_000  # levels times columns of the effects that are not eliminated: what a vector on the driver holds


@dataclass(frozen=True)
class Demeaner:
    """How effects are absorbed. method: auto and cg (conjugate gradients over levels, on the driver up to max_cells), or map (always sweeps)."""

    method: str = "auto"
    tol: float = 1e-10
    max_iter: int = 10_000
    max_cells: int = MAX_CELLS

    def __post_init__(self):
        if self.method not in ("auto", "cg", "map"):
            raise ValueError("method is auto, cg or map")

    @property
    def cells(self) -> int:
        return -1 if self.method == "map" else max(0, self.max_cells)


@dataclass
class Absorbed:
    """gram: weighted products of the absorbed columns; levels: by effect a table (__f, a0..) of what to subtract."""

    n: float
    sum_w: float
    sums: np.ndarray
    total: np.ndarray
    gram: np.ndarray
    k_fe: list[int]
    levels: list[DataFrame] = field(default_factory=list)
    iterations: int = 0
    gap: float = 0.0
    extra: float = 0.0  # the plain sum of one more column, on demand
    local: list[pd.DataFrame] | None = None  # the level tables where the driver solved for them

    def demean(self, frame: DataFrame, fe: list[str], cols: list[Column], names: list[str]) -> DataFrame:
        """frame with the absorbed columns under the names."""
        out = frame
        for i, table in enumerate(self.levels):
            t = table.select(F.col("__f").alias(f"__j{i}"), *[F.col(f"a{k}").alias(f"__a{i}_{k}") for k in range(len(cols))])
            out = out.join(t, F.col(fe[i]) == F.col(f"__j{i}"), "inner").drop(f"__j{i}")
        made = []
        for k, c in enumerate(cols):
            v = c
            for i in range(len(self.levels)):
                v = v - F.col(f"__a{i}_{k}")
            made.append(v.alias(names[k]))
        return out.select(*[F.col(f"`{c}`") for c in frame.columns if c not in names], *made)


def absorb(frame: DataFrame, cols: list[Column], w: Column, fe: list[str], tol: float = 1e-10, max_iter: int = 10_000, max_cells: int = MAX_CELLS, extra: Column | None = None) -> Absorbed:
    extra = F.lit(0.0) if extra is None else extra
    if not fe:
        n, sums, m = moments(frame, cols, w)
        return Absorbed(n, m[0, 0], sums[1:], m[1:, 1:], m[1:, 1:], [])
    return _one(frame, cols, w, fe[0], extra) if len(fe) == 1 else _several(frame, cols, w, fe, tol, max_iter, max_cells, extra)


def _one(frame: DataFrame, cols: list[Column], w: Column, fe: str, extra: Column) -> Absorbed:
    p = len(cols)
    means = frame.groupBy(fe).agg(*[(F.sum(w * c) / F.sum(w)).alias(f"a{k}") for k, c in enumerate(cols)]).withColumnRenamed(fe, "__f")
    if p > WIDE:  # products as matrices: of the rows, and of the group means
        n, sums, m = moments(frame, cols, w)
        groups = frame.groupBy(fe).agg(F.sum(w).alias("w"), F.sum(extra).alias("x"), *[F.sum(w * c).alias(f"s{k}") for k, c in enumerate(cols)])
        more = float(groups.agg(F.sum("x")).first()[0] or 0)
        count, _, g = moments(groups, [F.col(f"s{k}") / F.col("w") for k in range(p)], F.col("w"))
        return Absorbed(n, m[0, 0], sums[1:], m[1:, 1:], m[1:, 1:] - g[1:, 1:], [int(count)], [means], extra=more)
    groups = frame.groupBy(fe).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"s{k}") for k, c in enumerate(cols)], *[x.alias(f"q{i}") for i, x in enumerate(product_sums(cols, w))], F.sum(extra).alias("x"))
    got = groups.agg(
        F.sum("n"), F.sum("w"), F.count(F.lit(1)), *[F.sum(f"s{k}") for k in range(p)], *[F.sum(f"q{i}") for i in range(len(pairs(p)))],
        *[F.sum(F.col(f"q{i}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("w")) for i, (a, b) in enumerate(pairs(p))], F.sum("x"),
    ).first()
    q, more = len(pairs(p)), _total(got[-1])
    return Absorbed(float(got[0] or 0), float(got[1] or 0), np.array([v or 0.0 for v in got[3 : 3 + p]]), square(got[3 + p : 3 + p + q], p), square(got[3 + p + q : -1], p), [int(got[2])], [means], extra=more)


def _total(v) -> float:
    return float("nan") if v is None else float(v)


def cells_of(frame: DataFrame, cols: list[Column], w: Column, fe: list[str], extra: Column) -> DataFrame:
    products = product_sums(cols, w) if len(cols) <= WIDE else []
    return frame.groupBy(*fe).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), *[F.sum(w * c).alias(f"s{k}") for k, c in enumerate(cols)], *[x.alias(f"q{i}") for i, x in enumerate(products)], F.sum(extra).alias("x"))


def _several(frame: DataFrame, cols: list[Column], w: Column, fe: list[str], tol: float, max_iter: int, max_cells: int, extra: Column) -> Absorbed:
    p = len(cols)
    q = len(pairs(p)) if p <= WIDE else 0
    cells = cells_of(frame, cols, w, fe, extra).persist()
    try:
        got = cells.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w"), *[F.sum(f"s{k}") for k in range(p)], *[F.sum(f"q{i}") for i in range(q)], F.sum("x")).first()
        more = _total(got[-1])
        count, n, sum_w = int(got[0]), float(got[1] or 0), float(got[2] or 0)
        sums, total = np.array([v or 0.0 for v in got[3 : 3 + p]]), square(got[3 + p : 3 + p + q], p) if q else moments(frame, cols, w)[2][1:, 1:]
        if max_cells < 0:
            k_fe = [cells.select(f).distinct().count() for f in fe]
            return replace(_sweeps(cells, fe, p, n, sum_w, sums, total, k_fe, max(tol, 1e-9), max_iter), extra=more)
        found = solve_cells(cells, fe, "w", [f"s{k}" for k in range(p)], tol, max_iter, max_cells, count)
        if found is None:
            k_fe = [cells.select(f).distinct().count() for f in fe]
            return replace(_sweeps(cells, fe, p, n, sum_w, sums, total, k_fe, max(tol, 1e-9), max_iter), extra=more)
    finally:
        cells.unpersist()
    gram = total - found.cross
    return Absorbed(n, sum_w, sums, total, 0.5 * (gram + gram.T), found.k_fe, found.levels, found.iterations, found.gap, more, found.local)


@dataclass
class Solved:
    """levels: by effect a table (__f, a0..); cross: sums over cells times fitted sums."""

    levels: list[DataFrame]
    cross: np.ndarray
    k_fe: list[int]
    iterations: int
    gap: float
    local: list[pd.DataFrame] | None = None


def solve_cells(cells: DataFrame, fe: list[str], w: str, sums: list[str], tol: float, max_iter: int, max_cells: int, count: int | None = None) -> Solved | None:
    """Level values that leave all weighted level sums of the cells' columns at zero; None where no driver holds the vectors."""
    if (cells.count() if count is None else count) > max_cells:
        return _solve_groups(cells, fe, w, sums, tol, max_iter)
    table = cells.select(*fe, w, *sums).toPandas()  # at most max_cells rows
    codes, names = [], []
    for f in fe:
        c, u = pd.factorize(table[f])
        codes.append(c.astype(np.int64))
        names.append(u)
    weight, s = table[w].to_numpy(float), table[sums].to_numpy(float).reshape(len(table), len(sums))
    alphas, iterations, gap = solve_levels(codes, [len(u) for u in names], weight, s, tol, max_iter)
    local = []
    for u, a in zip(names, alphas, strict=True):
        out = pd.DataFrame(a, columns=[f"a{k}" for k in range(len(sums))])
        out.insert(0, "__f", np.asarray(u))
        local.append(out)
    levels = [cells.sparkSession.createDataFrame(t, _level_schema(cells, f, len(sums))) for t, f in zip(local, fe, strict=True)]
    fitted = sum(a[c] for a, c in zip(alphas, codes, strict=True))
    return Solved(levels, s.T @ fitted, [len(u) for u in names], iterations, gap, local)


def _level_schema(cells: DataFrame, f: str, p: int) -> str:
    return ", ".join([f"__f {cells.schema[f].dataType.simpleString()}", *[f"a{k} double" for k in range(p)]])


# --- levels solved over rows that are groups of cells ------------------------------------


def _unpack(batch: pa.RecordBatch, lists: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where each group's cells begin, the group of each cell, and the flat columns; no group is empty."""
    cols = [batch.column(batch.schema.get_field_index(c)) for c in lists]
    first = cols[0].offsets.to_numpy()
    base = first - first[0]
    return base[:-1], np.repeat(np.arange(batch.num_rows), np.diff(base)), [c.flatten().to_numpy(zero_copy_only=False) for c in cols]


def _centred_sums(starts: np.ndarray, own: np.ndarray, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v (weighted sums by cell) less the group's share, and the group means. A group without weight has no mean."""
    mass = np.add.reduceat(w, starts)
    mean = np.add.reduceat(v, starts, axis=0) / np.where(mass > 0, mass, 1.0)[:, None]
    return v - w[:, None] * mean[own], mean


def _solve_groups(cells: DataFrame, fe: list[str], w: str, sums: list[str], tol: float, max_iter: int) -> Solved | None:
    spark, p = cells.sparkSession, len(sums)
    sizes = [cells.select(f).distinct().count() for f in fe]
    big = int(np.argmax(sizes))
    rest = [i for i in range(len(fe)) if i != big]
    if sum(sizes[i] for i in rest) * max(1, p) > MAX_NUMBERS:
        return None
    # levels of the other effects get numbers; a row is a level of the eliminated effect with all of its cells
    names = [cells.select(fe[i]).distinct().orderBy(fe[i]).toPandas()[fe[i]] for i in rest]  # bounded by MAX_NUMBERS
    low = np.cumsum([0, *[len(u) for u in names]])
    coded = cells.select(*fe, w, *sums)
    for j, i in enumerate(rest):
        numbers = spark.createDataFrame(pd.DataFrame({f"l{j}": names[j], f"c{j}": np.arange(len(names[j])) + low[j]}), f"l{j} {cells.schema[fe[i]].dataType.simpleString()}, c{j} int")
        coded = coded.join(numbers, F.col(fe[i]) == F.col(f"l{j}")).drop(f"l{j}")
    lists = [*[f"c{j}" for j in range(len(rest))], "w", *[f"s{k}" for k in range(p)]]
    packed = F.collect_list(F.struct(*[F.col(f"c{j}") for j in range(len(rest))], F.col(w).alias("w"), *[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(sums)]))
    groups = cut(coded.groupBy(F.col(fe[big]).alias("__f")).agg(packed.alias("x")).select("__f", *[F.col(f"x.{c}").alias(c) for c in lists]), "groups")
    m, total = len(rest), int(low[-1])

    def summed(value: Callable, width: int) -> np.ndarray:
        """Sums by level of value(starts, own, codes, w, s), a matrix of ``width`` columns by cell: one pass."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, hit = np.zeros((total, width)), np.zeros(total, bool)
            for b in batches:
                if b.num_rows:
                    starts, own, flat = _unpack(b, lists)
                    v = value(starts, own, flat[:m], flat[m], np.column_stack(flat[m + 1 :]) if p else np.zeros((len(own), 0)))
                    for c in flat[:m]:
                        hit[c] = True
                        for k in range(width):
                            out[:, k] += np.bincount(c, weights=v[:, k], minlength=total)
            at = np.flatnonzero(hit)
            for start in range(0, len(at), 100_000):
                part = at[start : start + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(out[part, k]) for k in range(width)]], names=["c", *[f"v{k}" for k in range(width)]])

        cols = [f"v{k}" for k in range(width)]
        got = groups.mapInArrow(run, "c int, " + ", ".join(f"{c} double" for c in cols)).groupBy("c").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # a row a level
        out = np.zeros((total, width))
        out[got["c"].to_numpy()] = got[cols].to_numpy(float)
        return out

    # the right-hand side, and each level's weight in the same pass
    first = summed(lambda starts, own, codes, w, s: np.column_stack([_centred_sums(starts, own, w, s)[0], w]), p + 1)
    b, mass = first[:, :p], np.maximum(first[:, p:], 1e-300)

    def matvec(x: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(x)  # levels times columns, bounded by MAX_NUMBERS
        try:
            return summed(lambda starts, own, codes, w, s: _centred_sums(starts, own, w, w[:, None] * sum(held.value[c] for c in codes))[0], p)
        finally:
            held.unpersist()

    x, iterations, left = _conjugate(matvec, b, 1.0 / mass, tol, max_iter)
    held = spark.sparkContext.broadcast(x)

    def eliminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The values of the eliminated effect's levels, and the batch's share of the cross products in its first row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, own, flat = _unpack(batch, lists)
            w, s = flat[m], np.column_stack(flat[m + 1 :])
            spread = sum(held.value[c] for c in flat[:m])
            _, mean = _centred_sums(starts, own, w, s - w[:, None] * spread)
            cross = np.zeros((batch.num_rows, p * p))
            cross[0] = (s.T @ (mean[own] + spread)).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(mean[:, k]) for k in range(p)], *[pa.array(cross[:, k]) for k in range(p * p)]], names=["__f", *[f"a{k}" for k in range(p)], *[f"x{k}" for k in range(p * p)]])

    schema = _level_schema(cells, fe[big], p) + "".join(f", x{k} double" for k in range(p * p))
    own_levels = cut(groups.mapInArrow(eliminated, schema), "levels")
    cross = np.array(own_levels.agg(*[F.sum(f"x{k}") for k in range(p * p)]).first(), dtype=float).reshape(p, p)
    drop(groups)
    levels: list = [None] * len(fe)
    levels[big] = own_levels.select("__f", *[f"a{k}" for k in range(p)])
    for j, i in enumerate(rest):
        table = pd.DataFrame(x[low[j] : low[j + 1]], columns=[f"a{k}" for k in range(p)])
        table.insert(0, "__f", names[j].to_numpy())
        levels[i] = spark.createDataFrame(table, _level_schema(cells, fe[i], p))
    return Solved(levels, 0.5 * (cross + cross.T), sizes, iterations, float(np.abs(left / mass).max(initial=0.0)))


def _conjugate(matvec: Callable, b: np.ndarray, scale: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Preconditioned conjugate gradients for all columns at once; each has steps of its own. Also the residual that is left."""
    x, r = np.zeros_like(b), b.copy()
    z = scale * r
    d, rz = z.copy(), (r * z).sum(axis=0)
    bound = tol * tol * np.maximum((b * scale * b).sum(axis=0), 1e-300)
    iterations = 0
    while (rz > bound).any():
        if iterations >= max_iter:
            raise NonConvergenceError(f"absorption did not converge in {max_iter} steps")
        iterations += 1
        ad = matvec(d)
        da = (d * ad).sum(axis=0)
        step = np.where(da > 0, rz / np.where(da > 0, da, 1.0), 0.0)
        x += step * d
        r -= step * ad
        z = scale * r
        after = (r * z).sum(axis=0)
        d = z + np.where(rz > 0, after / np.where(rz > 0, rz, 1.0), 0.0) * d
        rz = after
    return x, iterations, r


def _add_up(codes: np.ndarray, size: int, v: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(codes, weights=v[:, k], minlength=size) for k in range(v.shape[1])])


def solve_levels(codes: list[np.ndarray], sizes: list[int], w: np.ndarray, s: np.ndarray, tol: float, max_iter: int) -> tuple[list[np.ndarray], int, float]:
    """Level values (one array an effect) that leave all weighted level sums of the residual at zero; s: weighted sums by cell."""
    alphas, iterations = solve_normal(codes, sizes, w, [_add_up(c, m, s) for c, m in zip(codes, sizes, strict=True)], tol, max_iter)
    left = s - w[:, None] * sum(a[c] for a, c in zip(alphas, codes, strict=True))
    mass = [np.bincount(c, weights=w, minlength=m) for c, m in zip(codes, sizes, strict=True)]
    gap = max(float(np.abs(_add_up(c, m, left) / g[:, None]).max(initial=0.0)) for c, m, g in zip(codes, sizes, mass, strict=True)) if s.shape[1] else 0.0
    return alphas, iterations, gap


def solve_normal(codes: list[np.ndarray], sizes: list[int], w: np.ndarray, rhs: list[np.ndarray], tol: float = 1e-10, max_iter: int = 10_000) -> tuple[list[np.ndarray], int]:
    """Solves the normal equations of the effects' indicators for right-hand sides given by level."""
    big = int(np.argmax(sizes))
    rest = [i for i in range(len(codes)) if i != big]
    mass = [np.bincount(c, weights=w, minlength=m) for c, m in zip(codes, sizes, strict=True)]

    def spread(x: list[np.ndarray]) -> np.ndarray:
        return sum(v[codes[i]] for i, v in zip(rest, x, strict=True))

    def onto(v: np.ndarray) -> list[np.ndarray]:
        """Sums over the other effects of v less its means over the eliminated one; v is weighted."""
        r = v - w[:, None] * (_add_up(codes[big], sizes[big], v) / mass[big][:, None])[codes[big]]
        return [_add_up(codes[i], sizes[i], r) for i in rest]

    if not rest:
        return [rhs[big] / mass[big][:, None]], 0

    stack = np.concatenate
    cuts = np.cumsum([sizes[i] for i in rest])[:-1]
    split = lambda x: np.split(x, cuts)
    matvec = lambda x: stack(onto(w[:, None] * spread(split(x))))
    scale = 1.0 / stack([mass[i] for i in rest])[:, None]
    pulled = w[:, None] * (rhs[big] / mass[big][:, None])[codes[big]]
    b = stack([rhs[i] - _add_up(codes[i], sizes[i], pulled) for i in rest])
    x, iterations, _ = _conjugate(matvec, b, scale, tol, max_iter)
    alphas: list = [None] * len(codes)
    for i, v in zip(rest, split(x), strict=True):
        alphas[i] = v
    alphas[big] = (rhs[big] - _add_up(codes[big], sizes[big], w[:, None] * spread(split(x)))) / mass[big][:, None]
    return alphas, iterations


def _sweeps(cells: DataFrame, fe: list[str], p: int, n: float, sum_w: float, sums, total, k_fe: list[int], tol: float, max_iter: int) -> Absorbed:
    """Alternating projections over the cell table, for cells that no driver holds."""
    means = [F.col(f"s{k}") / F.col("w") for k in range(p)]
    now = cut(cells.select(*fe, "w", *[m.alias(f"r{k}") for k, m in enumerate(means)], *[F.lit(0.0).alias(f"a{i}_{k}") for i in range(len(fe)) for k in range(p)], *[m.alias(f"m{k}") for k, m in enumerate(means)]), "cells")
    iterations, gap = 0, float("inf")
    spread = [float(v) or 1.0 for v in now.agg(*[F.coalesce(F.stddev(f"m{k}"), F.lit(1.0)) for k in range(p)]).first()]
    while iterations < max_iter:
        iterations += 1
        old = now
        for i, f in enumerate(fe):
            level = now.groupBy(f).agg(*[(F.sum(F.col("w") * F.col(f"r{k}")) / F.sum("w")).alias(f"d{k}") for k in range(p)])
            now = now.join(level, f)
            now = now.select(
                *fe, "w", *[(F.col(f"r{k}") - F.col(f"d{k}")).alias(f"r{k}") for k in range(p)], *[F.col(f"m{k}") for k in range(p)],
                *[(F.col(f"a{j}_{k}") + (F.col(f"d{k}") if j == i else F.lit(0.0))).alias(f"a{j}_{k}") for j in range(len(fe)) for k in range(p)],
                *[F.greatest(F.abs(F.col(f"d{k}")), F.col(f"g{k}") if i else F.lit(0.0)).alias(f"g{k}") for k in range(p)],
            )
        now = cut(now, "cells")
        drop(old)
        gap = max((v or 0.0) / s for v, s in zip(now.agg(*[F.max(f"g{k}") for k in range(p)]).first(), spread, strict=True))
        path, now = now._scratch_path, now.drop(*[f"g{k}" for k in range(p)])
        now._scratch_path = path
        if gap < tol:
            break
    else:
        raise NonConvergenceError(f"absorption did not converge in {max_iter} sweeps")
    # what the sweeps took out is orthogonal to what they left
    both = moments(now, [*[F.col(f"m{k}") for k in range(p)], *[F.col(f"r{k}") for k in range(p)]], F.col("w"))[2][1:, 1:]
    gram = both[:p, :p] - 0.5 * (both[:p, p:] + both[:p, p:].T)
    levels = [now.groupBy(f).agg(*[F.first(f"a{i}_{k}").alias(f"a{k}") for k in range(p)]).withColumnRenamed(f, "__f") for i, f in enumerate(fe)]
    return Absorbed(n, sum_w, sums, total, total - gram, k_fe, levels, iterations, gap)


def drop_singletons(frame: DataFrame, fe: list[str], max_cells: int = MAX_CELLS) -> tuple[DataFrame, int]:
    """frame without rows whose level of some effect occurs once, repeated until nothing changes; and the rows dropped."""
    if not fe:
        return frame, 0
    # level counts first, effect by effect: mostly no level is alone, and then that is all
    lone = reduce(lambda x, y: x.unionByName(y), [frame.groupBy(F.col(f).alias("f")).agg(F.count(F.lit(1)).alias("k")).agg(F.min("k").alias("k")) for f in fe])
    if (lone.agg(F.min("k")).first()[0] or 2) > 1:
        return frame, 0
    cells = frame.groupBy(*fe).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        if cells.count() > max_cells:
            return _drop_by_joins(frame, cells, fe)
        table = cells.toPandas()  # at most max_cells rows
    finally:
        cells.unpersist()
    n = table["n"].to_numpy(np.int64)
    keep = np.ones(len(n), bool)
    codes = [pd.factorize(table[f])[0] for f in fe]
    while True:
        before = int(keep.sum())
        for c in codes:
            keep &= np.bincount(c[keep], weights=n[keep], minlength=c.max() + 1)[c] > 1
        if int(keep.sum()) == before:
            break
    # a lone cell has one row, so what goes is named by cells; few against all rows
    gone = frame.sparkSession.createDataFrame(table.loc[~keep, fe], frame.select(*fe).schema)
    return frame.join(gone, fe, "left_anti").select(*frame.columns), int(n[~keep].sum())


def _drop_by_joins(frame: DataFrame, cells: DataFrame, fe: list[str]) -> tuple[DataFrame, int]:
    start = cells.agg(F.sum("n")).first()[0] or 0
    now, rows = cut(cells, "singletons"), start
    while True:
        old = now
        for f in fe:
            many = now.groupBy(f).agg(F.sum("n").alias("k")).where("k > 1").select(f)
            now = now.join(many, f, "left_semi")
        now = cut(now, "singletons")
        drop(old)
        left = now.agg(F.sum("n")).first()[0] or 0
        if left == rows:
            break
        rows = left
    return frame.join(now.select(*fe), fe, "left_semi").select(*frame.columns), int(start - rows)
