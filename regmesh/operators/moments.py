"""Weighted cross products of columns, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns the products are sums in the JVM; beyond, Arrow batches are multiplied as matrices.
WIDE = 12


def rough_centre(frame: DataFrame, cols: list[str], rows: int = 1000) -> np.ndarray:
    """About the mean of each column, from the first rows: any value near it removes cancellation."""
    got = frame.select(*cols).limit(rows).agg(*[F.avg(c) for c in cols]).first()
    return np.array([float(v) if v is not None and np.isfinite(v) else 0.0 for v in got])


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def square(values, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for v, (i, j) in zip(values, pairs(k), strict=True):
        out[i, j] = out[j, i] = 0.0 if v is None else v
    return out


def product_sums(cols: list[Column], w: Column | None = None) -> list[Column]:
    """Sums of the products of all pairs, upper triangle by rows."""
    return [F.sum(cols[i] * cols[j] if w is None else w * cols[i] * cols[j]) for i, j in pairs(len(cols))]


def moments(frame: DataFrame, cols: list[Column], w: Column) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, weighted sums of [1, cols] and weighted products of [1, cols]."""
    k = len(cols)
    if k <= WIDE:
        one = [F.lit(1.0), *cols]
        got = list(frame.agg(F.count(F.lit(1)), *product_sums(one, w)).first())
        m = square(got[1:], k + 1)
        return float(got[0]), m[0], m
    names = [f"c{i}" for i in range(k)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k + 1, k + 1)), 0
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows)] + [b.column(i).to_numpy(zero_copy_only=False) for i in range(k)])
            total += x.T @ (x * b.column(k).to_numpy(zero_copy_only=False)[:, None])
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().tolist()])], names=["n", "m"])

    rows = frame.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], w.cast("double").alias("w")).mapInArrow(partial, "n long, m array<double>")
    got = rows.agg(F.sum("n"), *[F.sum(F.col("m")[i]) for i in range((k + 1) ** 2)]).first()
    m = np.array(got[1:], dtype=float).reshape(k + 1, k + 1)
    return float(got[0]), m[0], m


def moments_with(frame: DataFrame, cols: list[Column], w: Column, extra: Column) -> tuple[float, np.ndarray, float]:
    """Rows, weighted products of [1, cols], and the plain sum of one more column, in one pass."""
    k = len(cols)
    if k <= WIDE:
        got = list(frame.agg(F.count(F.lit(1)), F.sum(extra), *product_sums([F.lit(1.0), *cols], w)).first())
        return float(got[0]), square(got[2:], k + 1), float(got[1] if got[1] is not None else np.nan)
    # the extra column over the weight has the weighted sum that is its plain one
    n, _, m = moments(frame, [*cols, extra / w], w)
    return n, m[: k + 1, : k + 1], float(m[0, k + 1])
