"""Least squares over streams: additive sufficient statistics, merged micro-batch by micro-batch.

The state is k-sized: rows, sums and cross products. A batch adds its own moments, so
results over a stream equal those over all rows at once, and a batch that is replayed
is recognised by its number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distributions as dist
from ..operators.moments import moments
from ..operators.ols import independent_columns, spd_inverse
from ..operators.savi import log_e_value
from ..scratch import shared_dir


@dataclass
class OlsState:
    """Moments of [1, x.., y]; the first column is the intercept."""

    x_names: list[str]
    intercept: bool = True
    products: np.ndarray | None = None
    last_batch: int = -1
    seen: list[int] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return (["Intercept"] if self.intercept else []) + self.x_names

    @property
    def n(self) -> float:
        return 0.0 if self.products is None else float(self.products[0, 0])

    def add(self, frame: DataFrame, y: str, batch: int | None = None) -> OlsState:
        """Adds the rows of a batch; a number at or under the last one was added before."""
        if batch is not None and batch <= self.last_batch:
            return self
        cols = [F.expr(c).cast("double") for c in [*self.x_names, y]]
        keep = F.lit(True)
        for c in cols:
            keep = keep & c.isNotNull() & ~F.isnan(c)
        n, _, m = moments(frame.where(keep), cols, F.lit(1.0))
        if n:
            self.products = m if self.products is None else self.products + m
        self.last_batch = self.last_batch if batch is None else batch
        return self

    def merge(self, other: OlsState) -> OlsState:
        if other.products is not None:
            self.products = other.products if self.products is None else self.products + other.products
        return self

    def _parts(self) -> tuple[np.ndarray, np.ndarray, float]:
        if self.products is None:
            raise ValueError("no rows yet")
        at = np.arange(0 if self.intercept else 1, len(self.x_names) + 1)
        return self.products[np.ix_(at, at)], self.products[at, -1], float(self.products[-1, -1])

    def coef(self) -> np.ndarray:
        xx, xy, _ = self._parts()
        keep = np.flatnonzero(independent_columns(xx))
        out = np.full(len(xx), np.nan)
        out[keep] = spd_inverse(xx[np.ix_(keep, keep)]) @ xy[keep]
        return out

    def tidy(self) -> list[tuple[str, float, float, float, float]]:
        """name, estimate, error, p-value and the e-value that stays valid while the stream goes on."""
        xx, xy, yy = self._parts()
        b, k, n = self.coef(), len(xx), self.n
        s2 = max(yy - 2 * b @ xy + b @ xx @ b, 0.0) / (n - k)
        se = np.sqrt(s2 * np.diag(spd_inverse(xx)))
        return [(name, float(e), float(s), 2 * dist.t_sf(abs(e / s), n - k), float(np.exp(min(700.0, log_e_value((e / s) ** 2, 1, n - k, n, 1.0))))) for name, e, s in zip(self.names, b, se, strict=True)]


def update(model, new_rows: DataFrame) -> np.ndarray:
    """Coefficients of a fitted OLS model without effects when rows are added, from the old moments and the new rows alone."""
    d = model.design
    if d.fe or model.is_iv or d.weighted:
        raise ValueError("updates are for unweighted OLS without fixed effects or instruments")
    from ..plans.design import build

    extra = build(d.formula, new_rows, state=d.state, **d.spec)
    # the model's products are of columns less its rough centre: so are the new ones
    _, sums, m = moments(extra.frame, [F.col(c) - F.lit(float(v)) for c, v in zip(model.names_all, model.centre, strict=True)], F.lit(1.0))
    n, sums, total = model.sum_w + m[0, 0], model.absorbed.sums + sums[1:], model.absorbed.total + m[1:, 1:]
    at = model.x_at
    if not model.intercept:
        return spd_inverse(total[np.ix_(at, at)]) @ total[at, 0]
    gram, mean = total - np.outer(sums, sums) / n, sums / n + model.centre
    slopes = spd_inverse(gram[np.ix_(at, at)]) @ gram[at, 0]
    return np.concatenate([[mean[0] - mean[at] @ slopes], slopes])


def stream_ols(spark: SparkSession, path: str, schema: T.StructType, y: str, x: list[str], fmt: str = "parquet", files_per_batch: int = 1, **options) -> OlsState:
    """Reads the files of path as a stream until it is drained, and returns the state over all of it."""
    state = OlsState(x)
    single = path.rstrip("/")
    head, _, name = single.rpartition("/")
    # a stream reads a folder; a single file is picked out of its own by name
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).options(**options)
    stream = reader.option("pathGlobFilter", name).load(head) if "." in name else reader.load(single)
    query = stream.writeStream.foreachBatch(lambda batch, number: state.add(batch, y, number) and None).option("checkpointLocation", f"{shared_dir(spark)}/stream-{id(state)}-{np.random.default_rng().integers(1 << 40)}").trigger(availableNow=True).start()
    query.awaitTermination()
    return state


def windowed_moments(stream: DataFrame, time: str, window: str, y: str, x: list[str], watermark: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Moments by event-time window, tumbling or sliding, with late rows dropped after the watermark: one row a window."""
    cols = [F.lit(1.0), *[F.expr(c).cast("double") for c in x], F.expr(y).cast("double")]
    w = F.window(time, window, slide) if slide else F.window(time, window)
    sums = [F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return stream.withWatermark(time, watermark).groupBy(w.alias("window")).agg(*sums)


def coefficients_of(row, k: int) -> np.ndarray:
    """Coefficients from one row of windowed moments; k: columns with the intercept and y."""
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m{i}_{j}"]
    return spd_inverse(m[:-1, :-1]) @ m[:-1, -1]
