"""Quality rules: robust multivariate outliers by minimum covariance determinant (MCD).

Each document becomes a vector of transformed statistics. For each (lang, source)
group several deterministic starts (medians with MADs, correlations of tanh scores,
spatial signs) take two concentration steps each: keep the fraction ``h`` of the rows
nearest to the present estimate, re-estimate. The start of least determinant goes on
until the determinant falls no more. The scatter is ridged towards the scales of all
rows (the regularised MCD), so that statistics that are constant in a group stay
regular, and made consistent for normal data by the factor that belongs to ``h``. A
document is rejected where its squared Mahalanobis distance passes the chi-squared
quantile that a clean one passes with probability ``level``; the default expects less
than one in 10^10 documents. All documents take part in every step, copies by one
vector a group, since copies are no further evidence of how a group varies; each step is
a few partial aggregations, so a hot group never meets in one task.

Defined results: a null text has no words and fails the base rule; a null lang or
source is the empty group name; groups under ``min_rows`` are pooled by language,
and those still smaller over all languages; rows in the band of distances that completes
the fraction h count by the share that is needed, so ties do not depend on an order; an empty table gives an empty result; repeated
rows each get their own row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = b"[#*$%&|<>]"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCT = b"!?;:|=~^_/\\"
SYMBOL_CHARS = b"#*$%&|<>"
WINDOW = 8
DIMS = 6


def repeat_words(words: list) -> int:
    """Words lying in 8-word windows that occur twice or more in the text, exactly: pairs of ids are ranked, then fours, then eights."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == n:
        return 0
    code = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    step = 1
    while step < WINDOW:
        pair = code[:-step] * (int(code.max()) + 1) + code[step:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        step *= 2
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> dict:
    """The contract's counts, and what the vectors need besides."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    deleted = len(joined) - len(joined.translate(None, SYMBOL_CHARS))
    seen: set = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and line.split(None, 1):
            seen.add(line)
    continuation = len(joined.translate(None, bytes(range(0x80, 0xC0))))
    return {
        "n_words": len(words), "word_chars": continuation, "n_symbols": deleted, "n_dup_lines": dup, "n_repeat_words": repeat_words(words),
        "n_upper": len(joined) - len(joined.translate(None, UPPER)), "n_punct": len(joined) - len(joined.translate(None, PUNCT)), "n_distinct": len(set(words)),
    }


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_punct", "n_distinct")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"), text_of(F.col(lang_col).cast("string")).alias("lang"), text_of(F.col(source_col).cast("string")).alias("source"))

    def fn(cols: dict) -> dict:
        counts = [base_counts(t) for t in cols["text"]]
        return {k: cols[k] for k in ("doc_id", "lang", "source")} | {k: [c[k] for c in counts] for k in (*BASE, *MORE)}

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, fn, f"doc_id {id_type}, lang string, source string, " + ", ".join(f"{k} long" for k in (*BASE, *MORE)))


def vector() -> list[Column]:
    """Transformed statistics; short texts are drawn to a common value so that chance in few words is no outlier."""
    n = F.col("n_words").cast("double")
    chars = F.col("word_chars").cast("double")
    return [
        F.log1p(n),
        (chars + 250.0) / (n + 50.0),
        F.log1p(100.0 * F.col("n_symbols") / (n + 50.0)),
        F.log1p(200.0 * F.col("n_upper") / (chars + 300.0)),
        F.log1p(100.0 * F.col("n_punct") / (n + 50.0)),
        F.log((F.col("n_distinct") + 20.0) / (n + 20.0)),
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _distance(z: list[Column]) -> Column:
    terms = [(1.0 if i == j else 2.0) * F.col("p")[k] * z[i] * z[j] for k, (i, j) in enumerate(_pairs())]
    return reduce(lambda a, b: a + b, terms)


def _chi2_cdf(half_dims: int, x: float) -> float:
    """Chi-squared with an even number of degrees of freedom."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half_dims))


def chi2_bound(level: float) -> float:
    """What chi-squared with DIMS degrees of freedom passes with probability ``level``."""
    low, high = 0.0, 2000.0
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(DIMS // 2))
    for _ in range(200):
        low, high = ((low + high) / 2, high) if tail((low + high) / 2) > level else (low, (low + high) / 2)
    return high


def consistency(h: float) -> float:
    """By how much the scatter of the nearest fraction h of normal data falls short."""
    return h / _chi2_cdf(DIMS // 2 + 1, chi2_bound(1.0 - h)) if h < 1 else 1.0


def _square(c: list[float]) -> np.ndarray:
    s = np.zeros((DIMS, DIMS))
    for v, (i, j) in zip(c, _pairs(), strict=True):
        s[i, j] = s[j, i] = v
    return s


def ridged(scatter: np.ndarray, target: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of the scatter drawn towards a diagonal target."""
    s = (1.0 - ridge) * scatter + ridge * np.diag(target)
    return np.linalg.inv(s), float(np.linalg.slogdet(s)[1])


def _invert(groups: DataFrame, target: np.ndarray, ridge: float) -> DataFrame:
    """grp, start, m, p, det: centre, upper triangle of the inverse scatter, log determinant."""

    def fn(cols: dict) -> dict:
        found = [ridged(_square(c), target, ridge) for c in cols["c"]]
        return {k: cols[k] for k in ("grp", "start", "m")} | {"p": [[float(inv[i, j]) for i, j in _pairs()] for inv, _ in found], "det": [d for _, d in found]}

    return arrow_map(groups.select("grp", "start", "m", "c"), fn, "grp string, start int, m array<double>, p array<double>, det double")


BANDS = 16  # bands of squared distance to a factor of two
#: Groups whose estimates, some 600 bytes each, are sent to all tasks; more are joined by shuffle, where AQE splits a hot group.
FEW = 20_000


def _beside(rows: DataFrame, table: DataFrame, on: list[str], size: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if size <= FEW else table, on, how)


def _sums(z: list[Column]) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"t{i}") for i, v in enumerate(z)], *[F.sum(z[i] * z[j]).alias(f"c{i}_{j}") for i, j in _pairs()]]


def _centred() -> Column:
    """Covariance from the sums, by _pairs."""
    n = F.col("n")
    return F.array(*[F.col(f"c{i}_{j}") / n - F.col(f"t{i}") * F.col(f"t{j}") / (n * n) for i, j in _pairs()])


def _median(x: Column) -> Column:
    return F.percentile_approx(x, 0.5, 1000)


def pooled_scales(rows: DataFrame) -> np.ndarray:
    """Squared robust scales over all rows; where the MAD is zero, the variance."""
    xs = [F.col("x")[i] for i in range(DIMS)]
    got = rows.agg(*[_median(x) for x in xs], *[F.var_pop(x) for x in xs]).first()
    if got[0] is None:
        return np.ones(DIMS)
    mad = np.array(rows.agg(*[_median(F.abs(x - F.lit(float(m)))) for x, m in zip(xs, got[:DIMS], strict=True)]).first(), float) * 1.4826
    return np.maximum(np.where(mad > 0, mad**2, np.array(got[DIMS:], float)), 1e-12)


def _starts(rows: DataFrame, scratch: Scratch, target: np.ndarray, ridge: float, size: int) -> DataFrame:
    """grp, start, m, c: three first estimates a group, each around the medians."""
    xs = [F.col("x")[i] for i in range(DIMS)]
    med = rows.groupBy("grp").agg(*[_median(x).alias(f"m{i}") for i, x in enumerate(xs)])
    med = scratch.cut(med.select("grp", F.array(*[f"m{i}" for i in range(DIMS)]).alias("m")))
    mad = _beside(rows, med, ["grp"], size).groupBy("grp", "m").agg(*[_median(F.abs(x - F.col("m")[i])).alias(f"s{i}") for i, x in enumerate(xs)])
    floor = [math.sqrt(ridge * v) for v in target]
    mad = scratch.cut(mad.select("grp", "m", F.array(*[F.greatest(F.col(f"s{i}") * 1.4826, F.lit(floor[i])) for i in range(DIMS)]).alias("s")))
    z = [(x - F.col("m")[i]) / F.col("s")[i] for i, x in enumerate(xs)]
    norm = F.sqrt(F.greatest(reduce(lambda a, b: a + b, [v * v for v in z]), F.lit(1e-24)))
    scored = _beside(rows, mad, ["grp"], size).select("grp", "m", "s", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.array(*[F.tanh(v) for v in z]).alias("z")), F.struct(F.lit(2).alias("start"), F.array(*[v / norm for v in z]).alias("z")))).alias("q"))
    sums = scored.groupBy("grp", "m", "s", F.col("q.start").alias("start")).agg(*_sums([F.col("q.z")[i] for i in range(DIMS)]))

    def fn(cols: dict) -> dict:
        out = []
        for start, s, c in zip(cols["start"], cols["s"], cols["c"], strict=True):
            s = np.array(s)
            if start == 0:
                r = np.eye(DIMS)
            elif start == 1:  # correlations of the scores, kept away from the singular
                v = _square(c)
                sd = np.sqrt(np.maximum(np.diag(v), 1e-12))
                r = 0.99 * v / np.outer(sd, sd)
                np.fill_diagonal(r, 1.0)
            else:
                r = 0.99 * DIMS * _square(c) + 0.01 * np.eye(DIMS)
            r = r * np.outer(s, s)
            out.append([float(r[i, j]) for i, j in _pairs()])
        return {k: cols[k] for k in ("grp", "start", "m")} | {"c": out}

    n = F.col("n")
    about_zero = F.array(*[F.col(f"c{i}_{j}") / n for i, j in _pairs()])
    first = mad.select("grp", F.lit(0).alias("start"), "m", "s", F.array(*[F.lit(0.0)] * len(_pairs())).alias("c"))
    both = sums.select("grp", "start", "m", "s", F.when(F.col("start") == 1, _centred()).otherwise(about_zero).alias("c"))
    return arrow_map(first.unionByName(both), fn, "grp string, start int, m array<double>, c array<double>")


def fit_mcd(rows: DataFrame, scratch: Scratch, h: float = 0.75, ridge: float = 0.1, steps: int = 30, tol: float = 1e-3, groups: int | None = None) -> DataFrame:
    """grp, m, p: by group the MCD centre and inverse scatter, made consistent. rows: grp, x (array of DIMS doubles)."""
    xs = [F.col("x")[i] for i in range(DIMS)]
    size = rows.select("grp").distinct().count() if groups is None else groups
    target = pooled_scales(rows)

    z = [x - F.col("m")[i] for i, x in enumerate(xs)]  # centred: no cancellation in the sums
    kept = ["n", *[f"t{i}" for i in range(DIMS)], *[f"c{i}_{j}" for i, j in _pairs()]]

    def concentrate(params: DataFrame) -> DataFrame:
        """One step for each start of each group: sums by group, start and narrow band of the distance, in one pass; the
        nearest bands make up the fraction, the last one by the share of it that is needed."""
        held = params.groupBy("grp").agg(F.collect_list(F.struct("start", "m", "p")).alias("starts"))  # three at most
        near = _beside(rows, held, ["grp"], size).select("grp", "x", F.explode("starts").alias("e")).select("grp", "x", "e.start", "e.m", "e.p")
        band = F.floor(BANDS * F.log2(F.greatest(_distance(z), F.lit(1e-9)))).cast("int")
        bands = near.groupBy("grp", "start", band.alias("band")).agg(F.first("m").alias("m"), *_sums(z))
        own = Window.partitionBy("grp", "start")
        before = F.coalesce(F.sum("n").over(own.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ceil(F.lit(h) * F.sum("n").over(own)) - before) / F.col("n")))
        sums = bands.withColumn("share", share).groupBy("grp", "start").agg(F.first("m").alias("m"), *[F.sum(F.col(c) * F.col("share")).alias(c) for c in kept])
        again = sums.select("grp", "start", F.array(*[F.col("m")[i] + F.col(f"t{i}") / F.col("n") for i in range(DIMS)]).alias("m"), _centred().alias("c"))
        return scratch.cut(_invert(again, target, ridge))

    params = scratch.cut(_invert(_starts(rows, scratch, target, ridge, size), target, 0.0))
    for _ in range(2):
        params = concentrate(params)
    best = params.groupBy("grp").agg(F.min(F.struct("det", "start", "m", "p")).alias("b")).select("grp", "b.start", "b.m", "b.p", "b.det")
    now, done = scratch.cut(best), []
    for _ in range(steps):
        after = concentrate(now)
        fell = after.join(now.select("grp", F.col("det").alias("before")), "grp").withColumn("fell", F.col("before") - F.col("det") > tol)
        done.append(scratch.cut(fell.where(~F.col("fell")).select("grp", "m", "p")))
        now = scratch.cut(fell.where("fell").drop("before", "fell"))  # only these go on
        if now.isEmpty():
            break
    found = reduce(lambda a, b: a.unionByName(b), [*done, now.select("grp", "m", "p")])
    return found.select("grp", "m", F.transform("p", lambda v: v / F.lit(consistency(h))).alias("p"))


def quality_rules(docs: DataFrame, h: float = 0.75, ridge: float = 0.1, level: float = 1e-10, min_rows: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base counts, base_failed, distance2 (squared Mahalanobis distance) and kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    stats = scratch.cut(statistics(docs, id_col, text_col, lang_col, source_col))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed).withColumn("x", F.array(*vector()))
    counts = stats.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("k"))
    by_lang = counts.where(F.col("k") < min_rows).groupBy("lang").agg(F.sum("k").alias("k_lang"))
    sep = F.lit("\x01")
    names = counts.join(by_lang, "lang", "left").select(
        "lang", "source",
        F.when(F.col("k") >= min_rows, F.concat_ws("\x01", F.lit("s"), "lang", "source")).when(F.col("k_lang") >= min_rows, F.concat(F.lit("l"), sep, "lang")).otherwise(F.lit("a")).alias("grp"),
    )
    names = scratch.cut(names)
    size = names.count()  # no fewer than groups
    fit_rows = scratch.cut(_beside(stats.where(~F.col("base_failed")), names, ["lang", "source"], size).select("grp", "x").distinct())
    params = scratch.cut(fit_mcd(fit_rows, scratch, h, ridge, groups=size).join(names, "grp").select("lang", "source", "m", "p"))
    scored = _beside(stats, params, ["lang", "source"], size, "left")
    scored = scored.withColumn("distance2", _distance([F.col("x")[i] - F.col("m")[i] for i in range(DIMS)]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= F.lit(chi2_bound(level)), F.lit(True))
    return scored.withColumn("kept", kept).select("doc_id", *BASE, "base_failed", "kept", "distance2")
