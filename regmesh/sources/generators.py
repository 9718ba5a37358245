"""Data generators: structure of the usual test frames, drawn in parallel from seeded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _uniform(seed: int, *keys) -> Column:
    """A uniform draw that depends on the keys and the seed alone, so that a recomputed task draws the same."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / F.lit(float(1 << 53))


def _normal(seed: int, *keys) -> Column:
    """Box and Muller's normal draw."""
    return F.sqrt(-2.0 * F.ln(_uniform(seed, *keys))) * F.cos(6.283185307179586 * _uniform(seed + 7919, *keys))


def _level(seed: int, n: int, *keys) -> Column:
    return F.floor(_uniform(seed, *keys) * n)


def get_data(spark: SparkSession, N: int = 1000, seed: int = 1234, model: str = "Feols") -> DataFrame:
    """Core frame: Y, Y2, X1, X2, f1-f3, group_id, Z1, Z2, weights, with a few nulls; counts for model='Fepois'."""
    i = F.col("id")
    levels = max(2, int(N**0.5))
    df = spark.range(N).select("id", _level(seed, 3, i).cast("double").alias("X1"), (3.0 * _normal(seed + 1, i)).alias("X2"), *[_level(seed + 2 + k, levels, i).cast("double").alias(f"f{k + 1}") for k in range(3)], _level(seed + 6, 19, i).cast("double").alias("group_id"))
    effects = sum((_normal(seed + 10 + k, F.col(f"f{k + 1}")) for k in range(3)), F.lit(0.0))
    eta = 1.0 + 0.5 * F.col("X1") - 0.3 * F.col("X2") + effects
    if model == "Fepois":
        mean = F.exp(F.least(F.greatest(eta * 0.3, F.lit(-5.0)), F.lit(3.0)))
        draw = F.floor(F.greatest(mean + F.sqrt(mean) * _normal(seed + 20, i) + 0.5, F.lit(0.0)))
        df = df.withColumn("Y", draw.cast("double")).withColumn("Y2", F.floor(F.greatest(mean + F.sqrt(mean) * _normal(seed + 21, i) + 0.5, F.lit(0.0))).cast("double"))
    else:
        df = df.withColumn("Y", eta + _normal(seed + 20, i)).withColumn("Y2", F.col("Y") + 5.0 * _normal(seed + 21, i))
    df = df.withColumn("Z1", F.col("X1") + _normal(seed + 22, i)).withColumn("Z2", F.col("X2") + _normal(seed + 23, i)).withColumn("weights", _uniform(seed + 24, i))
    hole = lambda c, at: F.when(i != at, F.col(c)).alias(c)
    return df.select(hole("Y", 0), "Y2", hole("X1", 1), "X2", hole("f1", 2), "f2", "f3", "group_id", "Z1", "Z2", "weights")


def get_ivf_data(spark: SparkSession, N: int = 2000, seed: int = 1234) -> DataFrame:
    """earnings, num_children, ivf_success; the effect of a child is -0.15."""
    i = F.col("id")
    df = spark.range(N).select("id", _normal(seed, i).alias("u"), (_uniform(seed + 1, i) < 0.5).cast("int").alias("ivf_success"))
    df = df.withColumn("num_children", F.greatest(F.lit(0.0), F.round(0.5 + 0.8 * F.col("ivf_success") - 0.4 * F.col("u") + 0.7 * _normal(seed + 2, i))))
    return df.select((10.0 - 0.15 * F.col("num_children") + 0.5 * F.col("u") + 0.3 * _normal(seed + 3, i)).alias("earnings"), "num_children", "ivf_success")


def get_bartik_data(spark: SparkSession, N: int = 300, seed: int = 1234) -> DataFrame:
    """wages, immigration, log_population, bartik_instrument; the effect of immigration is -0.3."""
    i = F.col("id")
    df = spark.range(N).select("id", _normal(seed, i).alias("bartik_instrument"), (12.0 + _normal(seed + 1, i)).alias("log_population"), _normal(seed + 2, i).alias("u"))
    df = df.withColumn("immigration", 0.9 * F.col("bartik_instrument") + 0.1 * F.col("log_population") + 0.5 * F.col("u") + 0.5 * _normal(seed + 3, i))
    return df.select((2.0 - 0.3 * F.col("immigration") + 0.2 * F.col("log_population") + 0.6 * F.col("u") + 0.3 * _normal(seed + 4, i)).alias("wages"), "immigration", "log_population", "bartik_instrument")


def get_encouragement_data(spark: SparkSession, N: int = 4000, seed: int = 1234) -> DataFrame:
    """revenue, assigned_treatment, adopted_feature, user_type; the local effect is 2.0."""
    i = F.col("id")
    df = spark.range(N).select("id", (_uniform(seed, i) < 0.5).cast("int").alias("assigned_treatment"), _level(seed + 1, 3, i).cast("int").alias("user_type"), _normal(seed + 2, i).alias("u"))
    df = df.withColumn("adopted_feature", ((F.col("u") + 1.2 * F.col("assigned_treatment") - 0.6) > 0).cast("int"))
    return df.select((10.0 + 2.0 * F.col("adopted_feature") + 0.5 * F.col("user_type") + 0.8 * F.col("u") + _normal(seed + 3, i)).alias("revenue"), "assigned_treatment", "adopted_feature", "user_type")


def _panel(spark: SparkSession, units: int, periods: int, first: int = 1) -> DataFrame:
    return spark.range(units * periods).select(F.floor(F.col("id") / periods).cast("int").alias("unit"), (F.col("id") % periods + first).cast("int").alias("year"))


def _ar1(seed: int, rho: float) -> Column:
    """An autoregressive error by unit, as the discounted sum of its shocks."""
    w = Window.partitionBy("unit").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    shock = _normal(seed, F.col("unit"), F.col("year"))
    return F.sum(shock * F.pow(F.lit(rho), -F.col("year"))).over(w) * F.pow(F.lit(rho), F.col("year"))


def get_panel_dgp_stagg(spark: SparkSession, num_units: int = 1000, num_periods: int = 30, cohorts: tuple[int, ...] = (10, 15, 20), share: float = 0.6, effect: float = 0.5, seed: int = 42, rho: float = 0.6) -> DataFrame:
    """unit_id, time_id, W_it, g, Y_it with unit and time intercepts; staggered adoption, g = 0 for never treated."""
    u, t = F.col("unit"), F.col("year")
    df = _panel(spark, num_units, num_periods)
    pick = F.floor(_uniform(seed, u) / share * len(cohorts))
    g = F.lit(0)
    for k, c in enumerate(cohorts):
        g = F.when(pick == k, F.lit(c)).otherwise(g)
    df = df.withColumn("g", g).withColumn("W_it", ((F.col("g") > 0) & (t >= F.col("g"))).cast("int"))
    df = df.withColumn("unit_intercept", _normal(seed + 1, u)).withColumn("time_intercept", 0.3 * _normal(seed + 2, t))
    y = F.col("unit_intercept") + F.col("time_intercept") + F.col("W_it") * effect * (1 + 0.1 * (t - F.col("g"))) + 0.5 * _ar1(seed + 3, rho)
    return df.select(u.alias("unit_id"), t.alias("time_id"), "W_it", "g", y.alias("Y_it"), "unit_intercept", "time_intercept")


def get_sharkfin(spark: SparkSession, num_units: int = 1000, num_periods: int = 30, num_treated: int = 200, treatment_start: int = 15, seed: int = 1234) -> DataFrame:
    """unit, year, treat, Y, ever_treated: one adoption date, an effect that rises and fades."""
    u, t = F.col("unit"), F.col("year")
    df = _panel(spark, num_units, num_periods, 0).withColumn("ever_treated", (u < num_treated).cast("int"))
    df = df.withColumn("treat", ((F.col("ever_treated") == 1) & (t >= treatment_start)).cast("int"))
    since = t - F.lit(treatment_start - 1)
    y = _normal(seed, u) + 0.2 * _normal(seed + 1, t) + F.col("treat") * 0.2 * F.log1p(F.greatest(since, F.lit(0)).cast("double")) + 0.3 * _ar1(seed + 2, 0.7)
    return df.select("unit", "year", "treat", y.alias("Y"), "ever_treated")


def get_blw(spark: SparkSession, seed: int = 55) -> DataFrame:
    """Thousand units over thirty years in forty states; treatment dates by state group, effects that differ and grow."""
    u, t = F.col("unit"), F.col("year")
    df = _panel(spark, 1000, 30, 1980).withColumn("state", (u % 40).cast("int"))
    df = df.withColumn("group", F.floor(F.col("state") / 10).cast("int") + 1).withColumn("treat_date", (1980 + 6 * F.col("group")).cast("int"))
    df = df.withColumn("time_til", t - F.col("treat_date")).withColumn("treat", t >= F.col("treat_date"))
    df = df.withColumn("firms", F.round(5 * _uniform(seed, u))).withColumn("e", 0.5 * _normal(seed + 1, u, t)).withColumn("te", 0.5 * F.col("group") + 0.3 * _normal(seed + 2, u))
    y = F.col("firms") + 0.1 * (t - 1980) + F.col("treat").cast("int") * F.col("te") + F.col("e")
    y2 = F.col("firms") + 0.1 * (t - 1980) + F.col("treat").cast("int") * F.col("te") * (F.col("time_til") + 1) * 0.2 + F.col("e")
    return df.select((u + 1).alias("n"), (u + 1).alias("id"), "year", "state", "group", "treat_date", "time_til", "treat", "firms", "e", "te", y.alias("y"), y2.alias("y2"))


def get_twin_data(spark: SparkSession, N_pairs: int = 500, seed: int = 42) -> DataFrame:
    """Two twins a pair that share ability; the return to a year of schooling is 0.08."""
    p, k = F.col("twin_pair_id"), F.col("twin_id")
    df = spark.range(2 * N_pairs).select(F.floor(F.col("id") / 2).cast("int").alias("twin_pair_id"), (F.col("id") % 2 + 1).cast("int").alias("twin_id"))
    df = df.withColumn("ability", _normal(seed, p)).withColumn("age", 30 + _level(seed + 1, 25, p).cast("double"))
    df = df.withColumn("educ", F.round(13 + 1.5 * F.col("ability") + 1.2 * _normal(seed + 2, p, k))).withColumn("experience", F.greatest(F.lit(0.0), F.col("age") - F.col("educ") - 6))
    return df.withColumn("log_wage", 1.0 + 0.08 * F.col("educ") + 0.02 * F.col("experience") + 0.3 * F.col("ability") + 0.2 * _normal(seed + 3, p, k))


def get_worker_panel(spark: SparkSession, N_workers: int = 500, N_firms: int = 50, N_years: int = 11, seed: int = 42) -> DataFrame:
    """worker_id, firm_id, year, log_wage with worker and firm effects, experience and tenure."""
    w, t = F.col("unit"), F.col("year")
    df = _panel(spark, N_workers, N_years, 2000).withColumn("spell", F.floor((t - 2000 + _level(seed + 9, 4, w)) / 4).cast("int"))
    df = df.withColumn("firm_id", _level(seed, N_firms, w, F.col("spell")).cast("int")).withColumn("female", (_uniform(seed + 1, w) < 0.5).cast("int"))
    df = df.withColumn("experience", (t - 2000 + _level(seed + 2, 20, w)).cast("int")).withColumn("tenure", (F.row_number().over(Window.partitionBy("unit", "spell").orderBy("year")) - 1).cast("int"))
    df = df.withColumn("worker_fe", 0.4 * _normal(seed + 3, w)).withColumn("firm_fe", 0.3 * _normal(seed + 4, F.col("firm_id")))
    y = 2.0 + F.col("worker_fe") + F.col("firm_fe") + 0.02 * F.col("experience") + 0.01 * F.col("tenure") - 0.1 * F.col("female") + 0.2 * _normal(seed + 5, w, t)
    return df.select(w.alias("worker_id"), "firm_id", "year", "female", "experience", "tenure", y.alias("log_wage"), "worker_fe", "firm_fe")


def get_motherhood_event_study_data(spark: SparkSession, n_countries: int = 6, n_units: int = 280, n_years: int = 21, seed: int = 7) -> DataFrame:
    """unit, year, country, region, g, treat, rel_year (-999 never), log_earnings with a penalty from the birth year on."""
    u, t = F.col("unit"), F.col("year")
    df = _panel(spark, n_countries * n_units, n_years, 1995).withColumn("country", F.concat(F.lit("country_"), (u % n_countries).cast("string")))
    df = df.withColumn("region", F.concat(F.lit("region_"), (u % n_countries % 2).cast("string"))).withColumn("g", F.when(_uniform(seed, u) < 0.75, (2000 + _level(seed + 1, 10, u)).cast("int")).otherwise(0))
    df = df.withColumn("treat", ((F.col("g") > 0) & (t >= F.col("g"))).cast("int")).withColumn("rel_year", F.when(F.col("g") > 0, t - F.col("g")).otherwise(-999))
    y = 10 + 0.5 * _normal(seed + 2, u) + 0.02 * (t - 1995) - F.col("treat") * (0.2 + 0.05 * (u % n_countries)) + 0.2 * _normal(seed + 3, u, t)
    return df.withColumn("log_earnings", y)


def gelbach_data(spark: SparkSession, nobs: int = 500, seed: int = 49) -> DataFrame:
    """x1, x21, x22, x23, y for decompositions."""
    i = F.col("id")
    df = spark.range(nobs).select("id", _normal(seed, i).alias("x1"))
    df = df.withColumn("x21", F.col("x1") + _normal(seed + 1, i)).withColumn("x22", 0.25 * F.col("x1") + 0.75 * _normal(seed + 2, i)).withColumn("x23", 0.4 * F.col("x1") + 0.6 * F.col("x21") + _normal(seed + 3, i))
    return df.select("x1", "x21", "x22", "x23", (F.col("x1") + F.col("x21") + F.col("x22") + 0.2 * F.col("x23") + _normal(seed + 4, i)).alias("y"))


def base_dgp(spark: SparkSession, n: int = 1000, nb_year: int = 10, nb_indiv_per_firm: int = 23, kind: str = "simple", seed: int = 0) -> DataFrame:
    """The benchmark panel: indiv_id, firm_id, year, x1-x10, y, exp_y, negbin_y, binary_y; kind 'difficult' ties firms to rows."""
    i = F.col("id")
    indiv = max(1, round(n / nb_year))
    firms = max(1, round(indiv / nb_indiv_per_firm))
    df = spark.range(n).select("id", F.floor(i / nb_year).alias("indiv_id"), (i % nb_year).cast("int").alias("year"), (_level(seed, firms, i) if kind == "simple" else i % firms).alias("firm_id"))
    df = df.select("*", *[_normal(seed + 30 + k, i).alias(f"x{k}") for k in range(1, 11)])
    mu = F.col("x1") + 0.05 * F.col("x2") + _normal(seed + 1, F.col("indiv_id")) + _normal(seed + 2, F.col("firm_id")) + _normal(seed + 3, F.col("year"))
    df = df.withColumn("y", mu + _normal(seed + 4, i))
    return df.withColumn("exp_y", F.exp("y")).withColumn("negbin_y", F.floor(F.exp(F.least("y", F.lit(10.0)))).cast("int")).withColumn("binary_y", (F.col("y") > 0).cast("int")).drop("id")


def akm_panel(spark: SparkSession, n_workers: int = 1000, n_firms: int = 100, n_years: int = 10, move: float = 0.2, seed: int = 1) -> DataFrame:
    """Workers who move between firms with some probability a year: indiv_id, firm_id, year, x1, y."""
    w, t = F.col("unit"), F.col("year")
    df = _panel(spark, n_workers, n_years)
    moves = F.sum((_uniform(seed, w, t) < move).cast("int")).over(Window.partitionBy("unit").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("firm_id", _level(seed + 1, n_firms, w, moves).cast("int")).withColumn("x1", _normal(seed + 2, w, t))
    y = F.col("x1") + _normal(seed + 3, w) + _normal(seed + 4, F.col("firm_id")) + 0.1 * t + _normal(seed + 5, w, t)
    return df.select(w.alias("indiv_id"), "firm_id", t.alias("year"), "x1", y.alias("y"))
