"""Treatment-effect estimators.

Every final estimate is one distributed aggregation over the unit frame (``a``
treatment 0/1, ``y`` outcome, optional nuisance columns); only a handful of
sums reach the driver, and only where a small linear system must be solved.

Nuisances come either from Spark ML models (``operators.nuisance``) or from
*saturated cell means* over discrete strata (this module): the latter are pure
SQL aggregates, cross-fittable by fold with sums and differences, and give the
exact DuckDB oracles of the estimators.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.functions.hashing import poisson1, uniform

Z975 = 1.959963984540054          # standard normal quantile 0.975
CLIP = (0.001, 0.999)             # propensity clipping for weighting estimators (S14)


def _a(a):
    return F.col(a).cast("double")


# ------------------------------------------------------------------ K1-K3

def risk_difference(df: DataFrame, a: str = "a", y: str = "y", z: float = Z975) -> DataFrame:
    """K1: ``p1 - p0`` with a Wald interval."""
    t = (df.groupBy().agg(
        F.sum(_a(a)).alias("n1"), F.sum(1.0 - _a(a)).alias("n0"),
        F.sum(_a(a) * F.col(y)).alias("y1"), F.sum((1.0 - _a(a)) * F.col(y)).alias("y0")))
    p1, p0 = F.try_divide(F.col("y1"), F.col("n1")), F.try_divide(F.col("y0"), F.col("n0"))
    se = F.sqrt(F.try_divide(p1 * (1 - p1), F.col("n1")) + F.try_divide(p0 * (1 - p0), F.col("n0")))
    return t.select(p1.alias("p1"), p0.alias("p0"), F.col("n1").cast("bigint").alias("n1"),
                    F.col("n0").cast("bigint").alias("n0"), (p1 - p0).alias("ATE"),
                    (p1 - p0 - z * se).alias("ATE_lower"), (p1 - p0 + z * se).alias("ATE_upper"))


def frechet_bounds(df: DataFrame, a: str = "a", y: str = "y") -> DataFrame:
    """K2: worst-case bounds ``[P(y,a) - P(y,~a) - P(a), P(y,a) + P(~a) - P(y,~a)]``."""
    t = df.groupBy().agg(F.avg(_a(a) * F.col(y)).alias("pya"), F.avg((1 - _a(a)) * F.col(y)).alias("pyna"),
                         F.avg(_a(a)).alias("pa"))
    lo = F.col("pya") - F.col("pyna") - F.col("pa")
    hi = F.col("pya") + (1 - F.col("pa")) - F.col("pyna")
    return t.select(lo.alias("lower"), hi.alias("upper"), (hi - lo).alias("width"))


def diff_means(df: DataFrame, a: str = "a", y: str = "y", z: float = 1.96, by: Sequence[str] = ()) -> DataFrame:
    """K3 (S15): difference in means; ``se = sqrt(var_pop0/(n0-1) + var_pop1/(n1-1))``.
    ``by`` estimates one row per group in the same aggregation."""
    t = df.groupBy(*by).agg(
        F.avg(F.when(F.col(a) == 1, F.col(y))).alias("m1"), F.avg(F.when(F.col(a) == 0, F.col(y))).alias("m0"),
        F.var_pop(F.when(F.col(a) == 1, F.col(y))).alias("v1"), F.var_pop(F.when(F.col(a) == 0, F.col(y))).alias("v0"),
        F.count_if(F.col(a) == 1).alias("n1"), F.count_if(F.col(a) == 0).alias("n0"))
    ate = F.col("m1") - F.col("m0")
    # undefined (NULL) rather than an error when an arm has fewer than 2 units
    se = F.sqrt(F.try_divide(F.col("v0"), F.col("n0") - 1) + F.try_divide(F.col("v1"), F.col("n1") - 1))
    return t.select(*by, ate.alias("ATE"), se.alias("se"), (ate - z * se).alias("ATE_lower"),
                    (ate + z * se).alias("ATE_upper"))


# ------------------------------------------------------------------ K4-K7

def clip(c, lo: float = CLIP[0], hi: float = CLIP[1]):
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ipw(df: DataFrame, a: str = "a", y: str = "y", e: str = "e", clip_to=CLIP, normalised: bool = False) -> DataFrame:
    """K4 (Horvitz-Thompson) / K5 (normalised, Hajek) inverse-propensity ATE."""
    ec = clip(F.col(e), *clip_to) if clip_to else F.col(e)
    w1, w0 = _a(a) / ec, (1 - _a(a)) / (1 - ec)
    if not normalised:
        return df.groupBy().agg(F.avg(w1 * F.col(y) - w0 * F.col(y)).alias("ATE"))
    t = df.groupBy().agg(F.sum(w1 * F.col(y)).alias("s1"), F.sum(w1).alias("w1"),
                         F.sum(w0 * F.col(y)).alias("s0"), F.sum(w0).alias("w0"))
    return t.select((F.try_divide(F.col("s1"), F.col("w1")) - F.try_divide(F.col("s0"), F.col("w0"))).alias("ATE"))


def g_formula(df: DataFrame, m1: str = "m1", m0: str = "m0") -> DataFrame:
    """K6: ``mean(m1 - m0)``."""
    return df.groupBy().agg(F.avg(F.col(m1) - F.col(m0)).alias("ATE"))


def aipw_pseudo(a: str = "a", y: str = "y", e: str = "e", m1: str = "m1", m0: str = "m0", clip_to=CLIP):
    """K7: per-unit AIPW (doubly robust) pseudo-outcome."""
    ec = clip(F.col(e), *clip_to) if clip_to else F.col(e)
    return (F.col(m1) - F.col(m0) + _a(a) * (F.col(y) - F.col(m1)) / ec
            - (1 - _a(a)) * (F.col(y) - F.col(m0)) / (1 - ec))


def aipw(df: DataFrame, a="a", y="y", e="e", m1="m1", m0="m0", clip_to=CLIP, z: float = 1.96) -> DataFrame:
    """K7: AIPW ATE with the influence-function standard error ``sd/sqrt(n)``."""
    t = df.select(aipw_pseudo(a, y, e, m1, m0, clip_to).alias("_psi")).groupBy().agg(
        F.avg("_psi").alias("ATE"), F.stddev_samp("_psi").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    se = F.col("_sd") / F.sqrt(F.col("_n"))
    return t.select("ATE", se.alias("se"), (F.col("ATE") - z * se).alias("ATE_lower"),
                    (F.col("ATE") + z * se).alias("ATE_upper"))


# ------------------------------------------------------------------ cell means

def cell_nuisances(df: DataFrame, strata: Sequence[str], a: str = "a", y: str = "y") -> DataFrame:
    """Saturated nuisances per stratum: ``e`` = P(a=1|s), ``m1``/``m0`` =
    E[y|a,s] (an empty arm cell falls back to the arm's overall mean) and
    ``m`` = E[y|s].  Aggregated per stratum, then joined back (the strata table
    is small; AQE broadcasts it when it is)."""
    s = list(strata)
    cells = df.groupBy(*s).agg(
        F.avg(_a(a)).alias("e"), F.avg(F.when(F.col(a) == 1, F.col(y))).alias("_m1"),
        F.avg(F.when(F.col(a) == 0, F.col(y))).alias("_m0"), F.avg(F.col(y)).alias("m"))
    overall = df.groupBy().agg(F.avg(F.when(F.col(a) == 1, F.col(y))).alias("_g1"),
                               F.avg(F.when(F.col(a) == 0, F.col(y))).alias("_g0"))
    from trialframe.operators.features import attach_row
    cells = attach_row(cells, overall).select(*s, "e", "m", F.coalesce("_m1", "_g1").alias("m1"),
                                              F.coalesce("_m0", "_g0").alias("m0"))
    return df.join(cells, s)


def crossfit_cell_nuisances(df: DataFrame, strata: Sequence[str], fold: str = "fold",
                            a: str = "a", y: str = "y") -> DataFrame:
    """Out-of-fold saturated nuisances (K9/K10/K19): for a unit in fold k,
    ``e``, ``m1``, ``m0``, ``m`` are cell means over the *other* folds, from
    (stratum, fold) sums minus the unit's own fold.  An empty out-of-fold
    cell falls back to the out-of-fold overall mean.  Everything is sums over
    a table of size strata x folds; no unit-level window.  The input is read
    three times: pass a materialised frame when it is expensive."""
    s = list(strata)
    sums = [F.count(F.lit(1)).alias("n"), F.sum(_a(a)).alias("na"),
            F.sum(F.when(F.col(a) == 1, F.col(y).cast("double")).otherwise(0.0)).alias("y1"),
            F.sum(F.when(F.col(a) == 0, F.col(y).cast("double")).otherwise(0.0)).alias("y0"),
            F.sum(F.col(y).cast("double")).alias("yy")]
    names = ["n", "na", "y1", "y0", "yy"]
    sf = df.groupBy(*s, fold).agg(*sums)
    ws = Window.partitionBy(*s)
    sf = sf.select(*s, fold, *[(F.sum(c).over(ws) - F.col(c)).alias(f"o_{c}") for c in names])
    tf = df.groupBy(fold).agg(*sums)
    wt = Window.partitionBy()          # over the folds table: k rows, not units
    tf = tf.select(fold, *[(F.sum(c).over(wt) - F.col(c)).alias(f"t_{c}") for c in names])

    def ratio(num, den):
        return F.when(F.col(den) > 0, F.col(num) / F.col(den))

    cells = sf.join(F.broadcast(tf), fold).select(
        *s, fold,
        F.coalesce(ratio("o_na", "o_n"), ratio("t_na", "t_n")).alias("e"),
        F.coalesce(F.when(F.col("o_na") > 0, F.col("o_y1") / F.col("o_na")),
                   F.col("t_y1") / F.col("t_na")).alias("m1"),
        F.coalesce(F.when(F.col("o_n") - F.col("o_na") > 0, F.col("o_y0") / (F.col("o_n") - F.col("o_na"))),
                   F.col("t_y0") / (F.col("t_n") - F.col("t_na"))).alias("m0"),
        F.coalesce(ratio("o_yy", "o_n"), ratio("t_yy", "t_n")).alias("m"))
    return df.join(cells, [*s, fold])


# ------------------------------------------------------------------ K10, K13, K15

def dml_ate(df: DataFrame, a: str = "a", y: str = "y", e: str = "e", m: str = "m") -> DataFrame:
    """Partialling-out (R-learner with constant effect):
    ``sum(a~ y~) / sum(a~^2)``, ``a~ = a - e``, ``y~ = y - m`` (no clipping),
    with the heteroscedasticity-robust standard error."""
    r = df.select((_a(a) - F.col(e)).alias("_ar"), (F.col(y) - F.col(m)).alias("_yr"))
    ar, yr = F.col("_ar"), F.col("_yr")
    # One pass: the sandwich's sum(a~^2 (y~ - theta a~)^2) opens into sums that do not need theta.
    t = r.groupBy().agg(F.sum(ar * yr).alias("xy"), F.sum(ar * ar).alias("xx"), F.sum(ar * ar * yr * yr).alias("xxyy"),
                        F.sum(ar * ar * ar * yr).alias("xxxy"), F.sum(ar * ar * ar * ar).alias("xxxx"))
    theta = F.try_divide(F.col("xy"), F.col("xx"))
    meat = F.col("xxyy") - 2 * theta * F.col("xxxy") + theta * theta * F.col("xxxx")
    se = F.try_divide(F.sqrt(F.greatest(meat, F.lit(0.0))), F.col("xx"))
    return t.select(theta.alias("ATE"), se.alias("se"), (theta - 1.96 * se).alias("ATE_lower"),
                    (theta + 1.96 * se).alias("ATE_upper"))


def gram_sums(df: DataFrame, z_cols: Sequence[str], target: str) -> DataFrame:
    """Upper triangle of ``Z'Z`` and ``Z'y`` as one aggregation (one row)."""
    exprs = []
    for i, zi in enumerate(z_cols):
        for zj in z_cols[i:]:
            exprs.append(F.sum(F.col(zi) * F.col(zj)).alias(f"zz_{zi}__{zj}"))
        exprs.append(F.sum(F.col(zi) * F.col(target)).alias(f"zy_{zi}"))
    return df.groupBy().agg(*exprs)


def solve_gram(row, z_cols: Sequence[str], ridge: float = 0.0) -> np.ndarray:
    k = len(z_cols)
    A = np.zeros((k, k))
    b = np.zeros(k)
    for i, zi in enumerate(z_cols):
        b[i] = row[f"zy_{zi}"]
        for j in range(i, k):
            A[i, j] = A[j, i] = row[f"zz_{zi}__{z_cols[j]}"]
    return np.linalg.solve(A + ridge * np.eye(k), b)


def cate_linear(df: DataFrame, x_cols: Sequence[str], a_res: str = "_ar", y_res: str = "_yr",
                intercept: bool = True, ridge: float = 0.0):
    """Linear final stage of the R-learner: minimise
    ``sum (y~ - a~ * theta(x))^2`` with ``theta(x) = b0 + b'x``.  The Gram
    matrix of ``z = a~ * [1, x]`` is one aggregation (k <= ~20 columns); the
    k x k solve is on the driver.  Returns the coefficient vector (names
    ``intercept`` + x_cols)."""
    names = (["intercept"] if intercept else []) + list(x_cols)
    zdf = df.select(F.col(y_res).alias("_t"),
                    *([F.col(a_res).alias("z_intercept")] if intercept else []),
                    *[(F.col(a_res) * F.col(c)).alias(f"z_{c}") for c in x_cols])
    zc = [f"z_{n}" for n in names]
    row = gram_sums(zdf, zc, "_t").first()
    beta = solve_gram(row, zc, ridge)
    return dict(zip(names, beta.tolist()))


def theta_expr(coefs: dict) -> F.Column:
    out = F.lit(float(coefs.get("intercept", 0.0)))
    for k, v in coefs.items():
        if k != "intercept":
            out = out + F.lit(float(v)) * F.col(k)
    return out


def cate_score(df: DataFrame, theta: F.Column, a_res: str = "_ar", y_res: str = "_yr") -> DataFrame:
    """R-loss of a CATE model: ``mean((y~ - theta(x) a~)^2)``."""
    return df.groupBy().agg(F.avg((F.col(y_res) - theta * F.col(a_res)) ** 2).alias("cate_score"))


# ------------------------------------------------------------------ K16

def bootstrap_weights(df: DataFrame, id_col: str, n_boot: int, seed: int = 0) -> DataFrame:
    """Poisson(1) bootstrap weights, one row per (unit, replicate b).

    Each unit row is expanded to its ``n_boot`` replicates by ``explode`` of a
    bounded sequence (no join) with weight ``Poisson1(md5(id|seed|b))``; the
    draw is a function of the identity, so a recomputed task draws the same
    weights.  Rows of weight 0 are dropped before any aggregation.
    """
    ex = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    w = poisson1(uniform(F.col(id_col), F.lit(seed), F.col("b")))
    return ex.withColumn("w", w).filter(F.col("w") > 0)


def bootstrap_ci(df: DataFrame, id_col: str, n_boot: int = 50, seed: int = 0, stat: str = "diff_means",
                 a: str = "a", y: str = "y", alpha: float = 0.05, pseudo: str | None = None) -> DataFrame:
    """Percentile bootstrap interval of a closed-form statistic with fixed
    nuisances (``diff_means``, or the mean of a pseudo-outcome column such as
    AIPW's).  One job: per replicate, weighted sums (partial aggregation, B
    output rows), then the percentile over the B replicate values."""
    w = bootstrap_weights(df, id_col, n_boot, seed)
    wd = F.col("w").cast("double")
    if stat == "diff_means":
        reps = w.groupBy("b").agg(
            (F.try_divide(F.sum(wd * _a(a) * F.col(y)), F.sum(wd * _a(a)))
             - F.try_divide(F.sum(wd * (1 - _a(a)) * F.col(y)), F.sum(wd * (1 - _a(a))))).alias("stat"))
    elif stat == "mean":
        reps = w.groupBy("b").agg(F.try_divide(F.sum(wd * F.col(pseudo)), F.sum(wd)).alias("stat"))
    else:
        raise ValueError(f"unknown bootstrap statistic {stat!r}")
    return reps.groupBy().agg(
        F.avg("stat").alias("boot_mean"), F.percentile("stat", alpha / 2).alias("ATE_lower"),
        F.percentile("stat", 1 - alpha / 2).alias("ATE_upper"), F.count(F.lit(1)).alias("n_boot"))


def bootstrap_aipw_cells(df: DataFrame, strata: Sequence[str], id_col: str, n_boot: int = 50, seed: int = 0,
                        a: str = "a", y: str = "y", alpha: float = 0.05, clip_to=CLIP) -> DataFrame:
    """K16 with refitting: percentile interval of the cell-mean AIPW where
    every replicate re-estimates its own nuisances (propensity and arm means
    per stratum) from the Poisson-weighted sample.

    Per stratum s of replicate b the AIPW sum is
    ``W (m1 - m0) + (S_ay - m1 S_a) / e - (S_cy - m0 S_c) / (1 - e)`` with
    ``e = S_a / W`` (clipped), ``m1 = S_ay / S_a``, ``m0 = S_cy / S_c`` (empty
    arm -> the replicate's overall arm mean), so every replicate comes from
    the weighted (b, stratum) sums: one pass with partial aggregation, no
    join back to the units, B x strata rows after the shuffle."""
    s = list(strata)
    w = bootstrap_weights(df, id_col, n_boot, seed)
    wd, av, yv = F.col("w").cast("double"), _a(a), F.col(y).cast("double")
    cs = w.groupBy("b", *s).agg(F.sum(wd).alias("W"), F.sum(wd * av).alias("SA"), F.sum(wd * av * yv).alias("SAY"),
                                F.sum(wd * (1 - av)).alias("SC"), F.sum(wd * (1 - av) * yv).alias("SCY"))
    g = cs.groupBy("b").agg(F.sum("W").alias("N"), F.try_divide(F.sum("SAY"), F.sum("SA")).alias("g1"),
                            F.try_divide(F.sum("SCY"), F.sum("SC")).alias("g0"))
    j = cs.join(F.broadcast(g), "b")                                   # g: B rows
    e = clip(F.col("SA") / F.col("W"), *clip_to) if clip_to else F.col("SA") / F.col("W")
    m1 = F.coalesce(F.when(F.col("SA") > 0, F.col("SAY") / F.col("SA")), F.col("g1"))
    m0 = F.coalesce(F.when(F.col("SC") > 0, F.col("SCY") / F.col("SC")), F.col("g0"))
    contrib = (F.col("W") * (m1 - m0) + (F.col("SAY") - m1 * F.col("SA")) / e
               - (F.col("SCY") - m0 * F.col("SC")) / (1 - e))
    reps = j.groupBy("b").agg((F.sum(contrib) / F.first("N")).alias("stat"))
    return reps.groupBy().agg(
        F.avg("stat").alias("boot_mean"), F.percentile("stat", alpha / 2).alias("ATE_lower"),
        F.percentile("stat", 1 - alpha / 2).alias("ATE_upper"), F.count(F.lit(1)).alias("n_boot"))


# ------------------------------------------------------------------ K22

def trial_benchmark(spark, n1_events: int, n1: int, n0_events: int, n0: int, label: str = "trial",
                    z: float = 1.96) -> DataFrame:
    """Reference-trial risk difference from four counts with its Wald
    interval (the full binomial variance, including the ``1 - p`` factor)."""
    p1, p0 = n1_events / n1, n0_events / n0
    se = math.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    ate = p1 - p0
    return spark.createDataFrame([(label, ate, ate - z * se, ate + z * se)],
                                 "estimation_method string, ATE double, ATE_lower double, ATE_upper double")
