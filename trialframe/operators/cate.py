"""Effect models fitted on some units and applied to others.

A final model regresses a target on ``z``: the R-learner has ``z = a~ [1, x]`` and the target ``y~``, the
DR learner ``z = [1, x]`` and the pseudo-outcome.  Either needs one aggregation for the Gram matrix, and
one for the sandwich of the interval; only k x k sums reach the driver.  A fitted model is a few numbers
(or Spark ML trees) and is applied to any frame by column expressions.

Rows with a null in the target or in a covariate take no part in a fit; a unit with a null covariate gets
a null effect.  A constant or repeated covariate gets the least-norm solution.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from typing import Sequence

import numpy as np
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.functions.stats import t_quantile
from trialframe.operators import nuisance as NU
from trialframe.operators import stacked
from trialframe.operators.effects import CLIP, clip
from trialframe.operators.features import attach_row

SUMS = ["n", "na", "y1", "y0", "yy"]


# ------------------------------------------------------------------ linear final models

def _inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a positive semi-definite matrix, by its columns' own scales."""
    d = np.sqrt(np.diag(m))
    d = np.where(d > 0, d, 1.0)
    return np.linalg.pinv(m / np.outer(d, d), rcond=1e-10, hermitian=True) / np.outer(d, d)


def design(x_cols: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c).cast("double") for c in x_cols]]


def _dot(beta: Sequence[float], z: Sequence[Column]) -> Column:
    out = F.lit(float(beta[0])) * z[0]
    for b, c in zip(beta[1:], z[1:]):
        out = out + F.lit(float(b)) * c
    return out


@dataclass(frozen=True)
class EffectModel:
    """Coefficients of ``[1, x]`` with their covariance."""
    x_cols: tuple
    coefs: np.ndarray
    cov: np.ndarray

    def effect(self) -> Column:
        return _dot(self.coefs, design(self.x_cols))

    def apply(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """Adds ``cate`` and its normal interval ``cate_lb``, ``cate_ub`` at level ``alpha``."""
        z = design(self.x_cols)
        var = sum((_dot(row, z) * zi for row, zi in zip(self.cov[1:], z[1:])), _dot(self.cov[0], z) * z[0])
        half = F.lit(NormalDist().inv_cdf(1 - alpha / 2)) * F.sqrt(F.greatest(var, F.lit(0.0)))
        return df.withColumns({"cate": self.effect(), "cate_lb": self.effect() - half, "cate_ub": self.effect() + half})


def fit_final(df: DataFrame, z: Sequence[Column], target: Column, x_cols: Sequence[str], penalty: float = 0.0) -> EffectModel:
    """Minimise ``sum (target - z'b)^2 + penalty |b|^2`` (intercept unpenalised), with the
    heteroscedasticity-robust covariance ``G^-1 (sum z z' r^2) G^-1``.  Reads the frame twice."""
    d = len(z)
    rows = df.select(*[c.cast("double").alias(f"z{i}") for i, c in enumerate(z)], target.cast("double").alias("t")).dropna()
    zc, t = [F.col(f"z{i}") for i in range(d)], F.col("t")
    r = rows.groupBy().agg(F.count(F.lit(1)).alias("n"), *stacked._sums(zc, F.lit(1.0), "g"),
                           *[F.sum(c * t).alias(f"t_{i}") for i, c in enumerate(zc)]).first()
    if not r["n"]:
        raise ValueError("no unit without nulls to fit the effect model on")
    inv = _inverse(stacked._matrix(r, d, "g") + penalty * np.diag([0.0] + [1.0] * (d - 1)))
    beta = inv @ np.array([r[f"t_{i}"] for i in range(d)])
    res = t - _dot(beta, zc)
    m = rows.groupBy().agg(*stacked._sums(zc, res * res, "m")).first()
    return EffectModel(tuple(x_cols), beta, inv @ stacked._matrix(m, d, "m") @ inv)


def fit_r_final(res: DataFrame, x_cols: Sequence[str], a_res: str = "_ar", y_res: str = "_yr",
                penalty: float = 0.0) -> EffectModel:
    """Linear (``penalty`` 0) or ridge final model of the R-learner on residuals."""
    return fit_final(res, [F.col(a_res) * c for c in design(x_cols)], F.col(y_res), x_cols, penalty)


def fit_dr_final(df: DataFrame, pseudo: Column, x_cols: Sequence[str], penalty: float = 0.0) -> EffectModel:
    """K9: regression of cross-fitted pseudo-outcomes on the effect covariates."""
    return fit_final(df, design(x_cols), pseudo, x_cols, penalty)


# ------------------------------------------------------------------ forest final model

@dataclass(frozen=True)
class EffectForest:
    """R-loss forests of disjoint hash groups of the units."""
    x_cols: tuple
    models: tuple

    def apply(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """Adds the mean effect of the groups' forests and Student's interval of that mean.
        Units with a null covariate get nulls."""
        g = len(self.models)
        whole = F.lit(True)
        for c in self.x_cols:
            whole = whole & F.col(c).isNotNull()
        out = NU.assemble(df, self.x_cols, "_features")
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumnRenamed("prediction", f"_g{i}")
        cols = [F.col(f"_g{i}") for i in range(g)]
        mean = sum(cols[1:], cols[0]) / g
        dev = [(c - mean) * (c - mean) for c in cols]
        half = t_quantile(1 - alpha / 2, g - 1) * F.sqrt(sum(dev[1:], dev[0]) / ((g - 1) * g))
        return out.select(*df.columns, *[F.when(whole, c).alias(n) for n, c in
                                         (("cate", mean), ("cate_lb", mean - half), ("cate_ub", mean + half))])


def fit_r_forest(res: DataFrame, x_cols: Sequence[str], id_col: str, a_res: str = "_ar", y_res: str = "_yr",
                 n_groups: int = 8, n_trees: int = 25, max_depth: int = 5, seed: int = 42) -> EffectForest:
    """Forest final model of the R-learner (a weighted regression of ``y~ / a~`` with weight ``a~^2``),
    one forest for each disjoint group of units."""
    ar = F.col(a_res)
    z = (res.select(*x_cols, (F.col(y_res) / ar).alias("_pseudo"), (ar * ar).alias("_w"),
                    F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_groups)).alias("_g"))
            .filter(F.col("_w") > 0).dropna())
    z = NU.assemble(z, x_cols, "_features").persist()
    try:
        rf = RandomForestRegressor(featuresCol="_features", labelCol="_pseudo", weightCol="_w", numTrees=n_trees,
                                   maxDepth=max_depth, seed=seed)
        return EffectForest(tuple(x_cols), tuple(rf.fit(z.filter(F.col("_g") == g)) for g in range(n_groups)))
    finally:
        z.unpersist()


# ------------------------------------------------------------------ fold models on other units

def _sum_cols(a: str, y: str) -> list[Column]:
    av, yv = F.col(a).cast("double"), F.col(y).cast("double")
    return [F.count(F.lit(1)).cast("double").alias("n"), F.sum(av).alias("na"), F.sum(av * yv).alias("y1"),
            F.sum((1 - av) * yv).alias("y0"), F.sum(yv).alias("yy")]


def _means(n, na, y1, y0, yy) -> dict[str, Column]:
    return {"e": F.try_divide(na, n), "m1": F.try_divide(y1, na), "m0": F.try_divide(y0, n - na), "m": F.try_divide(yy, n)}


def fold_cell_models(df: DataFrame, strata: Sequence[str], k: int, fold: str = "fold", a: str = "a",
                     y: str = "y") -> tuple[DataFrame, DataFrame]:
    """The k cell-mean models that cross-fitting fits (each on the other folds), kept as tables:
    ``strata, fold, e, m1, m0, m`` for every stratum and fold, and ``fold, e, m1, m0, m`` over all strata,
    which stands in for a cell that a model has not seen.  One pass over the units."""
    s = list(strata)
    from trialframe.session import cut_lineage
    own = cut_lineage(df.groupBy(*s, fold).agg(*_sum_cols(a, y)))
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold)

    def others(keys):
        total = own.groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])
        mine = own.groupBy(*keys, fold).agg(*[F.sum(c).alias(c) for c in SUMS])
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*keys, fold]]
        j = total.select(*keys, every, *[f"t_{c}" for c in SUMS]).alias("l").join(mine.alias("r"), on, "left")
        left = [F.col(f"t_{c}") - F.coalesce(F.col(f"r.{c}"), F.lit(0.0)) for c in SUMS]
        return j.select(*[F.col(f"l.{c}").alias(c) for c in [*keys, fold]], *[c.alias(n) for n, c in _means(*left).items()])

    overall = others([])
    back = overall.select(fold, *[F.col(c).alias(f"o_{c}") for c in ("e", "m1", "m0", "m")])
    cells = others(s).join(F.broadcast(back), fold)                      # k rows
    return cells.select(*s, fold, *[F.coalesce(c, f"o_{c}").alias(c) for c in ("e", "m1", "m0", "m")]), overall


def average_cell_models(new: DataFrame, models: tuple[DataFrame, DataFrame], strata: Sequence[str]) -> DataFrame:
    """``new`` with the mean prediction of the fold models for its units, which belong to no fold;
    a unit of an unseen stratum gets the mean over all strata."""
    cells, overall = models
    names = ("e", "m1", "m0", "m")
    mean = cells.groupBy(*strata).agg(*[F.avg(c).alias(f"_{c}") for c in names])
    back = overall.groupBy().agg(*[F.avg(c).alias(f"_o_{c}") for c in names])
    on = [F.col(f"u.{c}").eqNullSafe(F.col(f"c.{c}")) for c in strata]
    j = attach_row(new.alias("u").join(mean.alias("c"), on, "left").select("u.*", *[f"_{c}" for c in names]), back)
    return j.select(*new.columns, *[F.coalesce(f"_{c}", f"_o_{c}").alias(c) for c in names])


@dataclass(frozen=True)
class FoldEnsemble:
    """Spark ML models of the folds, kept to predict units that belong to no fold."""
    task: str
    models: tuple

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Adds ``out``, the mean prediction of the models."""
        cols = []
        frame = df
        for i, m in enumerate(self.models):
            frame = NU.predict(m, frame, self.task, f"_p{i}")
            cols.append(F.col(f"_p{i}"))
        return frame.select(*df.columns, (sum(cols[1:], cols[0]) / len(cols)).alias(out))


def fit_folds(df: DataFrame, fold: str, k: int, kind: str, task: str, label: str, params=None,
              train_filter=None) -> FoldEnsemble:
    """One model for each fold, fitted on the other folds of an assembled frame."""
    models = []
    for j in range(k):
        train = df.filter(F.col(fold) != j)
        train = train if train_filter is None else train.filter(train_filter)
        n, sd = NU.label_stats(train, label) if kind == "linear" else (None, None)
        models.append(NU.fit(NU.make_model(kind, task, label, n, sd, params, None), train))
    return FoldEnsemble(task, tuple(models))


# ------------------------------------------------------------------ refitting replicates

@dataclass(frozen=True)
class RefittedModel:
    """K9: coefficients of ``[1, x]`` on all units and those of every bootstrap replicate."""
    x_cols: tuple
    coefs: np.ndarray
    replicates: np.ndarray

    def table(self, spark, alpha: float = 0.05) -> DataFrame:
        """``term, coef, lower, upper``: percentile intervals of the replicates."""
        lo, hi = np.quantile(self.replicates, [alpha / 2, 1 - alpha / 2], axis=0)
        rows = [(t, float(c), float(x), float(y)) for t, c, x, y in
                zip(("intercept", *self.x_cols), self.coefs, lo, hi)]
        return spark.createDataFrame(rows, "term string, coef double, lower double, upper double")

    def apply(self, df: DataFrame, alpha: float = 0.1) -> DataFrame:
        """Adds ``cate`` and the percentile interval of the replicates' effects, inside each row."""
        z = design(self.x_cols)
        known = F.lit(True)
        for c in z[1:]:
            known = known & c.isNotNull()
        betas = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in self.replicates])

        def theta(b):
            return sum((b[i] * c for i, c in enumerate(z[1:], 1)), b[0] * z[0])

        ordered, last = F.array_sort(F.transform(betas, theta)), len(self.replicates) - 1

        def at(q):
            lo = int(np.floor(q * last))
            x, y = F.element_at(ordered, lo + 1), F.element_at(ordered, min(lo + 1, last) + 1)
            return F.when(known, x + F.lit(q * last - lo) * (y - x))

        return df.withColumns({"cate": _dot(self.coefs, z), "cate_lb": at(alpha / 2), "cate_ub": at(1 - alpha / 2)})


def dr_final_cells(df: DataFrame, strata: Sequence[str], x_cols: Sequence[str], id_col: str, fold: str = "fold",
                   n_boot: int = 50, seed: int = 0, a: str = "a", y: str = "y", clip_to=CLIP) -> RefittedModel:
    """K9: final model of the DR learner on ``x_cols`` with an interval that refits everything: each
    Poisson replicate has its own cross-fitted cell nuisances, pseudo-outcomes and regression.  A unit
    keeps its fold in every replicate.

    Within a (replicate, stratum, fold) the nuisances are constant and the pseudo-outcome is linear in
    ``a`` and ``a y``, so ``sum w z psi`` opens into sums of ``w z``, ``w a z``, ``w a y z`` and
    ``w (1-a) y z``: one aggregation of the units serves all replicates, whatever the covariates are.
    Units with a null among the columns read are left out."""
    s, z = list(strata), design(x_cols)
    d = len(z)
    u = df.select(F.col(id_col).alias("id"), *s, F.col(fold).alias("_fold"), F.col(a).cast("double").alias("_a"),
                  F.col(y).cast("double").alias("_y"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    u = u.dropna(subset=["id", "_fold", "_a", "_y", *[f"_z{i}" for i in range(d)]])
    w, av, yv, zc = F.col("w"), F.col("_a"), F.col("_y"), [F.col(f"_z{i}") for i in range(d)]
    sums = {"n": w, "na": w * av, "y1": w * av * yv, "y0": w * (1 - av) * yv, "yy": w * yv}
    for i, c in enumerate(zc):
        sums |= {f"p_{i}": w * c, f"pa_{i}": w * av * c, f"py_{i}": w * av * yv * c, f"pc_{i}": w * (1 - av) * yv * c}
    cells = (stacked.replicates(u, n_boot, seed).groupBy("b", *s, "_fold")
             .agg(*[F.sum(c).alias(name) for name, c in sums.items()], *stacked._sums(zc, w, "g")))
    in_cell, in_rep = Window.partitionBy("b", *s), Window.partitionBy("b")
    # Two steps of windows over tables of strata x folds and of folds, for each replicate.
    folds = cells.groupBy("b", "_fold").agg(*[F.sum(c).alias(f"f_{c}") for c in SUMS])
    folds = folds.select("b", "_fold", *[c.alias(f"t_{n}") for n, c in _means(
        *[F.sum(f"f_{c}").over(in_rep) - F.col(f"f_{c}") for c in SUMS]).items()])
    other = _means(*[F.sum(c).over(in_cell) - F.col(c) for c in SUMS])
    j = cells.withColumns({f"c_{n}": c for n, c in other.items()}).join(folds, ["b", "_fold"])
    e, m1, m0 = (F.coalesce(f"c_{n}", f"t_{n}") for n in ("e", "m1", "m0"))
    e = clip(e, *clip_to) if clip_to else e
    psi = [(m1 - m0) * F.col(f"p_{i}") + (F.col(f"py_{i}") - m1 * F.col(f"pa_{i}")) / e
           - (F.col(f"pc_{i}") - m0 * (F.col(f"p_{i}") - F.col(f"pa_{i}"))) / (1 - e) for i in range(d)]
    grams = [f"g_{i}_{k}" for i in range(d) for k in range(i, d)]
    rows = j.groupBy("b").agg(*[F.sum(c).alias(f"t_{i}") for i, c in enumerate(psi)],
                              *[F.sum(g).alias(g) for g in grams]).collect()      # n_boot + 1 rows
    beta = {r["b"]: _inverse(stacked._matrix(r, d, "g")) @ np.array([r[f"t_{i}"] for i in range(d)]) for r in rows}
    if 0 not in beta:
        raise ValueError("no unit without nulls to fit the effect model on")
    return RefittedModel(tuple(x_cols), beta[0], np.array([beta[b] for b in sorted(beta) if b]))
