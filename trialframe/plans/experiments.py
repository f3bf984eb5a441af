"""Experiments: sensitivity ("vibration") grid K20, predictive failure L8 and
the estimate log (A7/M7), on cohort E.

The grid is a driver loop over a *small* configuration product; every point
runs distributed Spark jobs (feature pivot, ML fits, one aggregation per
estimate) and yields one Estimate row.  The feature matrix of each
(aggregation, feature subset) pair is built once and cut from its lineage.
"""

from __future__ import annotations

import itertools
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.functions.hashing import poisson1, uniform
from trialframe.functions.time import shift
from trialframe.operators import boosted as BO
from trialframe.operators import diagnostics as DG
from trialframe.operators import effects as K
from trialframe.operators import features as FE
from trialframe.operators import matching as MT
from trialframe.operators import nuisance as NU
from trialframe.operators import relational as R
from trialframe.operators import stacked as ST
from trialframe.plans import fixtures as X
from trialframe.plans.q_cohort import cohort_e_population
from trialframe.plans.q_events import units_e
from trialframe.plans.q_primitives import E_CODES
from trialframe.session import cut_lineage
from trialframe.sources.io import ESTIMATE_SCHEMA

# Named feature subsets (codes of the event table; statics are always added
# except where the subset is demographics only).
FEATURE_SUBSETS = {
    "All confounders": list(E_CODES),
    "Without purchases": [c for c in E_CODES if c != "purchase"],
    "Without measurements": ["signup", "error"],
    "Demographics only": [],
}
STATICS_NUM = ["c_acctbal"]
STATICS_BIN = ["building"]


@dataclass
class GridConfig:
    aggregations: Sequence[Sequence[str]] = (("first", "last"),)
    methods: Sequence[str] = ("ipw", "dml")
    models: Sequence[str] = ("linear",)
    feature_subsets: Sequence[str] = ("All confounders",)
    outcome: str = "mortality_1day"
    n_folds: int = 5
    fold_seed: int = 0
    n_boot: int = 20
    n_iter: int = 10           # draws of the hyper-parameter search of each nuisance; 0: the defaults
    cohort_name: str = "events_view_purchase"
    extra: dict = field(default_factory=dict)


def analysis_frame(spark: SparkSession, sf_dir: str, aggs: Sequence[str], subset: str,
                   outcome: str = "mortality_1day", n_folds: int = 5, fold_seed: int = 0,
                   pop: DataFrame | None = None) -> tuple[DataFrame, list]:
    """Unit x feature matrix (J1 -> J8), assembled, with folds; cut lineage."""
    codes = FEATURE_SUBSETS[subset]
    pop = cut_lineage(cohort_e_population(spark, sf_dir)) if pop is None else pop      # used twice below
    units = units_e(spark, sf_dir, pop)
    if codes:
        from trialframe.plans.q_primitives import _obs_events_spark
        ev = FE.feature_subset(_obs_events_spark(spark, sf_dir, pop), codes)
        m = FE.patient_matrix(ev, units, codes, list(aggs), order=["starttime", "event_id"])
        num = [f"{agg}_code_{c}" for c in codes for agg in aggs] + STATICS_NUM
    else:
        m = units
        num = list(STATICS_NUM)
    # one row per unit, read by the moments, the exact medians and the
    # projection: materialised once instead of re-pivoting the events
    m = cut_lineage(m)
    dm = FE.design_matrix(m, numerical=num, binary=STATICS_BIN,
                          passthrough=["stay_id", "intervention_status", outcome])
    feats = num + STATICS_BIN
    dm = dm.withColumnRenamed("intervention_status", "a").withColumnRenamed(outcome, "y") \
           .withColumn("y", F.col("y").cast("double"))
    dm = FE.assign_folds(dm, "stay_id", ["a"], k=n_folds, seed=fold_seed)
    frame = cut_lineage(NU.assemble(dm, feats))
    FE.check_binary_treatment(frame, "a")        # J10 runtime check (reads <= 3 grouped rows)
    return frame, feats


METHODS = ("ipw", "psm", "t_learner", "dr", "dml", "causal_forest")


def search(frame: DataFrame, model: str, n_iter: int, id_col: str = "stay_id") -> dict:
    """Hyper-parameters of the treatment (``t_params``) and the outcome model (``y_params``), searched on all units."""
    if not n_iter:
        return {}
    return dict(t_params=NU.hyper_search(frame, model, "classifier", "a", n_iter, id_col=id_col)[0],
                y_params=NU.hyper_search(frame, model, "regressor", "y", n_iter, id_col=id_col)[0])


def point(frame: DataFrame, method: str, model: str, n_folds: int = 5, weight_col: str | None = None,
          t_params: dict | None = None, y_params: dict | None = None) -> tuple:
    """(ATE, normalised total variation of the propensity or None) of one estimator.

    With ``weight_col`` every nuisance is fitted, and the estimate taken, on
    the weighted units: one replicate of the bootstrap.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    a, y = F.col("a").cast("double"), F.col("y").cast("double")
    mean = lambda x: F.sum(w * x) / F.sum(w)
    take = lambda df, x: df.groupBy().agg(x.alias("ATE")).first()["ATE"]
    if method in ("ipw", "psm"):
        scored = NU.fit_predict(model, "classifier", frame, frame, "a", "e", t_params, weight_col)
        if method == "psm":
            ate = MT.psm_ate(scored, "e", weight_col=weight_col).first()["ATE"]
        else:
            e = K.clip(F.col("e"))
            t, c = w * a / e, w * (1 - a) / (1 - e)
            ate = take(scored, F.sum(t * y) / F.sum(t) - F.sum(c * y) / F.sum(c))
    elif method == "t_learner":
        scored = None
        ate = take(NU.t_learner(frame, model, params=y_params, weight_col=weight_col), mean(F.col("m1") - F.col("m0")))
    elif method == "dr":
        scored = NU.dr_nuisances(frame, k=n_folds, t_kind=model, y_kind=model, t_params=t_params, y_params=y_params,
                                 weight_col=weight_col)
        ate = take(scored, mean(K.aipw_pseudo()))
    elif method == "dml":
        scored = NU.dml_nuisances(frame, k=n_folds, t_kind=model, y_kind=model, t_params=t_params, y_params=y_params,
                                  weight_col=weight_col)
        ar = a - F.col("e")
        ate = take(scored, F.sum(w * ar * (y - F.col("m"))) / F.sum(w * ar * ar))
    else:
        raise ValueError(f"unknown method {method!r}")
    ntv = None if scored is None or weight_col else DG.normalized_total_variation(scored).first()["ntv"]
    return ate, ntv


def refit_interval(frame: DataFrame, method: str, model: str, n_boot: int, n_folds: int = 5, seed: int = 1,
                   id_col: str = "stay_id", alpha: float = 0.05, parallelism: int = 4,
                   params: dict | None = None) -> tuple[float, float]:
    """Percentile interval of the same estimator over ``n_boot`` Poisson-weighted refits.

    A weight is a function of the unit's id and the replicate; every replicate
    is its own distributed jobs, ``parallelism`` at a time; its one number
    reaches the driver."""
    def one(b):
        rep = frame.withColumn("_w", poisson1(uniform(F.col(id_col), F.lit(seed), F.lit(b)))).filter("_w > 0")
        return point(rep, method, model, n_folds, "_w", **(params or {}))[0]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        ates = [x for x in pool.map(one, range(n_boot)) if x is not None]
    return float(np.quantile(ates, alpha / 2)), float(np.quantile(ates, 1 - alpha / 2))


def estimate(frame: DataFrame, method: str, model: str, n_folds: int = 5, n_boot: int = 20,
             feats: Sequence[str] = (), params: dict | None = None) -> dict:
    """One grid point -> ATE, interval of the same estimator (refitting bootstrap), nTV of a fitted propensity."""
    if method == "causal_forest":
        nu = NU.dml_nuisances(frame, k=n_folds, t_kind=model, y_kind=model, **(params or {}))
        res = nu.select("stay_id", *feats, (F.col("a") - F.col("e")).alias("_ar"),
                        (F.col("y") - F.col("m")).alias("_yr"))
        _, ate = NU.causal_forest(res, feats, id_col="stay_id")
        r = ate.first()
        return dict(ATE=r["ATE"], lo=r["ATE_lower"], hi=r["ATE_upper"], ntv=None)
    ate, ntv = point(frame, method, model, n_folds, **(params or {}))
    lo, hi = refit_interval(frame, method, model, n_boot, n_folds, params=params) if n_boot else (None, None)
    return dict(ATE=ate, lo=lo, hi=hi, ntv=ntv)


def linear_estimates(frame: DataFrame, methods: Sequence[str], n_folds: int, n_boot: int, params: dict,
                     seed: int = 1, alpha: float = 0.05) -> dict[str, dict]:
    """Grid points of the linear model: every method and replicate from the same stacked fits."""
    fits = ST.fitted(frame, "stay_id", n_folds, n_boot, seed, params.get("t_params", {}).get("C", 1.0),
                     params.get("y_params", {}).get("alpha", 1.0))
    found = ST.estimates(fits, methods)
    first = ST.replicate_rows(fits, ["e_all", "e"], first=True)
    ntv = {e: DG.normalized_total_variation(first.select("a", F.col(e).alias("e"))).first()["ntv"] for e in ("e_all", "e")}
    propensity = {"ipw": "e_all", "psm": "e_all", "dr": "e", "dml": "e"}
    out = {}
    for m in methods:
        ates = [v for b, v in found[m].items() if b and v is not None]
        lo, hi = (float(np.quantile(ates, q)) if ates else None for q in (alpha / 2, 1 - alpha / 2))
        out[m] = dict(ATE=found[m].get(0), lo=lo, hi=hi, ntv=ntv.get(propensity.get(m)))
    return out


def vibration_grid(spark: SparkSession, sf_dir: str, cfg: GridConfig, parallelism: int = 4) -> DataFrame:
    """One Estimate row per (aggregation, method, model, feature subset),
    plus the unadjusted difference in means once per aggregation/subset.  The
    hyper-parameters of both nuisances are searched before the estimates, on all
    units, once per feature matrix and model; the replicates refit with them.
    Linear models are fitted for all replicates and methods together, and
    their rows carry the time of the shared fits.  ``parallelism`` feature
    matrices are worked on at a time."""
    pop = cut_lineage(cohort_e_population(spark, sf_dir))

    def one(pair: tuple) -> list[tuple]:
        aggs, subset = pair
        frame, feats = analysis_frame(spark, sf_dir, aggs, subset, cfg.outcome, cfg.n_folds, cfg.fold_seed, pop)
        agg_name = "__".join(aggs)
        row = lambda r, method, model, t0: (r["ATE"], r["lo"], r["hi"], r["ntv"], agg_name, method, model, model,
                                            subset, cfg.cohort_name, cfg.outcome, time.time() - t0)
        t0 = time.time()
        dm = K.diff_means(frame).first()
        rows = [row(dict(ATE=dm["ATE"], lo=dm["ATE_lower"], hi=dm["ATE_upper"], ntv=None), "Difference in mean", "", t0)]
        for model in cfg.models:
            t0 = time.time()
            params = search(frame, model, cfg.n_iter)
            together = [m for m in cfg.methods if model == "linear" and m != "causal_forest"]
            if together:
                got = linear_estimates(frame, together, cfg.n_folds, cfg.n_boot, params)
                rows += [row(got[m], m, model, t0) for m in together]
            for method in (m for m in cfg.methods if m not in together):
                t0 = time.time()
                rows.append(row(estimate(frame, method, model, cfg.n_folds, cfg.n_boot, feats, params), method, model, t0))
        return rows

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(one, itertools.product(cfg.aggregations, cfg.feature_subsets)))
    return spark.createDataFrame([r for part in parts for r in part], ESTIMATE_SCHEMA)


# ------------------------------------------------------------------ L8

def boosted_scores(parts: dict[tuple, DataFrame], test: DataFrame, n_iter: int, folds: int = 3) -> dict[tuple, dict]:
    """Scores on validation (``val``) and ``test`` units of each run's searched boosted model.

    ``parts``: the units (``stay_id, y, features, split``) of each run (seed, features); a run's seed
    deals its draws and search folds, as in ``nuisance.hyper_search``."""
    runs, draws, frames = list(parts), {}, []
    for i, run in enumerate(runs):
        draws[i] = NU.sample_grid("boosting", "classifier", n_iter, run[0])
        folded = FE.assign_folds(parts[run].filter("split = 'train'"), "stay_id", ["y"], k=folds, seed=run[0], out_col="fold")
        for df in (folded, parts[run].filter("split = 'test'").withColumn("fold", F.lit(BO.VALIDATION)),
                   test.withColumn("fold", F.lit(BO.TEST))):
            frames.append(df.select(F.lit(i).alias("run"), F.col("stay_id").alias("id"), "fold", "y",
                                    vector_to_array("features").alias("x")))
    _, scored = BO.search(cut_lineage(reduce(DataFrame.unionByName, frames)), draws, folds)
    return grouped_scores(scored.withColumn("kind", F.when(F.col("fold") == BO.VALIDATION, "val").otherwise("test")), runs)


def grouped_scores(scored: DataFrame, runs: Sequence) -> dict:
    """``binary_scores`` of each run and kind of units (``run``: place in ``runs``, ``kind, y, p``) from one pass."""
    out: dict = {run: {} for run in runs}
    for r in DG.binary_scores(scored, "p", "y", by=["run", "kind"]).collect():
        values = r.asDict()
        kind = values.pop("kind")
        out[runs[values.pop("run")]][kind] = values
    return out


def predictive_failure(spark: SparkSession, sf_dir: str, seeds: Sequence[int] = tuple(range(10)),
                       period_hours: float = 24.0, outcome: str = "mortality_3days",
                       models: Sequence[str] = ("linear", "dummy"), n_iter: int = 0, test_fraction: float = 0.2,
                       parallelism: int = 8) -> DataFrame:
    """Prediction with and without features measured after the treatment.

    One test set (``test_fraction``, seed 0) is held out for all runs and
    scored on the features known at inclusion.  A seed only re-deals the rest
    into training and validation.  ``features`` says whether training saw the
    events up to ``intime + period`` (``post``) or up to inclusion (``pre``).
    ``n_iter`` draws of the hyper-parameters are searched on the training part
    (0: the defaults).  ``parallelism`` pairs of seed and features are worked
    on at a time; searched boosted models of all pairs are grown together
    (``boosted.search``).  One score row per (seed, model, features)."""
    pop = cut_lineage(cohort_e_population(spark, sf_dir).withColumn("y", F.col(outcome).cast("double")))
    ev = X.keyed_events(spark, sf_dir).select("stay_id", F.col("ts").alias("starttime"), "event_id",
                                              F.col("event_type").alias("code"), "value")
    units = units_e(spark, sf_dir).select("stay_id", "c_acctbal", "building")
    feats = [f"last_code_{c}" for c in E_CODES] + ["c_acctbal", "building"]

    def matrix(end_expr):
        p = pop.withColumn("obs_end", end_expr)
        obs = R.observation_window(ev, p, end_col="obs_end", event_cols=["stay_id", "starttime", "event_id", "code", "value"])
        piv = R.pivot_codes(obs, ["stay_id"], E_CODES, ["last"], order=["starttime", "event_id"])
        m = units.join(pop.select("stay_id", "y"), "stay_id").join(piv, "stay_id", "left")
        return cut_lineage(NU.assemble(m.fillna(0.0, subset=feats), feats))

    seen = {"post": matrix(shift("intime", hours=period_hours)), "pre": matrix(F.col("inclusion_start"))}
    split = cut_lineage(FE.stratified_split(pop.select("stay_id", "y"), "stay_id", ["y"], test_fraction, seed=0))
    part = lambda df, s, name: df.join(s.filter(F.col("split") == name).select("stay_id"), "stay_id", "left_semi")
    test = NU.compact(part(seen["pre"], split, "test"))
    dev = split.filter(F.col("split") == "train").select("stay_id", "y")

    runs = list(itertools.product(seeds, seen))

    def dealt(run: tuple) -> DataFrame:
        seed, features = run
        again = FE.stratified_split(dev, "stay_id", ["y"], test_fraction, seed=seed + 1000)
        return NU.compact(seen[features].join(again.select("stay_id", "split"), "stay_id"))

    def row(seed: int, model: str, features: str, scores: dict, seconds: float) -> dict:
        values = {f"{k}_{m}": float(v) if v is not None else None for k, s in scores.items() for m, v in s.items()}
        return {**values, "random_seed": int(seed), "model": f"{model} ({features})", "compute_time": seconds}

    def one(run: tuple) -> list[tuple]:
        seed, features = run
        joined = parts[run]
        tr, va = joined.filter("split = 'train'"), joined.filter("split = 'test'")
        out = []
        for model in alone:
            t0 = time.time()
            params = NU.hyper_search(tr, model, "classifier", "y", n_iter, id_col="stay_id", seed=seed)[0] if n_iter else {}
            n, sd = NU.label_stats(tr, "y")
            fitted = NU.fit(NU.make_model(model, "classifier", "y", n, sd, params, seed=seed), tr)
            scored = [NU.predict(fitted, x, "classifier", "p").select(F.lit(k).alias("kind"), "y", "p")
                      for k, x in (("val", va), ("test", test))]
            out.append(((seed, model, features), scored, time.time() - t0))
        return out

    # Searched boosting: all runs' models grow in the same passes; a run's time is its share of them.
    together = bool(n_iter) and "boosting" in models
    alone = [m for m in models if not (together and m == "boosting")]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = dict(zip(runs, pool.map(dealt, runs), strict=True))
        fits = [x for part in pool.map(one, runs) for x in part]
    rows = []
    if fits:                                # all scores from one pass; a model's time has its share of it
        t0 = time.time()
        scored = reduce(DataFrame.union, [x.select(F.lit(i).alias("run"), "kind", "y", "p") for i, (_, xs, _) in enumerate(fits) for x in xs])
        found = grouped_scores(scored, [key for key, _, _ in fits])
        share = (time.time() - t0) / len(fits)
        rows = [row(*key, found[key], seconds + share) for key, _, seconds in fits]
    if together:
        t0 = time.time()
        found = boosted_scores(parts, test, n_iter)
        seconds = (time.time() - t0) / len(runs)
        rows += [row(seed, "boosting", features, found[seed, features], seconds) for seed, features in runs]
    cols = sorted({k for r in rows for k in r} - {"random_seed", "model", "compute_time"})
    return spark.createDataFrame([tuple(r.get(c) for c in cols) + (r["random_seed"], r["model"], r["compute_time"])
                                  for r in rows],
                                 ", ".join(f"{c} double" for c in cols) + ", random_seed int, model string, "
                                 "compute_time double")
