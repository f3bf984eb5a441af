"""Registered report queries (M1, M3-M6) and the observation-window
sensitivity (K21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.operators import cohort as C
from trialframe.operators import diagnostics as DG
from trialframe.operators import effects as K
from trialframe.operators import matching as MT
from trialframe.operators import reports as RP
from trialframe.plans import fixtures as X
from trialframe.plans.q_cohort import WINDOWS
from trialframe.plans.q_effects import (
    AIPW_PSI, CATE_SQL, CELLS_SQL, CROSSFIT_SQL, DIFF_MEANS_SQL, DML_SQL, FOLD_SEED, N_FOLDS, TRIAL, TRIAL_SQL, _cate_inputs, cells_d, crossfit_d,
    units_d,
    NN_SQL,
)
from trialframe.plans.q_events import OBS_EVENTS_SQL, UNITS_E_SQL, patient_matrix_e
from trialframe.plans.registry import register, rounded
from trialframe.functions.time import seconds_between
from trialframe.session import cut_lineage

sec = X.sec_sql

# ------------------------------------------------------------------ M1

T1_NUM = ["c_acctbal", "last_code_view"]
T1_CAT = ["c_mktsegment"]


@register("table_one", f"""WITH {OBS_EVENTS_SQL}, {UNITS_E_SQL},
piv AS (SELECT stay_id, arg_max(value, (starttime, event_id)) FILTER (WHERE code = 'view') AS last_code_view
        FROM obs GROUP BY stay_id),
m AS (SELECT u.intervention_status AS arm, u.c_acctbal, p.last_code_view, u.c_mktsegment
      FROM piv p JOIN units u USING (stay_id)),
l AS (SELECT arm, 'c_acctbal' AS variable, c_acctbal AS x FROM m UNION ALL
      SELECT arm, 'last_code_view', last_code_view FROM m),
tot AS (SELECT arm, count(*) AS tot FROM m GROUP BY arm)
SELECT variable, CAST(NULL AS VARCHAR) AS level, arm, count(x) AS n, round(avg(x), 6) AS mean,
       round(stddev_samp(x), 6) AS sd, count(*) FILTER (WHERE x IS NULL) AS n_missing, CAST(NULL AS DOUBLE) AS pct
FROM l GROUP BY variable, arm
UNION ALL
SELECT 'c_mktsegment', c_mktsegment, arm, count(*), NULL, NULL, NULL, round(100.0 * count(*) / max(tot), 6)
FROM m JOIN tot USING (arm) GROUP BY c_mktsegment, arm""")
def q_table_one(spark, sf_dir):
    m = cut_lineage(patient_matrix_e(spark, sf_dir, ["last"]))     # read by both variable kinds
    return rounded(RP.table_one(m, "intervention_status", T1_NUM, T1_CAT))


TESTS_SQL = f"""WITH {OBS_EVENTS_SQL}, {UNITS_E_SQL},
piv AS (SELECT stay_id, arg_max(value, (starttime, event_id)) FILTER (WHERE code = 'view') AS last_code_view
        FROM obs GROUP BY stay_id),
m AS (SELECT u.intervention_status AS arm, u.c_acctbal, p.last_code_view, u.c_mktsegment
      FROM piv p JOIN units u USING (stay_id)),
l AS (SELECT arm, 'c_acctbal' AS variable, c_acctbal AS x FROM m UNION ALL
      SELECT arm, 'last_code_view', last_code_view FROM m),
mo AS (SELECT variable, count(x) FILTER (WHERE arm = 1) AS n1, count(x) FILTER (WHERE arm = 0) AS n0,
              avg(x) FILTER (WHERE arm = 1) AS m1, avg(x) FILTER (WHERE arm = 0) AS m0,
              var_samp(x) FILTER (WHERE arm = 1) / count(x) FILTER (WHERE arm = 1) AS s1,
              var_samp(x) FILTER (WHERE arm = 0) / count(x) FILTER (WHERE arm = 0) AS s0 FROM l GROUP BY variable),
ce AS (SELECT c_mktsegment AS level, count(*) FILTER (WHERE arm = 1) AS o1, count(*) FILTER (WHERE arm = 0) AS o0
       FROM m GROUP BY c_mktsegment),
tt AS (SELECT sum(o1) AS t1, sum(o0) AS t0, count(*) AS nl FROM ce),
ch AS (SELECT sum(power(o1 - (o1 + o0) * t1 / (t1 + t0), 2) / ((o1 + o0) * t1 / (t1 + t0))
                + power(o0 - (o1 + o0) * t0 / (t1 + t0), 2) / ((o1 + o0) * t0 / (t1 + t0))) AS stat,
              max(nl) - 1.0 AS dof FROM ce, tt)
SELECT variable, 'welch_t' AS test, round((m1 - m0) / sqrt(s1 + s0), 6) AS statistic,
       round(power(s1 + s0, 2) / (power(s1, 2) / (n1 - 1) + power(s0, 2) / (n0 - 1)), 6) AS dof FROM mo
UNION ALL SELECT 'c_mktsegment', 'chi_square', round(stat, 6), round(dof, 6) FROM ch"""


@register("table_one_tests", TESTS_SQL)
def q_table_one_tests(spark, sf_dir):
    m = cut_lineage(patient_matrix_e(spark, sf_dir, ["last"]))
    return rounded(RP.baseline_tests(m, "intervention_status", T1_NUM, T1_CAT))


@register("table_one_pvalues")
def q_table_one_pvalues(spark, sf_dir):
    m = cut_lineage(patient_matrix_e(spark, sf_dir, ["last"]))
    return rounded(RP.with_p_values(RP.baseline_tests(m, "intervention_status", T1_NUM, T1_CAT)))


# ------------------------------------------------------------------ M3

# Fixed display labels, groups and order of the estimators in the forest plot.
METHOD_LABELS = {"reference_trial": "Reference trial", "diff_means": "Difference in means", "ipw_ht": "Inverse Propensity Weighting",
                 "aipw": "Doubly Robust (AIPW)", "dml_cells": "Double Machine Learning",
                 "psm_ate": "Propensity Score Matching"}
METHOD_GROUPS = {"reference_trial": "Trial", "diff_means": "Unadjusted", "ipw_ht": "Adjusted", "aipw": "Adjusted",
                 "dml_cells": "Adjusted", "psm_ate": "Adjusted"}
METHOD_ORDER = ["reference_trial", "diff_means", "ipw_ht", "psm_ate", "aipw", "dml_cells"]


def estimates_d(spark, sf_dir):
    """The trial's row and one per estimator on cohort D (method, ATE, lower, upper), all from one
    materialised unit frame."""
    null = F.lit(None).cast("double")
    u = units_d(spark, sf_dir)
    cells = cut_lineage(cells_d(spark, sf_dir, u))
    rows = [
        K.trial_benchmark(spark, *TRIAL, "reference_trial"),
        K.diff_means(u).select(F.lit("diff_means").alias("estimation_method"), "ATE",
                                                    "ATE_lower", "ATE_upper"),
        K.ipw(cells).select(F.lit("ipw_ht").alias("estimation_method"), "ATE",
                                             null.alias("ATE_lower"), null.alias("ATE_upper")),
        K.aipw(cells).select(F.lit("aipw").alias("estimation_method"), "ATE", "ATE_lower",
                                              "ATE_upper"),
        K.dml_ate(crossfit_d(spark, sf_dir, u)).select(F.lit("dml_cells").alias("estimation_method"), "ATE",
                                                    "ATE_lower", "ATE_upper"),
        MT.psm_ate(cells).select(F.lit("psm_ate").alias("estimation_method"), "ATE",
                                                  null.alias("ATE_lower"), null.alias("ATE_upper")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _labels_case(mapping, col="estimation_method"):
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


@register("forest_table", f"""WITH {CELLS_SQL}, {CROSSFIT_SQL.replace(X.DOC_UNITS_SQL.strip() + ',', '', 1)},
{DML_SQL},
{NN_SQL.split(CELLS_SQL + ',', 1)[1]},
est AS (
  SELECT 'diff_means' AS estimation_method, ate AS "ATE", ate - 1.96 * se AS "ATE_lower", ate + 1.96 * se AS "ATE_upper"
  FROM (SELECT {DIFF_MEANS_SQL} FROM units)
  UNION ALL SELECT 'ipw_ht', avg(a * y / least(greatest(e, 0.001), 0.999)
                                 - (1 - a) * y / (1 - least(greatest(e, 0.001), 0.999))), NULL, NULL FROM nu
  UNION ALL SELECT 'aipw', avg({AIPW_PSI}), avg({AIPW_PSI}) - 1.96 * stddev_samp({AIPW_PSI}) / sqrt(count(*)),
                   avg({AIPW_PSI}) + 1.96 * stddev_samp({AIPW_PSI}) / sqrt(count(*)) FROM nu
  UNION ALL SELECT 'dml_cells', ate, ate - 1.96 * se, ate + 1.96 * se FROM v
  UNION ALL ({TRIAL_SQL})
  UNION ALL SELECT 'psm_ate', sum(CASE WHEN arm = 1 THEN sy - n * match_y ELSE n * match_y - sy END) / sum(n), NULL, NULL FROM nn
)
SELECT estimation_method, round("ATE", 6) AS "ATE", round("ATE_lower", 6) AS "ATE_lower",
  round("ATE_upper", 6) AS "ATE_upper", {_labels_case(METHOD_LABELS)} AS label, {_labels_case(METHOD_GROUPS)} AS "group",
  CAST({_labels_case({m: i for i, m in enumerate(METHOD_ORDER)})} AS INTEGER) AS sort_key
FROM est""")
def q_forest_table(spark, sf_dir):
    return rounded(RP.forest_table(estimates_d(spark, sf_dir), METHOD_LABELS, METHOD_GROUPS, METHOD_ORDER))


# ------------------------------------------------------------------ K21, M4

def window_population(spark, sf_dir, windows=WINDOWS):
    """The cohort under several observation windows in one pass: the stay
    table with first view and first purchase comes from one aggregation over
    the events; each stay is expanded to the windows (bounded literal list)
    and filtered per window."""
    st = cut_lineage(X.stays(spark, sf_dir, firsts={"_first_view": F.col("event_type") == "view",
                                                    "_first_trt": F.col("event_type") == "purchase"}))
    w = st.select("*", F.explode(F.array(*[F.lit(float(x)) for x in windows])).alias("window_days"))
    di = seconds_between("_first_view", "intime")
    pop = w.filter((di >= 0) & (di <= F.col("window_days") * 86400.0)).withColumnRenamed("_first_view",
                                                                                         "inclusion_start")
    d = seconds_between("_first_trt", "intime")
    treated = (d >= 0) & (d <= F.col("window_days") * 86400.0) & (F.col("_first_trt") > F.col("inclusion_start"))
    pop = pop.withColumn("a", F.coalesce(treated, F.lit(False)).cast("int"))
    pop = X.death_after(spark, sf_dir, pop.select("window_days", "subject_id", "stay_id", "intime",
                                                  "inclusion_start", "a", "_next_err"))
    return C.outcome_horizon(pop, {"y": 1})


WINDOW_POP_SQL = "WITH " + X.STAYS_SQL + f""",
f AS (SELECT stay_id, min(ts) AS inclusion_start FROM kev WHERE event_type = 'view' GROUP BY stay_id),
t AS (SELECT stay_id, min(ts) AS first_trt FROM kev WHERE event_type = 'purchase' GROUP BY stay_id),
w AS (SELECT unnest([0.25, 1.0, 3.0]) AS window_days),
wp AS (
  SELECT CAST(w.window_days AS DOUBLE) AS window_days, s.stay_id, s.subject_id, f.inclusion_start,
    CAST(coalesce({sec('t.first_trt', 's.intime')} >= 0 AND {sec('t.first_trt', 's.intime')} <= w.window_days * 86400.0
         AND t.first_trt > f.inclusion_start, false) AS INTEGER) AS a,
    (SELECT min(e.ts) FROM kev e WHERE e.subject_id = s.subject_id AND e.event_type = 'error'
       AND e.ts >= f.inclusion_start) AS dod
  FROM stays s JOIN f USING (stay_id) LEFT JOIN t USING (stay_id), w
  WHERE {sec('f.inclusion_start', 's.intime')} >= 0 AND {sec('f.inclusion_start', 's.intime')} <= w.window_days * 86400.0
),
wpy AS (SELECT *, CAST(dod IS NOT NULL AND floor({sec('dod', 'inclusion_start')} / 86400) <= 1 AS INTEGER) AS y FROM wp),
ws AS (SELECT window_days, {DIFF_MEANS_SQL}, count(*) AS n FROM wpy GROUP BY window_days)"""


@register("window_sensitivity", WINDOW_POP_SQL + """
SELECT window_days, n, round(ate, 6) AS "ATE", round(ate - 1.96 * se, 6) AS "ATE_lower",
       round(ate + 1.96 * se, 6) AS "ATE_upper" FROM ws""")
def q_window_sensitivity(spark, sf_dir):
    wp = window_population(spark, sf_dir)
    est = K.diff_means(wp, by=["window_days"])
    n = wp.groupBy("window_days").agg(F.count(F.lit(1)).alias("n"))
    return rounded(est.join(n, "window_days").select("window_days", "n", "ATE", "ATE_lower", "ATE_upper"))


@register("window_table", WINDOW_POP_SQL + """
SELECT lpad(CAST(CAST(round(window_days * 24) AS INTEGER) AS VARCHAR), 2, '0') || 'h' AS observation_period,
       CAST(round(window_days * 24) AS INTEGER) AS hours, 'Difference in means' AS label,
       round(ate, 6) AS "ATE", round(ate - 1.96 * se, 6) AS "ATE_lower", round(ate + 1.96 * se, 6) AS "ATE_upper"
FROM ws""")
def q_window_table(spark, sf_dir):
    est = K.diff_means(window_population(spark, sf_dir), by=["window_days"])
    out = est.withColumn("hours", F.round(F.col("window_days") * 24).cast("int"))
    return rounded(out.select(RP.period_label("hours").alias("observation_period"), "hours",
                              F.lit("Difference in means").alias("label"), "ATE", "ATE_lower", "ATE_upper"))


# ------------------------------------------------------------------ M5

@register("cate_subgroups", CATE_SQL + """,
u AS (SELECT b.b0 + b.b1 * CAST(toxic AS DOUBLE) AS cate, toxic, CAST(s2 = 0 AS INTEGER) AS short_doc FROM xf, b),
l AS (SELECT cate, 'toxic' AS feature, toxic AS feature_value FROM u
      UNION ALL SELECT cate, 'short_doc', short_doc FROM u)
SELECT feature, feature_value, count(*) AS n, round(avg(cate), 6) AS mean, round(quantile_cont(cate, 0.05), 6) AS q05,
       round(quantile_cont(cate, 0.95), 6) AS q95 FROM l GROUP BY feature, feature_value""")
def q_cate_subgroups(spark, sf_dir):
    crossfit = cut_lineage(crossfit_d(spark, sf_dir))
    coefs = K.cate_linear(_cate_inputs(spark, sf_dir, crossfit), ["toxic"])
    xf = crossfit.select(F.col("toxic").cast("double").alias("toxic"),
                                          (F.col("s2") == 0).cast("int").alias("short_doc"))
    per_unit = xf.withColumn("cate", K.theta_expr(coefs))
    return rounded(RP.subgroup_summary(per_unit, "cate", ["toxic", "short_doc"]))


# ------------------------------------------------------------------ M6

# Feature sets and the strata that their models see.
FEATURE_SETS = {"source": ["s1"], "source and length": ["s1", "s2"]}
METRICS = ["n_samples", "prevalence", "accuracy", "brier", "roc_auc", "pr_auc"]


def _set_sql(strata):
    inner = CROSSFIT_SQL.replace(X.DOC_UNITS_SQL.strip() + ",", "WITH ", 1)
    if "s2" not in strata:
        inner = inner.replace("so.s1, so.s2", "so.s1").replace("s1, s2", "s1")
    return f"SELECT unit_id, m AS p, y FROM ({inner} SELECT unit_id, m, y FROM xf)"


@register("score_comparison", "WITH " + X.DOC_UNITS_SQL.strip() + f""",
sp AS (SELECT unit_id, y, row_number() OVER (PARTITION BY y ORDER BY
         ('0x' || substr(md5(concat_ws('|', CAST(unit_id AS VARCHAR), '0')), 1, 8))::BIGINT, unit_id) - 1 AS rk,
         count(*) OVER (PARTITION BY y) AS n FROM units),
pr AS ({' UNION ALL '.join(f"SELECT '{k}' AS feature_set, * FROM ({_set_sql(v)})" for k, v in FEATURE_SETS.items())}),
sc AS (SELECT feature_set, CASE WHEN sp.rk < round(sp.n * 0.3) THEN 'test' ELSE 'train' END AS split, pr.p, pr.y
       FROM pr JOIN sp USING (unit_id)),
bs AS (SELECT feature_set, split, CAST(count(*) AS DOUBLE) AS n_samples, avg(CAST(y = 1 AS DOUBLE)) AS prevalence,
             avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy, avg((p - y) * (p - y)) AS brier
       FROM sc GROUP BY feature_set, split),
ds AS (SELECT feature_set, split, p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
       FROM sc GROUP BY feature_set, split, p),
rk AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY feature_set, split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING
                 AND 1 PRECEDING), 0) AS neg_below,
              sum(pos) OVER up AS pos_from, sum(neg) OVER up AS neg_from,
              sum(pos) OVER (PARTITION BY feature_set, split) AS np, sum(neg) OVER (PARTITION BY feature_set, split) AS nn
       FROM ds WINDOW up AS (PARTITION BY feature_set, split ORDER BY p DESC)),
au AS (SELECT feature_set, split, sum(pos * (neg_below + 0.5 * neg)) / (max(np) * max(nn)) AS roc_auc,
              sum(pos / np * (pos_from / (pos_from + neg_from))) AS pr_auc FROM rk GROUP BY feature_set, split),
w AS (SELECT * FROM bs JOIN au USING (feature_set, split))
SELECT feature_set, split, metric, round(value, 6) AS value FROM (UNPIVOT w ON {', '.join(METRICS)}
  INTO NAME metric VALUE value)""")
def q_score_comparison(spark, sf_dir):
    """M6: scores of every feature set on every split; the sets and splits share one pass of rank metrics."""
    from trialframe.operators.features import assign_folds, stratified_split
    u = cut_lineage(assign_folds(units_d(spark, sf_dir), "unit_id", ["a"], k=N_FOLDS, seed=FOLD_SEED))
    preds = None
    for name, strata in FEATURE_SETS.items():
        one = K.crossfit_cell_nuisances(u, strata, "fold").select("unit_id", F.lit(name).alias("feature_set"),
                                                                  F.col("m").alias("p"), "y")
        preds = one if preds is None else preds.unionByName(one)
    sp = stratified_split(u.select("unit_id", "y"), "unit_id", ["y"], 0.3, seed=0)
    by = ["feature_set", "split"]
    scores = DG.binary_scores(preds.join(sp.select("unit_id", "split"), "unit_id"), "p", "y", by=by)
    return rounded(RP.metrics_long(scores, by, METRICS))
