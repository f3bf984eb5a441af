"""Registered estimator and diagnostic queries with exact oracles.

Cohort D (documents/labels): treatment ``a`` = non-English, outcome ``y`` =
quality, strata (source, length band).  Nuisances are saturated cell means,
in-sample or cross-fitted over 5 hash-ordered folds stratified by treatment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.hashing import poisson1_sql, uniform_sql
from trialframe.operators import diagnostics as DG
from trialframe.operators import effects as K
from trialframe.operators import features as FE
from trialframe.operators import matching as MT
from trialframe.plans import fixtures as X
from trialframe.plans.q_events import _hash_order_sql, patient_matrix_e
from trialframe.plans.registry import register, rounded
from trialframe.session import cut_lineage

STRATA = ["s1", "s2"]
FOLD_SEED = 11
N_FOLDS = 5


def units_d(spark, sf_dir):
    """Cohort D units, materialised once: every estimator reads the unit table
    several times (cell sums, overall means, join-back), which would otherwise
    re-run the documents x labels join each time."""
    return cut_lineage(X.document_units(spark, sf_dir))


def cells_d(spark, sf_dir, units=None):
    """In-sample cell nuisances of the units (``units``: a materialised ``units_d``)."""
    return K.cell_nuisances(units_d(spark, sf_dir) if units is None else units, STRATA)


def crossfit_d(spark, sf_dir, units=None):
    """Units with folds (materialised: read by the (stratum, fold) sums, the
    fold totals and the join-back) and their out-of-fold cell nuisances."""
    units = units_d(spark, sf_dir) if units is None else units
    u = cut_lineage(FE.assign_folds(units, "unit_id", ["a"], k=N_FOLDS, seed=FOLD_SEED))
    return K.crossfit_cell_nuisances(u, STRATA, "fold")


CELLS_SQL = X.DOC_UNITS_SQL.strip() + """,
cells AS (SELECT s1, s2, avg(a) AS e, avg(CASE WHEN a = 1 THEN y END) AS m1_, avg(CASE WHEN a = 0 THEN y END) AS m0_,
                 avg(y) AS m FROM units GROUP BY s1, s2),
g AS (SELECT avg(CASE WHEN a = 1 THEN y END) AS g1, avg(CASE WHEN a = 0 THEN y END) AS g0 FROM units),
nu AS (SELECT u.*, c.e, c.m, coalesce(c.m1_, g.g1) AS m1, coalesce(c.m0_, g.g0) AS m0
       FROM units u JOIN cells c USING (s1, s2) CROSS JOIN g)"""

_sums = ("count(*) AS n, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(CASE WHEN a = 1 THEN y ELSE 0 END) AS DOUBLE) AS y1, "
         "CAST(sum(CASE WHEN a = 0 THEN y ELSE 0 END) AS DOUBLE) AS y0, CAST(sum(y) AS DOUBLE) AS yy")
_o = ", ".join(f"sum({c}) OVER (PARTITION BY s1, s2) - {c} AS o_{c}" for c in ["n", "na", "y1", "y0", "yy"])
_t = ", ".join(f"sum({c}) OVER () - {c} AS t_{c}" for c in ["n", "na", "y1", "y0", "yy"])

CROSSFIT_SQL = X.DOC_UNITS_SQL.strip() + f""",
folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY a ORDER BY {_hash_order_sql('unit_id', FOLD_SEED)}, unit_id) - 1)
                         % {N_FOLDS} AS INTEGER) AS fold FROM units),
sf AS (SELECT s1, s2, fold, {_sums} FROM folds GROUP BY s1, s2, fold),
so AS (SELECT s1, s2, fold, {_o} FROM sf),
tf AS (SELECT fold, {_t} FROM (SELECT fold, {_sums} FROM folds GROUP BY fold)),
cf AS (SELECT so.s1, so.s2, so.fold,
         coalesce(CASE WHEN o_n > 0 THEN o_na / o_n END, t_na / t_n) AS e,
         coalesce(CASE WHEN o_na > 0 THEN o_y1 / o_na END, t_y1 / t_na) AS m1,
         coalesce(CASE WHEN o_n - o_na > 0 THEN o_y0 / (o_n - o_na) END, t_y0 / (t_n - t_na)) AS m0,
         coalesce(CASE WHEN o_n > 0 THEN o_yy / o_n END, t_yy / t_n) AS m
       FROM so JOIN tf USING (fold)),
xf AS (SELECT f.*, cf.e, cf.m1, cf.m0, cf.m FROM folds f JOIN cf USING (s1, s2, fold))"""

CLIPPED = "least(greatest(e, 0.001), 0.999)"
AIPW_PSI = (f"(m1 - m0 + a * (y - m1) / {CLIPPED} - (1 - a) * (y - m0) / (1 - {CLIPPED}))")


# ------------------------------------------------------------------ K1-K3

@register("risk_difference", f"""WITH {X.DOC_UNITS_SQL.strip()},
t AS (SELECT avg(CASE WHEN a = 1 THEN y END) AS p1, avg(CASE WHEN a = 0 THEN y END) AS p0,
             count(*) FILTER (WHERE a = 1) AS n1, count(*) FILTER (WHERE a = 0) AS n0 FROM units)
SELECT round(p1, 6) AS p1, round(p0, 6) AS p0, n1, n0, round(p1 - p0, 6) AS "ATE",
  round(p1 - p0 - {K.Z975} * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 6) AS "ATE_lower",
  round(p1 - p0 + {K.Z975} * sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0), 6) AS "ATE_upper" FROM t""")
def q_risk_difference(spark, sf_dir):
    return rounded(K.risk_difference(X.document_units(spark, sf_dir)))


@register("frechet_bounds", f"""WITH {X.DOC_UNITS_SQL.strip()},
t AS (SELECT avg(a * y) AS pya, avg((1 - a) * y) AS pyna, avg(a) AS pa FROM units)
SELECT round(pya - pyna - pa, 6) AS lower, round(pya + (1 - pa) - pyna, 6) AS upper,
       round((pya + (1 - pa) - pyna) - (pya - pyna - pa), 6) AS width FROM t""")
def q_frechet_bounds(spark, sf_dir):
    return rounded(K.frechet_bounds(X.document_units(spark, sf_dir)))


DIFF_MEANS_SQL = """avg(CASE WHEN a = 1 THEN y END) - avg(CASE WHEN a = 0 THEN y END) AS ate,
  sqrt(var_pop(CASE WHEN a = 0 THEN y END) / (count(*) FILTER (WHERE a = 0) - 1)
     + var_pop(CASE WHEN a = 1 THEN y END) / (count(*) FILTER (WHERE a = 1) - 1)) AS se"""


@register("diff_means", f"""WITH {X.DOC_UNITS_SQL.strip()}, t AS (SELECT {DIFF_MEANS_SQL} FROM units)
SELECT round(ate, 6) AS "ATE", round(se, 6) AS se, round(ate - 1.96 * se, 6) AS "ATE_lower",
       round(ate + 1.96 * se, 6) AS "ATE_upper" FROM t""")
def q_diff_means(spark, sf_dir):
    return rounded(K.diff_means(X.document_units(spark, sf_dir)))


# ------------------------------------------------------------------ K4-K7

@register("ipw_ht", f"""WITH {CELLS_SQL}
SELECT round(avg(a * y / {CLIPPED} - (1 - a) * y / (1 - {CLIPPED})), 6) AS "ATE" FROM nu""")
def q_ipw_ht(spark, sf_dir):
    return rounded(K.ipw(cells_d(spark, sf_dir)))


@register("ipw_hajek", f"""WITH {CELLS_SQL}
SELECT round(sum(a * y / {CLIPPED}) / sum(a / {CLIPPED})
           - sum((1 - a) * y / (1 - {CLIPPED})) / sum((1 - a) / (1 - {CLIPPED})), 6) AS "ATE" FROM nu""")
def q_ipw_hajek(spark, sf_dir):
    return rounded(K.ipw(cells_d(spark, sf_dir), normalised=True))


@register("g_formula", f"""WITH {CELLS_SQL} SELECT round(avg(m1 - m0), 6) AS "ATE" FROM nu""")
def q_g_formula(spark, sf_dir):
    return rounded(K.g_formula(cells_d(spark, sf_dir)))


def _aipw_sql(src):
    return f"""t AS (SELECT avg({AIPW_PSI}) AS ate, stddev_samp({AIPW_PSI}) / sqrt(count(*)) AS se FROM {src})
SELECT round(ate, 6) AS "ATE", round(se, 6) AS se, round(ate - 1.96 * se, 6) AS "ATE_lower",
       round(ate + 1.96 * se, 6) AS "ATE_upper" FROM t"""


@register("aipw", f"WITH {CELLS_SQL}, {_aipw_sql('nu')}")
def q_aipw(spark, sf_dir):
    return rounded(K.aipw(cells_d(spark, sf_dir)))


@register("dr_crossfit_cells", f"WITH {CROSSFIT_SQL}, {_aipw_sql('xf')}")
def q_dr_crossfit_cells(spark, sf_dir):
    return rounded(K.aipw(crossfit_d(spark, sf_dir)))


DML_SQL = """r AS (SELECT a - e AS ar, y - m AS yr FROM xf),
t AS (SELECT sum(ar * yr) / sum(ar * ar) AS ate, sum(ar * ar) AS sxx FROM r),
v AS (SELECT t.ate, sqrt(sum(ar * ar * (yr - t.ate * ar) * (yr - t.ate * ar))) / t.sxx AS se FROM r, t GROUP BY t.ate, t.sxx)"""


@register("dml_cells", f"""WITH {CROSSFIT_SQL}, {DML_SQL}
SELECT round(ate, 6) AS "ATE", round(se, 6) AS se, round(ate - 1.96 * se, 6) AS "ATE_lower",
       round(ate + 1.96 * se, 6) AS "ATE_upper" FROM v""")
def q_dml_cells(spark, sf_dir):
    return rounded(K.dml_ate(crossfit_d(spark, sf_dir)))


@register("oof_predictions", f"""WITH {CROSSFIT_SQL}
SELECT unit_id, fold, round(e, 6) AS e, round(m1, 6) AS m1, round(m0, 6) AS m0, round(m, 6) AS m FROM xf""")
def q_oof_predictions(spark, sf_dir):
    return rounded(crossfit_d(spark, sf_dir).select("unit_id", "fold", "e", "m1", "m0", "m"))


# ------------------------------------------------------------------ K11, C12

NN_SQL = f"""WITH {CELLS_SQL},
d AS (SELECT a AS arm, CAST(e AS DOUBLE) AS score, count(*) AS n, CAST(sum(y) AS DOUBLE) AS sy FROM nu GROUP BY a, e),
mt AS (SELECT d.*, (SELECT o.score FROM d o WHERE o.arm <> d.arm ORDER BY abs(o.score - d.score), o.score LIMIT 1)
                   AS match_score FROM d),
nn AS (SELECT mt.arm, mt.score, mt.n, mt.sy, mt.match_score, o.sy / o.n AS match_y
       FROM mt JOIN d o ON o.arm <> mt.arm AND o.score = mt.match_score)"""


@register("psm_match", NN_SQL + """
SELECT arm, round(score, 6) AS score, n, round(sy, 6) AS sy, round(match_score, 6) AS match_score,
       round(match_y, 6) AS match_y FROM nn""")
def q_psm_match(spark, sf_dir):
    return rounded(MT.nearest_opposite(cells_d(spark, sf_dir), "e"))


@register("psm_ate", NN_SQL + """,
df AS (SELECT arm, n, CASE WHEN arm = 1 THEN sy - n * match_y ELSE n * match_y - sy END AS diff FROM nn)
SELECT round(sum(diff) / sum(n), 6) AS "ATE",
       round(sum(diff) FILTER (WHERE arm = 1) / sum(n) FILTER (WHERE arm = 1), 6) AS "ATT",
       round(sum(diff) FILTER (WHERE arm = 0) / sum(n) FILTER (WHERE arm = 0), 6) AS "ATC" FROM df""")
def q_psm_ate(spark, sf_dir):
    return rounded(MT.psm_ate(cells_d(spark, sf_dir), "e"))


# ------------------------------------------------------------------ K13, K15

CATE_SQL = f"""WITH {CROSSFIT_SQL},
r AS (SELECT a - e AS ar, y - m AS yr, CAST(toxic AS DOUBLE) AS x FROM xf),
g AS (SELECT sum(ar * ar) AS s00, sum(ar * ar * x) AS s01, sum(ar * x * ar * x) AS s11,
             sum(ar * yr) AS t0, sum(ar * x * yr) AS t1 FROM r),
b AS (SELECT (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS b0,
             (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS b1 FROM g)"""


def _cate_inputs(spark, sf_dir, xf=None):
    xf = crossfit_d(spark, sf_dir) if xf is None else xf
    return xf.select((F.col("a") - F.col("e")).alias("_ar"), (F.col("y") - F.col("m")).alias("_yr"),
                     F.col("toxic").cast("double").alias("toxic"))


@register("cate_linear", CATE_SQL + """
SELECT round(b0, 6) AS intercept, round(b1, 6) AS toxic FROM b""")
def q_cate_linear(spark, sf_dir):
    coefs = K.cate_linear(_cate_inputs(spark, sf_dir), ["toxic"])
    return rounded(spark.createDataFrame([(coefs["intercept"], coefs["toxic"])], "intercept double, toxic double"))


@register("cate_score", CATE_SQL + """
SELECT round(avg((yr - (b.b0 + b.b1 * x) * ar) * (yr - (b.b0 + b.b1 * x) * ar)), 6) AS cate_score FROM r, b""")
def q_cate_score(spark, sf_dir):
    r = _cate_inputs(spark, sf_dir)
    coefs = K.cate_linear(r, ["toxic"])
    return rounded(K.cate_score(r, K.theta_expr(coefs)))


# ------------------------------------------------------------------ K16

N_BOOT = 50
BOOT_SEED = 3


@register("bootstrap_ci", f"""WITH {X.DOC_UNITS_SQL.strip()},
bw AS (SELECT u.*, b.b, {poisson1_sql(uniform_sql('u.unit_id', str(BOOT_SEED), 'b.b'))} AS w
       FROM units u CROSS JOIN (SELECT range AS b FROM range({N_BOOT})) b),
reps AS (SELECT b, sum(w * a * y) / sum(w * a) - sum(w * (1 - a) * y) / sum(w * (1 - a)) AS stat
         FROM bw WHERE w > 0 GROUP BY b)
SELECT round(avg(stat), 6) AS boot_mean, round(quantile_cont(stat, 0.025), 6) AS "ATE_lower",
       round(quantile_cont(stat, 0.975), 6) AS "ATE_upper", count(*) AS n_boot FROM reps""")
def q_bootstrap_ci(spark, sf_dir):
    return rounded(K.bootstrap_ci(units_d(spark, sf_dir), "unit_id", N_BOOT, BOOT_SEED))


@register("bootstrap_aipw_refit", f"""WITH {X.DOC_UNITS_SQL.strip()},
bw AS (SELECT u.*, b.b, {poisson1_sql(uniform_sql('u.unit_id', str(BOOT_SEED), 'b.b'))} AS w
       FROM units u CROSS JOIN (SELECT range AS b FROM range({N_BOOT})) b),
cs AS (SELECT b, s1, s2, CAST(sum(w) AS DOUBLE) AS "W", CAST(sum(w * a) AS DOUBLE) AS sa,
              CAST(sum(w * a * y) AS DOUBLE) AS say, CAST(sum(w * (1 - a)) AS DOUBLE) AS sc,
              CAST(sum(w * (1 - a) * y) AS DOUBLE) AS scy
       FROM bw WHERE w > 0 GROUP BY b, s1, s2),
g AS (SELECT b, sum("W") AS n, sum(say) / sum(sa) AS g1, sum(scy) / sum(sc) AS g0 FROM cs GROUP BY b),
j AS (SELECT cs.*, g.n, least(greatest(sa / "W", 0.001), 0.999) AS e,
             coalesce(CASE WHEN sa > 0 THEN say / sa END, g.g1) AS m1,
             coalesce(CASE WHEN sc > 0 THEN scy / sc END, g.g0) AS m0 FROM cs JOIN g USING (b)),
reps AS (SELECT b, sum("W" * (m1 - m0) + (say - m1 * sa) / e - (scy - m0 * sc) / (1 - e)) / max(n) AS stat
         FROM j GROUP BY b)
SELECT round(avg(stat), 6) AS boot_mean, round(quantile_cont(stat, 0.025), 6) AS "ATE_lower",
       round(quantile_cont(stat, 0.975), 6) AS "ATE_upper", count(*) AS n_boot FROM reps""")
def q_bootstrap_aipw_refit(spark, sf_dir):
    return rounded(K.bootstrap_aipw_cells(units_d(spark, sf_dir), STRATA, "unit_id", N_BOOT, BOOT_SEED))


# ------------------------------------------------------------------ K22

TRIAL = (285, 895, 288, 900)      # Fixed values: the published trial's counts (deaths / patients per arm).
TRIAL_SQL = """SELECT 'reference_trial' AS estimation_method,
  round(285.0 / 895 - 288.0 / 900, 6) AS "ATE",
  round(285.0 / 895 - 288.0 / 900 - 1.96 * sqrt((285.0 / 895) * (1 - 285.0 / 895) / 895
        + (288.0 / 900) * (1 - 288.0 / 900) / 900), 6) AS "ATE_lower",
  round(285.0 / 895 - 288.0 / 900 + 1.96 * sqrt((285.0 / 895) * (1 - 285.0 / 895) / 895
        + (288.0 / 900) * (1 - 288.0 / 900) / 900), 6) AS "ATE_upper"
"""


@register("trial_benchmark", f"""{TRIAL_SQL}
UNION ALL
SELECT 'naive', round(ate, 6), round(ate - 1.96 * se, 6), round(ate + 1.96 * se, 6)
FROM (WITH {X.DOC_UNITS_SQL.strip()} SELECT {DIFF_MEANS_SQL} FROM units)""")
def q_trial_benchmark(spark, sf_dir):
    trial = K.trial_benchmark(spark, *TRIAL, "reference_trial")
    naive = K.diff_means(X.document_units(spark, sf_dir)).select(F.lit("naive").alias("estimation_method"), "ATE",
                                                         "ATE_lower", "ATE_upper")
    return rounded(trial.unionByName(naive))


# ------------------------------------------------------------------ L1-L7

@register("total_variation", f"""WITH {CELLS_SQL.replace('nu AS', 'nu0 AS')},
nu AS (SELECT * FROM nu0), xs AS (SELECT * FROM ({CROSSFIT_SQL.replace(X.DOC_UNITS_SQL.strip() + ',', 'WITH ', 1)}
  SELECT unit_id, e AS e_oof FROM xf))
SELECT round(0.5 * avg(abs(nu.e - xs.e_oof)), 6) AS total_variation FROM nu JOIN xs USING (unit_id)""")
def q_total_variation(spark, sf_dir):
    u = units_d(spark, sf_dir)
    a = cells_d(spark, sf_dir, u).select("unit_id", "e")
    b = crossfit_d(spark, sf_dir, u).select("unit_id", F.col("e").alias("e_oof"))
    return rounded(DG.total_variation(a.join(b, "unit_id"), "e", "e_oof"))


@register("ntv", f"""WITH {CELLS_SQL}, pa AS (SELECT avg(a) AS p FROM units)
SELECT round(0.5 * avg(abs(e / p - (1 - e) / (1 - p))), 6) AS ntv FROM nu, pa""")
def q_ntv(spark, sf_dir):
    return rounded(DG.normalized_total_variation(cells_d(spark, sf_dir)))


@register("ps_histogram", f"""WITH {CELLS_SQL},
h AS (SELECT a AS arm, CAST(least(floor(e * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM nu GROUP BY ALL),
t AS (SELECT a AS arm, count(*) AS tot FROM nu GROUP BY a)
SELECT arm, bin, round(bin / 10.0, 6) AS bin_start, n, round(n / tot, 6) AS frequency FROM h JOIN t USING (arm)""")
def q_ps_histogram(spark, sf_dir):
    return rounded(DG.ps_histogram(cells_d(spark, sf_dir), bins=10))


SMD_COLS = ["c_acctbal", "building", "last_code_view", "last_code_click"]


@register("smd", """WITH """ + __import__("trialframe.plans.q_events", fromlist=["x"]).OBS_EVENTS_SQL + ", "
          + __import__("trialframe.plans.q_events", fromlist=["x"]).UNITS_E_SQL + """,
piv AS (SELECT stay_id, arg_max(value, (starttime, event_id)) FILTER (WHERE code = 'view') AS last_code_view,
               arg_max(value, (starttime, event_id)) FILTER (WHERE code = 'click') AS last_code_click
        FROM obs GROUP BY stay_id),
m AS (SELECT u.intervention_status AS a, u.c_acctbal, CAST(u.building AS DOUBLE) AS building, p.last_code_view,
             p.last_code_click FROM piv p JOIN units u USING (stay_id)),
l AS (UNPIVOT m ON c_acctbal, building, last_code_view, last_code_click INTO NAME variable VALUE x)
SELECT variable, round(avg(CASE WHEN a = 1 THEN x END), 6) AS mean_treated,
  round(avg(CASE WHEN a = 0 THEN x END), 6) AS mean_control,
  round((avg(CASE WHEN a = 1 THEN x END) - avg(CASE WHEN a = 0 THEN x END))
        / sqrt((var_samp(CASE WHEN a = 1 THEN x END) + var_samp(CASE WHEN a = 0 THEN x END)) / 2), 6) AS smd
FROM l GROUP BY variable""")
def q_smd(spark, sf_dir):
    m = patient_matrix_e(spark, sf_dir, ["last"])
    return rounded(DG.smd(m.withColumnRenamed("intervention_status", "a"), SMD_COLS))


SCORES_SQL = CROSSFIT_SQL + """,
sc AS (SELECT m AS p, y FROM xf),
ds AS (SELECT p AS score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY p),
pr AS (SELECT score, pos, neg, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below
       FROM ds WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tt AS (SELECT sum(pos) AS "P", sum(neg) AS "N" FROM ds),
rk AS (SELECT sum(pos * (neg_below + 0.5 * neg)) / (max("P") * max("N")) AS roc_auc,
              sum(CASE WHEN pos > 0 THEN (pos / "P") * (("P" - pos_below) / (("P" - pos_below) + ("N" - neg_below))) END)
                AS pr_auc FROM pr, tt),
bs AS (SELECT count(*) AS n_samples, avg(CAST(y = 1 AS DOUBLE)) AS prevalence,
              avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy,
              count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
              count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y <> 1) AS tn FROM sc)"""


BINARY_SCORE_COLS = ["n_samples", "prevalence", "accuracy", "roc_auc", "pr_auc", "tn", "fp", "fn", "tp"]


@register("binary_scores", f"""WITH {SCORES_SQL}
SELECT n_samples, round(prevalence, 6) AS prevalence, round(accuracy, 6) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
  round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, tn, fp, fn, tp FROM bs, rk""")
def q_binary_scores(spark, sf_dir):
    xf = crossfit_d(spark, sf_dir).select(F.col("m").alias("p"), "y")
    return rounded(DG.binary_scores(xf, "p", "y").drop("brier"))


@register("brier", f"""WITH {CROSSFIT_SQL} SELECT round(avg((e - a) * (e - a)), 6) AS brier FROM xf""")
def q_brier(spark, sf_dir):
    return rounded(DG.brier(crossfit_d(spark, sf_dir), "e", "a"))


@register("r2_mse", f"""WITH {CROSSFIT_SQL}
SELECT round(avg((y - m) * (y - m)), 6) AS mse, round(1 - avg((y - m) * (y - m)) / var_pop(y), 6) AS r2 FROM xf""")
def q_r2_mse(spark, sf_dir):
    return rounded(DG.r2_mse(crossfit_d(spark, sf_dir), "m", "y"))


# ------------------------------------------------------------------ D10

@register("result_group_means", f"""WITH {X.DOC_UNITS_SQL.strip()},
r AS (SELECT s1, s2, avg(CASE WHEN a = 1 THEN y END) - avg(CASE WHEN a = 0 THEN y END) AS ate FROM units GROUP BY s1, s2)
SELECT s2, round(avg(ate), 6) AS mean_ate, count(ate) AS n_results FROM r GROUP BY s2""")
def q_result_group_means(spark, sf_dir):
    """Mean and number of result rows by a label of theirs (one estimate per stratum, by length band)."""
    results = K.diff_means(X.document_units(spark, sf_dir), by=STRATA)
    return rounded(results.groupBy("s2").agg(F.avg("ATE").alias("mean_ate"), F.count("ATE").alias("n_results")))
