"""Registered effect models that are fitted on a train part and applied to a test part.

Cohort D with two effect covariates: toxic and thousands of characters.  The test part is 30 % of each
arm in hash order; nuisances of the train part are cross-fitted cell means, those of the test part the
mean of the fold models.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.hashing import poisson1_sql, uniform_sql
from trialframe.operators import cate as CT
from trialframe.operators import effects as K
from trialframe.operators import features as FE
from trialframe.plans import fixtures as X
from trialframe.plans.q_effects import CROSSFIT_SQL, FOLD_SEED, N_FOLDS, STRATA, crossfit_d, units_d
from trialframe.plans.q_events import _hash_order_sql
from trialframe.plans.registry import register, rounded
from trialframe.session import cut_lineage

TEST, SPLIT_SEED, RIDGE, ALPHA = 0.3, 5, 100.0, 0.1
XC = ["toxic", "kchars"]
N_BOOT, BOOT_SEED = 50, 9


def covariates(df):
    return df.withColumns({"toxic": F.col("toxic").cast("double"), "kchars": F.col("x_len") / 1000})


def parts(spark, sf_dir):
    """Train units with out-of-fold nuisances, and test units with those averaged over the fold models."""
    sp = cut_lineage(FE.stratified_split(covariates(units_d(spark, sf_dir)), "unit_id", ["a"], TEST, seed=SPLIT_SEED))
    train = cut_lineage(FE.assign_folds(sp.filter("split = 'train'").drop("split"), "unit_id", ["a"], k=N_FOLDS, seed=FOLD_SEED))
    test = sp.filter("split = 'test'").drop("split")
    models = CT.fold_cell_models(train, STRATA, N_FOLDS)
    return K.crossfit_cell_nuisances(train, STRATA, "fold"), CT.average_cell_models(test, models, STRATA)


def residuals(df):
    return df.withColumns({"_ar": F.col("a") - F.col("e"), "_yr": F.col("y") - F.col("m")})


def finals(train):
    res = cut_lineage(residuals(train).select(*XC, "_ar", "_yr"))
    return {"linear": CT.fit_r_final(res, XC), "ridge": CT.fit_r_final(res, XC, penalty=RIDGE)}


# ------------------------------------------------------------------ SQL

def _sym(name, i, j):
    return f"{name}{min(i, j)}{max(i, j)}"


_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
# Inverse of a symmetric 3 x 3 matrix by its adjugate.
INVERSE_SQL = """d AS (SELECT *, s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02)
  + s02 * (s01 * s12 - s11 * s02) AS det FROM gl),
inv AS (SELECT *, (s11 * s22 - s12 * s12) / det AS i00, (s02 * s12 - s01 * s22) / det AS i01,
  (s01 * s12 - s02 * s11) / det AS i02, (s00 * s22 - s02 * s02) / det AS i11, (s01 * s02 - s00 * s12) / det AS i12,
  (s00 * s11 - s01 * s01) / det AS i22 FROM d),
beta AS (SELECT *, i00 * t0 + i01 * t1 + i02 * t2 AS b0, i01 * t0 + i11 * t1 + i12 * t2 AS b1,
  i02 * t0 + i12 * t1 + i22 * t2 AS b2 FROM inv)"""

SPLIT_SQL = X.DOC_UNITS_SQL.strip().replace("units AS", "units0 AS", 1) + f""",
spl AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY {_hash_order_sql('unit_id', SPLIT_SEED)}, unit_id) - 1
          < round(count(*) OVER (PARTITION BY a) * {TEST}) AS is_test FROM units0),
units AS (SELECT * FROM spl WHERE NOT is_test)""" + CROSSFIT_SQL[len(X.DOC_UNITS_SQL.strip()):]

_left = ", ".join(f"st.{c} - coalesce(sf.{c}, 0) AS o_{c}" for c in CT.SUMS)
AVERAGE_SQL = SPLIT_SQL + f""",
st AS (SELECT s1, s2, {', '.join(f'sum({c}) AS {c}' for c in CT.SUMS)} FROM sf GROUP BY s1, s2),
fm AS (SELECT st.s1, st.s2, f.fold, {_left} FROM st CROSS JOIN (SELECT fold FROM tf) f
       LEFT JOIN sf ON sf.s1 IS NOT DISTINCT FROM st.s1 AND sf.s2 IS NOT DISTINCT FROM st.s2 AND sf.fold = f.fold),
fe AS (SELECT s1, s2, CASE WHEN o_n > 0 THEN o_na / o_n ELSE t_na / t_n END AS e,
              CASE WHEN o_na > 0 THEN o_y1 / o_na ELSE t_y1 / t_na END AS m1,
              CASE WHEN o_n - o_na > 0 THEN o_y0 / (o_n - o_na) ELSE t_y0 / (t_n - t_na) END AS m0,
              CASE WHEN o_n > 0 THEN o_yy / o_n ELSE t_yy / t_n END AS m FROM fm JOIN tf USING (fold)),
fp AS (SELECT s1, s2, avg(e) AS e, avg(m1) AS m1, avg(m0) AS m0, avg(m) AS m FROM fe GROUP BY s1, s2),
fo AS (SELECT avg(t_na / t_n) AS e, avg(t_y1 / t_na) AS m1, avg(t_y0 / (t_n - t_na)) AS m0, avg(t_yy / t_n) AS m FROM tf),
te AS (SELECT u.unit_id, u.a, u.y, u.toxic AS x1, u.x_len / 1000 AS x2, coalesce(fp.e, fo.e) AS e,
              coalesce(fp.m1, fo.m1) AS m1, coalesce(fp.m0, fo.m0) AS m0, coalesce(fp.m, fo.m) AS m
       FROM (SELECT * FROM spl WHERE is_test) u LEFT JOIN fp
         ON fp.s1 IS NOT DISTINCT FROM u.s1 AND fp.s2 IS NOT DISTINCT FROM u.s2 CROSS JOIN fo)"""

HOLDOUT_SQL = AVERAGE_SQL + f""",
r AS (SELECT a - e AS z0, (a - e) * toxic AS z1, (a - e) * x_len / 1000 AS z2, y - m AS t FROM xf),
g AS (SELECT {', '.join(f'sum(z{i} * z{j}) AS s{i}{j}' for i, j in _PAIRS)},
             {', '.join(f'sum(z{i} * t) AS t{i}' for i in range(3))} FROM r),
gl AS (SELECT final, s00, s01, s02, s11 + lam AS s11, s12, s22 + lam AS s22, t0, t1, t2
       FROM g CROSS JOIN (VALUES ('linear', 0.0::DOUBLE), ('ridge', {RIDGE}::DOUBLE)) p(final, lam)),
{INVERSE_SQL},
rr AS (SELECT final, z0, z1, z2, pow(t - b0 * z0 - b1 * z1 - b2 * z2, 2) AS r2 FROM r CROSS JOIN beta),
mt AS (SELECT final, {', '.join(f'sum(z{i} * z{j} * r2) AS q{i}{j}' for i, j in _PAIRS)} FROM rr GROUP BY final),
fit AS (SELECT final, b0, b1, b2, {', '.join(
    '(' + ' + '.join(f"{_sym('i', i, k)} * {_sym('q', k, l)} * {_sym('i', l, j)}" for k in range(3) for l in range(3))
    + f') AS v{i}{j}' for i, j in _PAIRS)} FROM beta JOIN mt USING (final)),
ap AS (SELECT unit_id, final, a - e AS ar, y - m AS yr, b0 + b1 * x1 + b2 * x2 AS cate,
         sqrt(v00 + 2 * v01 * x1 + 2 * v02 * x2 + v11 * x1 * x1 + 2 * v12 * x1 * x2 + v22 * x2 * x2) AS se
       FROM te CROSS JOIN fit)"""


# ------------------------------------------------------------------ K19, K13-K15

@register("fold_average_predictions", f"""WITH {AVERAGE_SQL}
SELECT unit_id, round(e, 6) AS e, round(m1, 6) AS m1, round(m0, 6) AS m0, round(m, 6) AS m FROM te""")
def q_fold_average_predictions(spark, sf_dir):
    """Mean predictions of the train part's fold models for the units of the test part."""
    return rounded(parts(spark, sf_dir)[1].select("unit_id", "e", "m1", "m0", "m"))


@register("cate_holdout", f"""WITH {HOLDOUT_SQL}
SELECT unit_id, final, round(cate, 6) AS cate, round(cate - 1.6448536269514722 * se, 6) AS cate_lb,
       round(cate + 1.6448536269514722 * se, 6) AS cate_ub FROM ap""")
def q_cate_holdout(spark, sf_dir):
    """Linear and ridge effect models of the train part, applied to the test part with intervals."""
    train, test = parts(spark, sf_dir)
    out = [m.apply(test, ALPHA).select("unit_id", F.lit(n).alias("final"), "cate", "cate_lb", "cate_ub")
           for n, m in finals(train).items()]
    return rounded(out[0].unionByName(out[1]))


@register("cate_holdout_score", f"""WITH {HOLDOUT_SQL}
SELECT final, count(*) AS n, round(avg(pow(yr - cate * ar, 2)), 6) AS cate_score FROM ap GROUP BY final""")
def q_cate_holdout_score(spark, sf_dir):
    """R-loss of the fitted effect models on the test part."""
    train, test = parts(spark, sf_dir)
    res = residuals(test)
    out = [res.groupBy().agg(F.lit(n).alias("final"), F.count(F.lit(1)).alias("n"),
                             F.avg((F.col("_yr") - m.effect() * F.col("_ar")) ** 2).alias("cate_score"))
           for n, m in finals(train).items()]
    return rounded(out[0].unionByName(out[1]))


@register("cate_holdout_forest")
def q_cate_holdout_forest(spark, sf_dir):
    """Forest effect model of the train part, applied to the test part."""
    train, test = parts(spark, sf_dir)
    res = residuals(train).select("unit_id", *XC, "_ar", "_yr")
    return rounded(CT.fit_r_forest(res, XC, "unit_id").apply(test, ALPHA).select("unit_id", "cate", "cate_lb", "cate_ub"))


# ------------------------------------------------------------------ K9

_w = poisson1_sql(uniform_sql('u.unit_id', str(BOOT_SEED), 'b.b - 1'))
_o = ", ".join(f"sum({c}) OVER (PARTITION BY b, s1, s2) - {c} AS o_{c}" for c in CT.SUMS)
_t = ", ".join(f"sum({c}) OVER (PARTITION BY b) - {c} AS t_{c}" for c in CT.SUMS)
_sw = ("CAST(sum(w) AS DOUBLE) AS n, CAST(sum(w * a) AS DOUBLE) AS na, CAST(sum(w * a * y) AS DOUBLE) AS y1, "
       "CAST(sum(w * (1 - a) * y) AS DOUBLE) AS y0, CAST(sum(w * y) AS DOUBLE) AS yy")


@register("dr_final", f"""WITH {CROSSFIT_SQL},
bw AS (SELECT u.unit_id, u.s1, u.s2, u.a, u.y, u.fold, 1.0 AS z0, u.toxic AS z1, u.x_len / 1000 AS z2, b.b,
              CASE WHEN b.b = 0 THEN 1 ELSE {_w} END AS w
       FROM folds u CROSS JOIN (SELECT range AS b FROM range({N_BOOT + 1})) b),
bp AS (SELECT * FROM bw WHERE w > 0),
bc AS (SELECT b, s1, s2, fold, {_o} FROM (SELECT b, s1, s2, fold, {_sw} FROM bp GROUP BY b, s1, s2, fold)),
bt AS (SELECT b, fold, {_t} FROM (SELECT b, fold, {_sw} FROM bp GROUP BY b, fold)),
bn AS (SELECT b, s1, s2, fold, least(greatest(CASE WHEN o_n > 0 THEN o_na / o_n ELSE t_na / t_n END, 0.001), 0.999) AS e,
         CASE WHEN o_na > 0 THEN o_y1 / o_na ELSE t_y1 / t_na END AS m1,
         CASE WHEN o_n - o_na > 0 THEN o_y0 / (o_n - o_na) ELSE t_y0 / (t_n - t_na) END AS m0 FROM bc JOIN bt USING (b, fold)),
ps AS (SELECT b, w, z0, z1, z2, m1 - m0 + a * (y - m1) / e - (1 - a) * (y - m0) / (1 - e) AS psi
       FROM bp JOIN bn USING (b, s1, s2, fold)),
gl AS (SELECT b, {', '.join(f'sum(w * z{i} * z{j}) AS s{i}{j}' for i, j in _PAIRS)},
              {', '.join(f'sum(w * z{i} * psi) AS t{i}' for i in range(3))} FROM ps GROUP BY b),
{INVERSE_SQL},
lg AS (SELECT b, 'intercept' AS term, b0 AS v FROM beta UNION ALL SELECT b, 'toxic', b1 FROM beta
       UNION ALL SELECT b, 'kchars', b2 FROM beta)
SELECT term, round(max(v) FILTER (WHERE b = 0), 6) AS coef, round(quantile_cont(v, 0.025) FILTER (WHERE b > 0), 6) AS lower,
       round(quantile_cont(v, 0.975) FILTER (WHERE b > 0), 6) AS upper FROM lg GROUP BY term""")
def q_dr_final(spark, sf_dir):
    """K9: final model of the DR learner on the effect covariates, with refitting intervals."""
    u = covariates(FE.assign_folds(units_d(spark, sf_dir), "unit_id", ["a"], k=N_FOLDS, seed=FOLD_SEED))
    return rounded(CT.dr_final_cells(u, STRATA, XC, "unit_id", "fold", N_BOOT, BOOT_SEED).table(spark))
