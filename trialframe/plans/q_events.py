"""Registered event-extraction (I) and feature-engineering (J) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.time import shift
from trialframe.operators import events as EV
from trialframe.operators import features as FE
from trialframe.operators import relational as R
from trialframe.plans import fixtures as X
from trialframe.plans.q_cohort import POP_E_SQL, cohort_e_population
from trialframe.plans.q_primitives import E_CODES, OBS_EVENTS_SQL, _obs_events_spark, _pivot_sql
from trialframe.plans.registry import register, rounded
from trialframe.sources.io import read_table

sec = X.sec_sql
EV_COLS = "subject_id, hadm_id, stay_id, starttime, endtime, domain, code, label, value"


def _T(spark, sf_dir, n):
    return read_table(spark, sf_dir, n)


# ------------------------------------------------------------------ I1

@register("measurement_events", f"""WITH {X.ORDER_LINES_SQL.strip()}
SELECT subject_id, hadm_id, stay_id, starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'lineitem' AS domain,
       code, code AS label, value
FROM (UNPIVOT (SELECT subject_id, hadm_id, stay_id, l_shipdate AS starttime, l_quantity, l_extendedprice, l_tax
               FROM olines) ON l_quantity, l_extendedprice, l_tax INTO NAME code VALUE value)
WHERE value IS NOT NULL""")
def q_measurement_events(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir)
    return EV.measurement_events(lines, ["subject_id", "hadm_id", "stay_id"], "l_shipdate",
                                 ["l_quantity", "l_extendedprice", "l_tax"], domain="lineitem")


# ------------------------------------------------------------------ I2

DRUG_CLASSES = {"fastener": ["bolt", "gear"], "round": ["ring", "wheel"], "red": ["^red"]}


def _class_sql():
    parts = []
    for cls, pats in DRUG_CLASSES.items():
        pat = "|".join(pats)
        parts.append(f"""SELECT o.subject_id, o.hadm_id, o.stay_id, o.l_shipdate AS starttime,
  CAST(NULL AS TIMESTAMP) AS endtime, 'medication' AS domain, '{cls}' AS code, p.p_name AS label, o.l_quantity AS value
FROM olines o JOIN part p ON p.p_partkey = o.l_partkey WHERE regexp_matches(lower(p.p_name), '{pat}')""")
    return "\nUNION ALL\n".join(parts)


@register("drug_class_events", f"WITH {X.ORDER_LINES_SQL.strip()}\n{_class_sql()}")
def q_drug_class_events(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir).join(
        _T(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return EV.drug_class_events(lines, "p_name", DRUG_CLASSES, ["subject_id", "hadm_id", "stay_id"], "l_shipdate",
                                value=F.col("l_quantity"))


# ------------------------------------------------------------------ I4/I6

@register("interval_events", f"""WITH {X.ORDER_LINES_SQL.strip()}
SELECT subject_id, hadm_id, stay_id, intime AS starttime, l_shipdate AS endtime, 'interval' AS domain,
       'shipping' AS code, 'shipping' AS label, l_quantity AS value FROM olines
UNION ALL
SELECT subject_id, hadm_id, stay_id, l_shipdate, l_shipdate, 'procedure', 'open_line', 'open_line',
       CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END FROM olines""")
def q_interval_events(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir)
    keys = ["subject_id", "hadm_id", "stay_id"]
    a = EV.interval_events(lines, keys, "intime", "l_shipdate", "l_quantity", "shipping", "interval")
    b = EV.interval_events(lines, keys, "l_shipdate", None,
                           F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0), "open_line", "procedure")
    return R.union_all([a, b])


# ------------------------------------------------------------------ I5

SCORE_SQL = """SELECT s.subject_id, s.hadm_id, s.stay_id, s.intime AS starttime, s.intime + INTERVAL 1 DAY AS endtime,
  'score' AS domain, 'acctbal_score' AS code, 'acctbal_score' AS label, c.c_acctbal AS value
FROM stays s JOIN customer c ON c.c_custkey = s.subject_id"""


def _score_events(spark, sf_dir, stays=None):
    """First-day score events for ``stays`` (default: every stay)."""
    st = (stays if stays is not None else X.stays(spark, sf_dir)).select("subject_id", "hadm_id", "stay_id", "intime")
    cust = _T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_acctbal")
    return EV.first_day_score_events(cust, st, "subject_id", "c_acctbal", "acctbal_score")


@register("score_events", f"WITH {X.STAYS_SQL} {SCORE_SQL}")
def q_score_events(spark, sf_dir):
    return _score_events(spark, sf_dir)


# ------------------------------------------------------------------ I7

@register("any_agent_events", f"""WITH {X.ORDER_LINES_SQL.strip()}
SELECT subject_id, hadm_id, stay_id, l_shipdate AS starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'drug' AS domain,
  'vasopressors' AS code, label, CASE WHEN rate > 0 THEN 1.0 ELSE 0.0 END AS value
FROM (UNPIVOT (SELECT subject_id, hadm_id, stay_id, l_shipdate, l_discount, l_tax FROM olines)
      ON l_discount, l_tax INTO NAME label VALUE rate)
WHERE rate IS NOT NULL""")
def q_any_agent_events(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir)
    return EV.any_agent_events(lines, ["subject_id", "hadm_id", "stay_id"], "l_shipdate", ["l_discount", "l_tax"])


# ------------------------------------------------------------------ I8

INFECTION_SQL = """SELECT hadm_id, ts AS starttime, 'observation' AS domain, 'suspected_infection' AS code,
  'suspected_infection' AS label, 1.0 AS value
FROM kev WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50"""


def _infection_events(spark, sf_dir):
    """Suspected infection: an ``error`` with a 'positive' payload; the stay
    key is dropped so the admission key joins it to the population."""
    kev = X.keyed_events(spark, sf_dir)
    pos = kev.filter((F.col("event_type") == "error") &
                     (F.get_json_object("props", "$.k").cast("int") > 50))
    ev = pos.select("hadm_id", F.col("ts").alias("starttime"), F.lit("suspected_infection").alias("code"),
                    F.lit("suspected_infection").alias("label"), F.lit(1.0).alias("value"))
    return R.to_event_schema(ev, domain="observation").drop("subject_id", "stay_id")


@register("observation_events", f"""WITH {POP_E_SQL}, inf AS ({INFECTION_SQL})
SELECT p.subject_id, i.hadm_id, p.stay_id, i.starttime, CAST(NULL AS TIMESTAMP) AS endtime, i.domain, i.code,
       i.label, i.value
FROM inf i JOIN pop p ON p.hadm_id = i.hadm_id WHERE i.starttime <= p.inclusion_start""")
def q_observation_events(spark, sf_dir):
    return R.observation_window(_infection_events(spark, sf_dir), cohort_e_population(spark, sf_dir))


# ------------------------------------------------------------------ I11

COVARIATES_SQL = POP_E_SQL + f""",
inf AS ({INFECTION_SQL}),
src AS (
  SELECT subject_id, hadm_id, stay_id, ts AS starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'events' AS domain,
         event_type AS code, event_type AS label, value FROM kev
  UNION ALL {SCORE_SQL}
),
obs_all AS (
  SELECT e.subject_id, e.hadm_id, e.stay_id, e.starttime, e.endtime, e.domain, e.code, e.label, e.value
  FROM src e JOIN pop p ON p.stay_id = e.stay_id WHERE e.starttime <= p.inclusion_start
  UNION ALL
  SELECT p.subject_id, i.hadm_id, p.stay_id, i.starttime, CAST(NULL AS TIMESTAMP), i.domain, i.code, i.label, i.value
  FROM inf i JOIN pop p ON p.hadm_id = i.hadm_id WHERE i.starttime <= p.inclusion_start
),
covariates AS (SELECT {EV_COLS} FROM obs_all GROUP BY ALL HAVING count(*) = 1)"""


def covariate_events_e(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    raw = kev.select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"), F.lit("events").alias("domain"),
                     F.col("event_type").alias("code"), F.col("event_type").alias("label"), "value")
    pop = cohort_e_population(spark, sf_dir)
    # only population stays survive the observation window: their scores are
    # built from the population itself (no second aggregation of the events)
    return EV.covariate_events([raw, _score_events(spark, sf_dir, pop), _infection_events(spark, sf_dir)], pop)


ORDER_FLAGS = {"urgent": "o_orderpriority = '1-URGENT'", "high": "o_orderpriority = '2-HIGH'", "open": "o_orderstatus = 'O'",
               "large": "o_totalprice > 200000"}


@register("flag_events", " UNION ALL ".join(f"""
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey AS stay_id, o_orderdate AS starttime,
  CAST(NULL AS TIMESTAMP) AS endtime, 'comorbidity' AS domain, '{c}' AS code, '{c}' AS label,
  CASE WHEN {e} THEN 1.0 ELSE 0.0 END AS value FROM orders WHERE ({e}) OR '{c}' = 'large'""" for c, e in ORDER_FLAGS.items()))
def q_flag_events(spark, sf_dir):
    """Wide 0/1 flags to events; zeros go but for the index column."""
    od = _T(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"),
        "o_orderdate", *[F.expr(f"CASE WHEN {e} THEN 1 ELSE 0 END").alias(c) for c, e in ORDER_FLAGS.items()])
    return EV.flag_events(od, ["subject_id", "hadm_id", "stay_id"], "o_orderdate", list(ORDER_FLAGS), keep_zero=["large"])


@register("covariate_events", f"WITH {COVARIATES_SQL} SELECT * FROM covariates")
def q_covariate_events(spark, sf_dir):
    return covariate_events_e(spark, sf_dir)


# ------------------------------------------------------------------ I12-I14

@register("static_features", """SELECT o.o_orderkey AS stay_id,
  CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS emergency,
  CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'HOUSEHOLD') THEN 1 ELSE 0 END AS public_insurance,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS "Female",
  CASE WHEN contains(lower(r.r_name), 'europe') THEN 1 ELSE 0 END AS "White"
FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_static_features(spark, sf_dir):
    st = X.order_stays(spark, sf_dir)
    cust = _T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment", "c_nationkey")
    nat = _T(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    reg = _T(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    units = st.join(cust, "subject_id", "left").join(nat, "c_nationkey", "left").join(reg, "n_regionkey", "left")
    out = EV.static_flags(units, {
        "emergency": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
        "public_insurance": F.col("c_mktsegment").isin("AUTOMOBILE", "HOUSEHOLD"),
        "Female": F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
        "White": F.lower("r_name").contains("europe"),
    })
    return out.select("stay_id", "emergency", "public_insurance", "Female", "White")


# ------------------------------------------------------------------ I15

@register("composite_flag", f"""WITH {POP_E_SQL},
u AS (SELECT DISTINCT subject_id FROM pop),
a AS (SELECT DISTINCT subject_id FROM kev WHERE event_type = 'signup'),
b AS (SELECT DISTINCT subject_id FROM kev WHERE event_type = 'purchase' AND value > 50),
c AS (SELECT DISTINCT subject_id FROM kev WHERE event_type = 'click' AND value >= 400)
SELECT u.subject_id, CASE WHEN u.subject_id IN (SELECT subject_id FROM a) AND u.subject_id IN (SELECT subject_id FROM b)
  AND u.subject_id IN (SELECT subject_id FROM c) THEN 1 ELSE 0 END AS septic_shock FROM u""")
def q_composite_flag(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    units = cohort_e_population(spark, sf_dir).select("subject_id").distinct()
    comps = {
        "sepsis": kev.filter(F.col("event_type") == "signup"),
        "vasopressor": kev.filter((F.col("event_type") == "purchase") & (F.col("value") > 50)),
        "lactate": kev.filter((F.col("event_type") == "click") & (F.col("value") >= 400)),
    }
    return EV.composite_flag(units, "subject_id", comps, "septic_shock")


# ------------------------------------------------------------------ I16

@register("followup_variants", f"""WITH {POP_E_SQL},
v AS (
  SELECT p.stay_id, 'full_stay' AS variant, s.outtime AS obs_end FROM pop p JOIN stays s USING (stay_id)
  UNION ALL SELECT stay_id, 'first_24h', intime + INTERVAL 24 HOUR FROM pop
  UNION ALL SELECT stay_id, 'until_intervention', coalesce(intervention_start, inclusion_start) FROM pop
)
SELECT v.stay_id, v.variant, count(*) AS n_events FROM v JOIN kev k ON k.stay_id = v.stay_id
WHERE k.ts <= v.obs_end GROUP BY v.stay_id, v.variant""")
def q_followup_variants(spark, sf_dir):
    pop = cohort_e_population(spark, sf_dir).join(X.stays(spark, sf_dir).select("stay_id", "outtime"), "stay_id")
    var = EV.followup_variants(pop, {
        "full_stay": F.col("outtime"),
        "first_24h": shift("intime", hours=24),
        "until_intervention": F.coalesce("intervention_start", "inclusion_start"),
    })
    kev = X.keyed_events(spark, sf_dir).select("stay_id", "ts")
    return (var.select("stay_id", "variant", "obs_end").join(kev, "stay_id")
               .filter(F.col("ts") <= F.col("obs_end"))
               .groupBy("stay_id", "variant").agg(F.count(F.lit(1)).alias("n_events")))


# ------------------------------------------------------------------ J1-J5

UNITS_E_SQL = """units AS (SELECT p.stay_id, p.intervention_status, p.mortality_1day, c.c_acctbal,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building, c.c_mktsegment
  FROM pop p LEFT JOIN customer c ON c.c_custkey = p.subject_id)"""


def units_e(spark, sf_dir, pop=None):
    pop = pop if pop is not None else cohort_e_population(spark, sf_dir)
    cust = _T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_acctbal", "c_mktsegment")
    return (pop.join(cust, "subject_id", "left")
               .select("stay_id", "intervention_status", "mortality_1day", "c_acctbal",
                       F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("building"),
                       "c_mktsegment"))


def patient_matrix_e(spark, sf_dir, aggs=("first", "last"), pop=None):
    ev = _obs_events_spark(spark, sf_dir, pop)
    return FE.patient_matrix(ev, units_e(spark, sf_dir, pop), E_CODES, list(aggs), order=["starttime", "event_id"])


@register("patient_matrix", f"""WITH {OBS_EVENTS_SQL}, {UNITS_E_SQL},
piv AS (SELECT stay_id, {_pivot_sql(['first', 'last'])} FROM obs GROUP BY stay_id)
SELECT piv.*, round(units.c_acctbal, 6) AS c_acctbal, units.intervention_status, units.mortality_1day,
       units.building, units.c_mktsegment FROM piv JOIN units USING (stay_id)""")
def q_patient_matrix(spark, sf_dir):
    return rounded(patient_matrix_e(spark, sf_dir))


TYPED_RULES = {"max": ["view"], "median": ["click"], "last": ["purchase"], "sum": ["signup"], "min": ["error"]}


@register("typed_aggregation", f"""WITH {OBS_EVENTS_SQL}
SELECT stay_id, round(max(value) FILTER (WHERE code = 'view'), 6) AS view,
  round(median(value) FILTER (WHERE code = 'click'), 6) AS click,
  round(arg_max(value, (starttime, event_id)) FILTER (WHERE code = 'purchase'), 6) AS purchase,
  round(sum(value) FILTER (WHERE code = 'signup'), 6) AS signup,
  round(min(value) FILTER (WHERE code = 'error'), 6) AS error
FROM obs GROUP BY stay_id""")
def q_typed_aggregation(spark, sf_dir):
    ev = _obs_events_spark(spark, sf_dir)
    return rounded(FE.typed_aggregation(ev, "stay_id", TYPED_RULES, order=["starttime", "event_id"]))


PERIOD_CODES = ["view", "click"]
PERIODS = FE.PERIOD_SETS["all"]


PERIOD_SQL = {"min": "min({v})", "max": "max({v})", "mean": "avg({v})", "std": "stddev_samp({v})",
              "count": "nullif(count({v}), 0)"}


def _period_sql():
    """First p %: 100 (t - start) <= p (end - start); last p %: 100 (end - t) <= p (end - start); whole seconds."""
    cols = []
    for code in PERIOD_CODES:
        for p in PERIODS:
            side = "elapsed" if p > 0 else "remaining"
            v = f"CASE WHEN code = '{code}' AND 100 * {side} <= {abs(p)} * (elapsed + remaining) THEN value END"
            cols += [f'round({x.format(v=v)}, 6) AS "{a}_code_{code}__p{p}"' if a != "count"
                     else f'{x.format(v=v)} AS "{a}_code_{code}__p{p}"' for a, x in PERIOD_SQL.items()]
    codes = ", ".join(f"'{c}'" for c in PERIOD_CODES)
    return f"""mine AS (SELECT *, min(starttime) OVER w AS t0, max(starttime) OVER w AS t1
  FROM obs WHERE code IN ({codes}) WINDOW w AS (PARTITION BY stay_id)),
placed AS (SELECT stay_id, code, value, epoch_us(starttime - t0) // 1000000 AS elapsed,
  epoch_us(t1 - t0) // 1000000 - epoch_us(starttime - t0) // 1000000 AS remaining FROM mine)
SELECT stay_id, {", ".join(cols)} FROM placed GROUP BY stay_id"""


@register("relative_period_agg", f"WITH {OBS_EVENTS_SQL}, {_period_sql()}")
def q_relative_period_agg(spark, sf_dir):
    ev = _obs_events_spark(spark, sf_dir)
    return rounded(FE.relative_period_aggregation(ev, "all", unit_key="stay_id", vocabulary=PERIOD_CODES))


@register("feature_subset", f"""WITH {OBS_EVENTS_SQL}
SELECT subject_id, stay_id, starttime, code, value FROM obs WHERE code IN ('view', 'click')""")
def q_feature_subset(spark, sf_dir):
    ev = _obs_events_spark(spark, sf_dir)
    return FE.feature_subset(ev, ["view", "click"]).select("subject_id", "stay_id", "starttime", "code", "value")


@register("normalise_by_weight", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  round(l.l_extendedprice / coalesce(CASE WHEN p.p_size > 10 THEN CAST(p.p_size AS DOUBLE) END, 70.0), 6) AS price_per_weight
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""")
def q_normalise_by_weight(spark, sf_dir):
    li = _T(spark, sf_dir, "lineitem")
    part = _T(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"),
                                            F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("weight"))
    j = li.join(part, "l_partkey")
    out = FE.normalise_by_weight(j, "l_extendedprice", "weight", 70.0, "price_per_weight")
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_per_weight"))


# ------------------------------------------------------------------ J6-J8

@register("standardise", """SELECT c_custkey,
  round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal,
  round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) AS c_nationkey
FROM customer""")
def q_standardise(spark, sf_dir):
    c = _T(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double"))
    return rounded(FE.standardise(c, ["c_acctbal", "c_nationkey"]))


@register("impute_median", f"""WITH {OBS_EVENTS_SQL}, {UNITS_E_SQL},
piv AS (SELECT stay_id, {_pivot_sql(['last'])} FROM obs GROUP BY stay_id),
m AS (SELECT piv.* FROM piv JOIN units USING (stay_id))
SELECT stay_id, round(coalesce(last_code_click, median(last_code_click) OVER ()), 6) AS last_code_click,
  round(coalesce(last_code_purchase, median(last_code_purchase) OVER ()), 6) AS last_code_purchase FROM m""")
def q_impute_median(spark, sf_dir):
    m = patient_matrix_e(spark, sf_dir, ["last"]).select("stay_id", "last_code_click", "last_code_purchase")
    return rounded(FE.impute_median(m, ["last_code_click", "last_code_purchase"]))


@register("design_matrix", f"""WITH {OBS_EVENTS_SQL}, {UNITS_E_SQL},
piv AS (SELECT stay_id, {_pivot_sql(['last'])} FROM obs GROUP BY stay_id),
m AS (SELECT piv.*, units.* EXCLUDE (stay_id) FROM piv JOIN units USING (stay_id)),
z AS (SELECT *, (last_code_click - avg(last_code_click) OVER ()) / stddev_pop(last_code_click) OVER () AS zc,
             (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS za FROM m)
SELECT stay_id, round(coalesce(zc, median(zc) OVER ()), 6) AS last_code_click,
  round(coalesce(za, median(za) OVER ()), 6) AS c_acctbal, coalesce(building, 0) AS building,
  {", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])}
FROM z""")
def q_design_matrix(spark, sf_dir):
    m = patient_matrix_e(spark, sf_dir, ["last"])
    return rounded(FE.design_matrix(m, numerical=["last_code_click", "c_acctbal"], binary=["building"],
                                    categorical={"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE",
                                                                  "HOUSEHOLD", "MACHINERY"]},
                                    passthrough=["stay_id"]))


# ------------------------------------------------------------------ J9-J11

def _hash_order_sql(id_col, seed):
    return f"('0x' || substr(md5(concat_ws('|', CAST({id_col} AS VARCHAR), '{seed}')), 1, 8))::BIGINT"


@register("stratified_split", f"""WITH {X.DOC_UNITS_SQL.strip()},
r AS (SELECT unit_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash_order_sql('unit_id', 0)}, unit_id) - 1 AS rk,
             count(*) OVER (PARTITION BY y) AS n FROM units)
SELECT unit_id, y, CASE WHEN rk < round(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM r""")
def q_stratified_split(spark, sf_dir):
    u = X.document_units(spark, sf_dir).select("unit_id", "y")
    return FE.stratified_split(u, "unit_id", ["y"], 0.3, seed=0)


@register("assign_folds", f"""WITH {X.DOC_UNITS_SQL.strip()}
SELECT unit_id, a, CAST((row_number() OVER (PARTITION BY a ORDER BY {_hash_order_sql('unit_id', 7)}, unit_id) - 1) % 5
  AS INTEGER) AS fold FROM units""")
def q_assign_folds(spark, sf_dir):
    u = X.document_units(spark, sf_dir).select("unit_id", "a")
    return FE.assign_folds(u, "unit_id", ["a"], k=5, seed=7)


@register("check_binary_treatment", f"""WITH {X.DOC_UNITS_SQL.strip()}
SELECT a AS treatment, count(*) AS n FROM units GROUP BY a""")
def q_check_binary_treatment(spark, sf_dir):
    return FE.check_binary_treatment(X.document_units(spark, sf_dir), "a")
