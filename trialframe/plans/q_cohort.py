"""Registered cohort-framing queries (H1-H16) on the fixture cohorts."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import functions as F

from trialframe.functions.time import seconds_between
from trialframe.operators import cohort as C
from trialframe.operators import relational as R
from trialframe.operators.relational import except_set, intersect_all_sets
from trialframe.plans import fixtures as X
from trialframe.plans.registry import register, rounded
from trialframe.session import cut_lineage
from trialframe.sources.io import read_table

W_E = X.COHORT_E_WINDOW_DAYS
W_E_SEC = W_E * 86400.0
sec = X.sec_sql


# ------------------------------------------------------------ shared builders

def cohort_e_population(spark, sf_dir, window_days: float = W_E, extra_criteria=None):
    """Flagship cohort (H6): first ``view`` in the window -> criteria roll ->
    first ``purchase`` -> death (first ``error``) -> 1-day / 3-day outcomes.

    The stay table, the first view and the first purchase come from one
    aggregation over the events; the errors are read once more for the death
    date.  Extra criteria (frames of ``stay_id``) are rolled in by inner joins.
    """
    # one row per stay, read by three branches (inclusion, later-stay death
    # date, own-stay death date): materialised once in the shared checkpoint
    # folder so the events are not re-aggregated per branch
    st = cut_lineage(X.stays(spark, sf_dir, firsts={"_first_view": F.col("event_type") == "view",
                                                    "_first_trt": F.col("event_type") == "purchase"}))
    pop = C.include_in_window(st, "_first_view", window_days)
    if extra_criteria:
        criteria = OrderedDict(extra_criteria)
        criteria[C.INCLUSION_EVENT] = pop.select("stay_id", "inclusion_start")
        pop, _ = C.roll_inclusion(st.drop("_first_view"), criteria)
    pop = C.assign_from_first(pop, "_first_trt", window_days)
    pop = X.death_after(spark, sf_dir, pop.drop("dod", "_err_min"))
    pop = C.outcome_horizon(pop, {"mortality_1day": 1, "mortality_3days": 3})
    return pop.select("subject_id", "hadm_id", "stay_id", "intime", "inclusion_start",
                      "intervention_start", "intervention_status", "dod",
                      "mortality_1day", "mortality_3days")


POP_E_SQL = X.STAYS_SQL + f""",
incl AS (
  SELECT s.subject_id, s.hadm_id, s.stay_id, s.intime, f.inclusion_start
  FROM stays s JOIN (SELECT stay_id, min(ts) AS inclusion_start FROM kev WHERE event_type = 'view'
                     GROUP BY stay_id) f USING (stay_id)
  WHERE {sec('f.inclusion_start', 's.intime')} BETWEEN 0 AND {W_E_SEC}
),
trt AS (SELECT stay_id, min(ts) AS first_trt FROM kev WHERE event_type = 'purchase' GROUP BY stay_id),
pop0 AS (
  SELECT i.*,
         CASE WHEN {sec('t.first_trt', 'i.intime')} BETWEEN 0 AND {W_E_SEC}
               AND t.first_trt > i.inclusion_start THEN t.first_trt END AS intervention_start,
         (SELECT min(e.ts) FROM kev e WHERE e.subject_id = i.subject_id AND e.event_type = 'error'
            AND e.ts >= i.inclusion_start) AS dod
  FROM incl i LEFT JOIN trt t USING (stay_id)
),
pop AS (
  SELECT subject_id, hadm_id, stay_id, intime, inclusion_start, intervention_start,
         CAST(intervention_start IS NOT NULL AS INTEGER) AS intervention_status, dod,
         CAST(dod IS NOT NULL AND floor({sec('dod', 'inclusion_start')} / 86400) <= 1 AS INTEGER) AS mortality_1day,
         CAST(dod IS NOT NULL AND floor({sec('dod', 'inclusion_start')} / 86400) <= 3 AS INTEGER) AS mortality_3days
  FROM pop0
)"""


@register("target_population", f"WITH {POP_E_SQL} SELECT * FROM pop")
def q_target_population(spark, sf_dir):
    return cohort_e_population(spark, sf_dir)


@register("inclusion_event", f"WITH {POP_E_SQL} SELECT stay_id, inclusion_start FROM incl")
def q_inclusion_event(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    st = X.stays(spark, sf_dir)
    views = kev.filter(F.col("event_type") == "view").select("stay_id", F.col("ts").alias("starttime"), "event_id")
    return C.first_event_in_window(views, st, W_E, tiebreak=["event_id"])


@register("assign_intervention",
          f"WITH {POP_E_SQL} SELECT stay_id, intervention_start, intervention_status FROM pop")
def q_assign_intervention(spark, sf_dir):
    return cohort_e_population(spark, sf_dir).select("stay_id", "intervention_start", "intervention_status")


@register("outcome_horizon",
          f"WITH {POP_E_SQL} SELECT stay_id, dod, mortality_1day, mortality_3days FROM pop")
def q_outcome_horizon(spark, sf_dir):
    return cohort_e_population(spark, sf_dir).select("stay_id", "dod", "mortality_1day", "mortality_3days")


# ------------------------------------------------------------ H1

BASE_SQL = X.STAY_DETAIL_SQL + f""",
bp0 AS (
  SELECT * FROM stay_detail WHERE first_icu_stay AND admission_age >= 0
  QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY icu_intime, stay_id) = 1
),
base AS (
  SELECT subject_id, hadm_id, stay_id, icu_intime, intime, outtime, first_icu_stay,
         round(admission_age, 6) AS admission_age, gender, race, c_mktsegment, dod,
         round(los_icu, 6) AS los_icu,
         CASE WHEN gender = 'F' THEN 1 ELSE 0 END AS "Female",
         CASE WHEN lower(race) LIKE '%europe%' THEN 1 ELSE 0 END AS "White"
  FROM bp0
  WHERE los_icu >= 1 AND ({sec('dod', 'icu_intime')} / 3600.0 >= 24 OR dod IS NULL)
)"""


def base_population_e(spark, sf_dir):
    return C.base_population(X.stay_detail(spark, sf_dir), min_age=0, min_los_days=1,
                             min_survival_days=1, white_pattern="europe")


@register("base_population", f"WITH {BASE_SQL} SELECT * FROM base")
def q_base_population(spark, sf_dir):
    return rounded(base_population_e(spark, sf_dir))


# ------------------------------------------------------------ H3, H7-H9

def e_criteria(sd):
    """Stay-level criteria from a materialised stay table with ``_first_view``: one scan of the events for all."""
    since = seconds_between("_first_view", "intime")
    return OrderedDict([
        ("non_negative_balance", sd.filter(F.col("admission_age") >= 0).select("stay_id")),
        ("stay_over_1_day", sd.filter(F.col("los_icu") >= 1).select("stay_id")),
        (C.INCLUSION_EVENT, sd.filter((since >= 0) & (since <= W_E_SEC))
            .select("stay_id", F.col("_first_view").alias("inclusion_start"))),
    ])


ROLL_SQL = POP_E_SQL.replace("WITH ", "") + """,
c1 AS (SELECT stay_id FROM stay_detail WHERE admission_age >= 0),
c2 AS (SELECT stay_id FROM stay_detail WHERE los_icu >= 1)"""


@register("roll_inclusion", "WITH " + X.STAY_DETAIL_SQL + f""",
incl AS (
  SELECT s.stay_id FROM stays s JOIN (SELECT stay_id, min(ts) AS inclusion_start FROM kev
       WHERE event_type = 'view' GROUP BY stay_id) f USING (stay_id)
  WHERE {sec('f.inclusion_start', 's.intime')} BETWEEN 0 AND {W_E_SEC}
),
c1 AS (SELECT stay_id FROM stay_detail WHERE admission_age >= 0),
c2 AS (SELECT stay_id FROM stay_detail WHERE los_icu >= 1)
SELECT DISTINCT 0 AS step_no, 'initial' AS criterion, subject_id FROM stays
UNION ALL SELECT DISTINCT 1, 'non_negative_balance', subject_id FROM stays WHERE stay_id IN (SELECT stay_id FROM c1)
UNION ALL SELECT DISTINCT 2, 'stay_over_1_day', subject_id FROM stays
  WHERE stay_id IN (SELECT stay_id FROM c1) AND stay_id IN (SELECT stay_id FROM c2)
UNION ALL SELECT DISTINCT 3, 'inclusion_event', subject_id FROM stays
  WHERE stay_id IN (SELECT stay_id FROM c1) AND stay_id IN (SELECT stay_id FROM c2)
    AND stay_id IN (SELECT stay_id FROM incl)""")
def q_roll_inclusion(spark, sf_dir):
    sd = cut_lineage(X.stay_detail(spark, sf_dir, {"_first_view": F.col("event_type") == "view"}))
    _, steps = C.roll_inclusion(sd.select("subject_id", "hadm_id", "stay_id", "intime"), e_criteria(sd))
    return steps


def e_patient_sets(spark, sf_dir, sd):
    """Patient-level criteria for the flowchart, from the materialised stay table ``sd``: id frames in order."""
    pop = cohort_e_population(spark, sf_dir)
    return sd.select("subject_id").distinct(), OrderedDict([
        ("non_negative_balance", sd.filter(F.col("admission_age") >= 0).select("subject_id")),
        ("any_stay_over_1_day", sd.filter(F.col("los_icu") >= 1).select("subject_id")),
        ("included", pop.select("subject_id")),
        ("treated", pop.filter(F.col("intervention_status") == 1).select("subject_id")),
    ])


PATIENT_SETS_SQL = POP_E_SQL + """,
sd_all AS (SELECT s.*, c.c_acctbal AS admission_age, CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY')
           THEN 1 ELSE 0 END AS female, (epoch_us(s.outtime) - epoch_us(s.intime)) / 86400000000.0 AS los_icu
           FROM stays s LEFT JOIN customer c ON c.c_custkey = s.subject_id),
p0 AS (SELECT DISTINCT subject_id FROM sd_all),
p1 AS (SELECT DISTINCT subject_id FROM sd_all WHERE admission_age >= 0),
p2 AS (SELECT DISTINCT subject_id FROM sd_all WHERE los_icu >= 1),
p3 AS (SELECT DISTINCT subject_id FROM pop),
p4 AS (SELECT DISTINCT subject_id FROM pop WHERE intervention_status = 1),
r1 AS (SELECT subject_id FROM p0 INTERSECT SELECT subject_id FROM p1),
r2 AS (SELECT subject_id FROM r1 INTERSECT SELECT subject_id FROM p2),
r3 AS (SELECT subject_id FROM r2 INTERSECT SELECT subject_id FROM p3),
r4 AS (SELECT subject_id FROM r3 INTERSECT SELECT subject_id FROM p4),
steps AS (
  SELECT 1 AS step_no, 'non_negative_balance' AS criterion, (SELECT count(*) FROM p0) AS n_input,
         (SELECT count(*) FROM r1) AS n_kept
  UNION ALL SELECT 2, 'any_stay_over_1_day', (SELECT count(*) FROM r1), (SELECT count(*) FROM r2)
  UNION ALL SELECT 3, 'included', (SELECT count(*) FROM r2), (SELECT count(*) FROM r3)
  UNION ALL SELECT 4, 'treated', (SELECT count(*) FROM r3), (SELECT count(*) FROM r4)
)"""


@register("attrition", f"WITH {PATIENT_SETS_SQL} SELECT step_no, criterion, n_input, n_kept, "
                       "n_input - n_kept AS n_excluded FROM steps")
def q_attrition(spark, sf_dir):
    base, sets = e_patient_sets(spark, sf_dir, cut_lineage(X.stay_detail(spark, sf_dir)))
    crit = OrderedDict([("initial", base), *sets.items()])
    # bit 0 marks the initial population (every patient gets a row); shifting
    # it out leaves bit k = criterion k for the step masks
    flags = C.patient_flags(crit).withColumn("_mask", F.shiftright("_mask", 1))
    return C.attrition(flags, list(sets))


@register("excluded_profile", f"""WITH {PATIENT_SETS_SQL},
ch AS (SELECT subject_id, avg(admission_age) AS a, avg(female) AS f FROM sd_all GROUP BY subject_id),
ex AS (
  SELECT 1 AS step_no, 'non_negative_balance' AS criterion, subject_id FROM (SELECT subject_id FROM p0 EXCEPT SELECT subject_id FROM r1)
  UNION ALL SELECT 2, 'any_stay_over_1_day', subject_id FROM (SELECT subject_id FROM r1 EXCEPT SELECT subject_id FROM r2)
  UNION ALL SELECT 3, 'included', subject_id FROM (SELECT subject_id FROM r2 EXCEPT SELECT subject_id FROM r3)
  UNION ALL SELECT 4, 'treated', subject_id FROM (SELECT subject_id FROM r3 EXCEPT SELECT subject_id FROM r4)
)
SELECT step_no, criterion, count(*) AS n_excluded, round(avg(ch.a), 6) AS mean_admission_age,
       round(avg(ch.f), 6) AS mean_Female
FROM ex JOIN ch USING (subject_id) GROUP BY step_no, criterion""")
def q_excluded_profile(spark, sf_dir):
    sd = cut_lineage(X.stay_detail(spark, sf_dir))
    base, sets = e_patient_sets(spark, sf_dir, sd)
    crit = OrderedDict([("initial", base), *sets.items()])
    flags = C.patient_flags(crit).withColumn("_mask", F.shiftright("_mask", 1))
    chars = sd.groupBy("subject_id").agg(F.avg("admission_age").alias("admission_age"),
                                         F.avg(F.when(F.col("gender") == "F", 1).otherwise(0)).alias("Female"))
    return rounded(C.excluded_profile(flags, list(sets), chars, ["admission_age", "Female"]))


@register("final_split", f"""WITH {POP_E_SQL}
SELECT intervention_status, count(*) AS n_units, count(DISTINCT subject_id) AS n_patients
FROM pop GROUP BY intervention_status""")
def q_final_split(spark, sf_dir):
    return C.final_split(cohort_e_population(spark, sf_dir))


# ------------------------------------------------------------ H10, H11

@register("cohort_deltas", f"""WITH {POP_E_SQL}
SELECT stay_id, round({sec('dod', 'intime')} / 86400.0, 6) AS delta_dod_days,
       round({sec('intervention_start', 'intime')} / 86400.0, 6) AS delta_intervention_start_days,
       round({sec('inclusion_start', 'intime')} / 86400.0, 6) AS delta_inclusion_start_days
FROM pop""")
def q_cohort_deltas(spark, sf_dir):
    pop = cohort_e_population(spark, sf_dir)
    return rounded(C.cohort_deltas(pop).select("stay_id", "delta_dod_days", "delta_intervention_start_days",
                                               "delta_inclusion_start_days"))


DELTAS = ("dod", "intervention_start", "inclusion_start")


@register("cohort_delta_summary", f"""WITH {POP_E_SQL},
d AS ({' UNION ALL '.join(f"SELECT '{c}' AS delta, {sec(c, 'intime')} / 3600.0 AS h FROM pop" for c in DELTAS)})
SELECT delta, count(h) AS n, round(quantile_cont(h, 0.25), 6) AS q25, round(median(h), 6) AS median,
  round(quantile_cont(h, 0.75), 6) AS q75, round(quantile_cont(h, 0.75) - quantile_cont(h, 0.25), 6) AS iqr
FROM d WHERE h IS NOT NULL GROUP BY delta""")
def q_cohort_delta_summary(spark, sf_dir):
    """M2: count, median and interquartile range, in hours, of the cohort's own time deltas."""
    pop = cohort_e_population(spark, sf_dir)
    h = pop.select(*[(seconds_between(c, "intime") / 3600.0).alias(c) for c in DELTAS]).unpivot([], list(DELTAS), "delta", "h")
    q = R.exact_quantiles(h, "h", {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["delta"])
    n = h.groupBy("delta").agg(F.count("h").alias("n")).filter("n > 0")
    return rounded(n.join(q, "delta").withColumn("iqr", F.col("q75") - F.col("q25")))


WINDOWS = (0.25, 1.0, 3.0)


@register("cohort_windows", "WITH " + X.STAYS_SQL + f""",
f AS (SELECT stay_id, min(ts) AS inclusion_start FROM kev WHERE event_type = 'view' GROUP BY stay_id),
w AS (SELECT unnest([0.25, 1.0, 3.0]) AS window_days)
SELECT CAST(w.window_days AS DOUBLE) AS window_days, s.stay_id, f.inclusion_start, s.intime
FROM stays s JOIN f USING (stay_id), w
WHERE {sec('f.inclusion_start', 's.intime')} >= 0
  AND {sec('f.inclusion_start', 's.intime')} <= w.window_days * 86400.0""")
def q_cohort_windows(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    st = X.stays(spark, sf_dir)
    views = kev.filter(F.col("event_type") == "view").select("stay_id", F.col("ts").alias("starttime"), "event_id")
    return C.first_event_multi_window(views, st, WINDOWS, tiebreak=["event_id"])


# ------------------------------------------------------------ H12-H16

@register("early_flag", "WITH " + X.STAYS_SQL + f""",
m AS (
  SELECT k.stay_id, median(CASE WHEN event_type = 'click' THEN value END) AS median_click,
         median(CASE WHEN event_type = 'view' THEN value END) AS median_view
  FROM kev k JOIN stays s USING (stay_id)
  WHERE event_type IN ('click', 'view') AND {sec('k.ts', 's.intime')} BETWEEN 0 AND 86400
  GROUP BY k.stay_id
)
SELECT stay_id, round(median_click, 6) AS median_click, round(median_view, 6) AS median_view,
       CAST(coalesce(median_click < 25, false) OR coalesce(median_view < 25, false) AS INTEGER) AS early_flag
FROM m""")
def q_early_flag(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    meas = kev.select("stay_id", F.col("event_type").alias("code"), "value", F.col("ts").alias("starttime"))
    return rounded(C.early_flag(meas, X.stays(spark, sf_dir), 24, {"click": 25.0, "view": 25.0}))


@register("diagnosis_cohort", """
SELECT DISTINCT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id
FROM orders o
WHERE o.o_orderkey IN (SELECT l.l_orderkey FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
                       WHERE p.p_name LIKE 'red%' OR p.p_name LIKE 'blue%')""")
def q_diagnosis_cohort(spark, sf_dir):
    from trialframe.functions.text import any_prefix
    part = read_table(spark, sf_dir, "part")
    codes = part.filter(any_prefix("p_name", ["red", "blue"])).select(F.col("p_partkey").alias("l_partkey"))
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(codes, "l_partkey", "left_semi")
    od = read_table(spark, sf_dir, "orders")
    return (od.join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
              .select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id")).distinct())


def _exposure_lines(spark, sf_dir, name_part: str):
    """Lines of parts whose name contains ``name_part`` (B11 vocabulary lookup:
    distinct names first, then a semi join on the matching names)."""
    part = read_table(spark, sf_dir, "part")
    names = part.select("p_name").distinct().filter(F.instr(F.lower("p_name"), name_part) > 0)
    keys = part.join(names, "p_name", "left_semi").select(F.col("p_partkey").alias("l_partkey"))
    return X.order_lines(spark, sf_dir).join(keys, "l_partkey", "left_semi")


@register("first_exposure", """
SELECT l.l_orderkey AS hadm_id, min(l.l_shipdate) AS first_exposure
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
WHERE instr(lower(p.p_name), 'widget') > 0
GROUP BY l.l_orderkey""")
def q_first_exposure(spark, sf_dir):
    lines = _exposure_lines(spark, sf_dir, "widget").select("hadm_id", F.col("l_shipdate").alias("starttime"),
                                                            "l_linestatus")
    src_a = lines.filter(F.col("l_linestatus") == "O")
    src_b = lines.filter(F.col("l_linestatus") == "F")
    return C.first_exposure([src_a, src_b], key="hadm_id")


@register("arms_set_algebra", """
WITH a AS (SELECT DISTINCT o.o_custkey AS subject_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
           JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE instr(lower(p.p_name), 'widget') > 0),
     b AS (SELECT DISTINCT o.o_custkey AS subject_id FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
           JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE instr(lower(p.p_name), 'bolt') > 0)
SELECT 'widget_only' AS arm, subject_id FROM (SELECT subject_id FROM a EXCEPT SELECT subject_id FROM b)
UNION ALL
SELECT 'widget_and_bolt' AS arm, subject_id FROM (SELECT subject_id FROM a INTERSECT SELECT subject_id FROM b)""")
def q_arms_set_algebra(spark, sf_dir):
    a = _exposure_lines(spark, sf_dir, "widget").select("subject_id")
    b = _exposure_lines(spark, sf_dir, "bolt").select("subject_id")
    only = except_set(a, b).select(F.lit("widget_only").alias("arm"), "subject_id")
    both = intersect_all_sets([a, b]).select(F.lit("widget_and_bolt").alias("arm"), "subject_id")
    return only.unionByName(both)


@register("arms_by_status", """
WITH t AS (SELECT DISTINCT o_custkey AS subject_id FROM orders WHERE regexp_matches(lower(o_orderpriority), 'urgent|high'))
SELECT 'urgent_or_high' AS arm, subject_id FROM t
UNION ALL
SELECT 'other' AS arm, c.c_custkey AS subject_id FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.subject_id = c.c_custkey)""")
def q_arms_by_status(spark, sf_dir):
    from trialframe.functions.text import matches_any
    od = read_table(spark, sf_dir, "orders")
    treated = od.filter(matches_any("o_orderpriority", ["urgent", "high"])).select(
        F.col("o_custkey").alias("subject_id")).distinct()
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    control = cust.join(treated, "subject_id", "left_anti")
    return (treated.select(F.lit("urgent_or_high").alias("arm"), "subject_id")
                   .unionByName(control.select(F.lit("other").alias("arm"), "subject_id")))


# ------------------------------------------------------------ cohort O (orders)

W_O = X.COHORT_O_WINDOW_DAYS
W_O_SEC = W_O * 86400.0


def cohort_o_population(spark, sf_dir):
    """Second target population on the large tables: unit = order, inclusion
    = first open line shipped within 730 days of the order, treatment = first
    returned line (first overall, then in window and after inclusion),
    outcome = order fulfilled.  Both first times come from one aggregation
    over the line items."""
    li = read_table(spark, sf_dir, "lineitem")
    firsts = li.groupBy(F.col("l_orderkey").alias("stay_id")).agg(
        F.min(F.when(F.col("l_linestatus") == "O", F.col("l_shipdate"))).alias("_first_open"),
        F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("_first_return"))
    st = X.order_stays(spark, sf_dir).join(firsts, "stay_id")
    pop = C.include_in_window(st, "_first_open", W_O)
    pop = C.assign_from_first(pop, "_first_return", W_O)
    return pop.select("subject_id", "hadm_id", "stay_id", "intime", "inclusion_start", "intervention_start",
                      "intervention_status", (F.col("o_orderstatus") == "F").cast("int").alias("fulfilled"),
                      "o_orderpriority", "o_totalprice")


POP_O_SQL = f"""
incl_o AS (
  SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id, o.o_orderkey AS stay_id, o.o_orderdate AS intime,
         f.inclusion_start, o.o_orderstatus, o.o_orderpriority, o.o_totalprice
  FROM orders o JOIN (SELECT l_orderkey, min(l_shipdate) AS inclusion_start FROM lineitem WHERE l_linestatus = 'O'
                      GROUP BY l_orderkey) f ON f.l_orderkey = o.o_orderkey
  WHERE {sec('f.inclusion_start', 'o.o_orderdate')} BETWEEN 0 AND {W_O_SEC}
),
trt_o AS (SELECT l_orderkey AS stay_id, min(l_shipdate) AS first_trt FROM lineitem WHERE l_returnflag = 'R'
          GROUP BY l_orderkey),
pop_o AS (
  SELECT i.subject_id, i.hadm_id, i.stay_id, i.intime, i.inclusion_start,
         CASE WHEN {sec('t.first_trt', 'i.intime')} BETWEEN 0 AND {W_O_SEC} AND t.first_trt > i.inclusion_start
              THEN t.first_trt END AS intervention_start,
         CAST(({sec('t.first_trt', 'i.intime')} BETWEEN 0 AND {W_O_SEC} AND t.first_trt > i.inclusion_start)
              IS TRUE AS INTEGER) AS intervention_status,
         CAST(i.o_orderstatus = 'F' AS INTEGER) AS fulfilled, i.o_orderpriority, i.o_totalprice
  FROM incl_o i LEFT JOIN trt_o t USING (stay_id)
)"""


@register("target_population_orders", f"WITH {POP_O_SQL} SELECT * FROM pop_o")
def q_target_population_orders(spark, sf_dir):
    return cohort_o_population(spark, sf_dir)


@register("observation_window", f"""WITH {POP_O_SQL}
SELECT p.subject_id, l.l_orderkey AS hadm_id, l.l_orderkey AS stay_id, l.l_shipdate AS starttime,
       CAST(NULL AS TIMESTAMP) AS endtime, 'lineitem' AS domain, l.l_returnflag AS code, l.l_returnflag AS label,
       l.l_quantity AS value
FROM lineitem l JOIN pop_o p ON p.stay_id = l.l_orderkey WHERE l.l_shipdate <= p.inclusion_start""")
def q_observation_window(spark, sf_dir):
    from trialframe.operators.relational import observation_window, to_event_schema
    li = read_table(spark, sf_dir, "lineitem")
    ev = to_event_schema(li.select(F.col("l_orderkey").alias("stay_id"), F.col("l_orderkey").alias("hadm_id"),
                                   F.col("l_shipdate").alias("starttime"), F.col("l_returnflag").alias("code"),
                                   F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("value")),
                         domain="lineitem").drop("subject_id")
    return observation_window(ev, cohort_o_population(spark, sf_dir))
