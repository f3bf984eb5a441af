"""All covariates of the stays from twelve kinds of sources (I11), and the table log and memo.

Sources keyed by stay: raw events, the first-day score, the balance.  By admission: suspected infection,
sign-up observations.  By patient (the orders of the same customer): measurements, intervals, procedures,
any-agent flags, drug classes, comorbidities, admission flags.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from trialframe.operators import diagnostics as DG
from trialframe.operators import events as EV
from trialframe.operators import relational as R
from trialframe.plans import fixtures as X
from trialframe.plans.q_cohort import cohort_e_population
from trialframe.plans.q_effects import BINARY_SCORE_COLS, SCORES_SQL, crossfit_d
from trialframe.plans.q_events import DRUG_CLASSES, ORDER_FLAGS, POP_E_SQL, SCORE_SQL, _score_events
from trialframe.plans.registry import register, rounded
from trialframe.session import checkpoint_dir, cut_lineage
from trialframe.sources import io as IO
from trialframe.sources.io import read_table


def _event(domain, code, start, value, end=None, label=None, when=None):
    s = F.struct(F.col(start).alias("starttime"), (F.lit(None).cast("timestamp_ntz") if end is None else end).alias("endtime"), F.lit(domain).alias("domain"),
                 F.lit(code).alias("code"), (F.lit(code) if label is None else label).alias("label"),
                 value.cast("double").alias("value"))
    return s if when is None else F.when(when, s)


def _explode(df, keys, events):
    """Several kinds of events from one pass over a table; events without a value go."""
    kept = F.filter(F.array(*events), lambda x: x.isNotNull() & x["value"].isNotNull())
    return df.select(*keys, F.explode(kept).alias("_e")).select(*keys, "_e.*")


def sources(spark, sf_dir, pop):
    kev = X.keyed_events(spark, sf_dir)
    is_infection = (F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("int") > 50)
    raw = F.struct(F.lit("stay_id").alias("key_kind"), F.col("stay_id").alias("key"), F.lit("events").alias("domain"),
                   F.col("event_type").alias("code"), F.col("value").alias("value"))

    def by_admission(code):
        return F.struct(F.lit("hadm_id").alias("key_kind"), F.col("hadm_id").alias("key"), F.lit("observation").alias("domain"),
                        F.lit(code).alias("code"), F.lit(1.0).alias("value"))

    kinds = F.array(raw, F.when(is_infection, by_admission("suspected_infection")),
                    F.when(F.col("event_type") == "signup", by_admission("signed_up")))
    events = (kev.select(F.col("ts").alias("starttime"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("_e"))
              .select("starttime", "_e.*").withColumn("label", F.col("code")))

    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    seen = pop.select("subject_id").distinct()              # orders of other customers reach no unit
    lines = X.order_lines(spark, sf_dir).join(seen, "subject_id", "left_semi").join(part, "l_partkey")
    from_lines = _explode(lines, ["subject_id"], [
        _event("lineitem", "l_quantity", "l_shipdate", F.col("l_quantity")),
        _event("lineitem", "l_extendedprice", "l_shipdate", F.col("l_extendedprice")),
        _event("interval", "shipping", "intime", F.col("l_quantity"), F.col("l_shipdate")),
        _event("procedure", "open_line", "l_shipdate", (F.col("l_linestatus") == "O").cast("int"), F.col("l_shipdate")),
        *[_event("drug", "vasopressors", "l_shipdate", (F.col(c) > 0).cast("int"), label=F.lit(c)) for c in ("l_discount", "l_tax")],
        *[_event("medication", c, "l_shipdate", F.col("l_quantity"), label=F.col("p_name"),
                 when=F.lower("p_name").rlike("|".join(p))) for c, p in DRUG_CLASSES.items()]])
    orders = X.order_stays(spark, sf_dir).join(seen, "subject_id", "left_semi")
    flag = {c: F.expr(f"CASE WHEN {e} THEN 1 ELSE 0 END") for c, e in ORDER_FLAGS.items()}
    from_orders = _explode(orders, ["subject_id"], [
        *[_event("comorbidity", c, "intime", v, when=(v == 1) | F.lit(c == "large")) for c, v in flag.items()],
        _event("admission", "emergency", "intime", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"))])
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"), "c_acctbal")
    balance = _explode(pop.select("subject_id", "stay_id", "intime", "inclusion_start").join(cust, "subject_id"), ["stay_id"],
                       [_event("weight", "balance", "intime", F.col("c_acctbal"), F.col("inclusion_start"))])
    score = _score_events(spark, sf_dir, pop)
    return [events, from_lines, from_orders, balance, score]


def _line_sql(domain, code, value, start="l_shipdate", end="CAST(NULL AS TIMESTAMP)", label=None, where="true"):
    label = label or f"'{code}'"
    return (f"SELECT subject_id AS key, 'subject' AS kind, {start} AS starttime, {end} AS endtime, '{domain}' AS domain, "
            f"'{code}' AS code, {label} AS label, CAST({value} AS DOUBLE) AS value FROM lp WHERE {where}")


_sources_sql = " UNION ALL ".join([
    """SELECT stay_id AS key, 'stay' AS kind, ts AS starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'events' AS domain,
       event_type AS code, event_type AS label, value FROM kev""",
    """SELECT hadm_id, 'hadm', ts, NULL, 'observation', 'suspected_infection', 'suspected_infection', 1.0 FROM kev
       WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50""",
    "SELECT hadm_id, 'hadm', ts, NULL, 'observation', 'signed_up', 'signed_up', 1.0 FROM kev WHERE event_type = 'signup'",
    _line_sql("lineitem", "l_quantity", "l_quantity"), _line_sql("lineitem", "l_extendedprice", "l_extendedprice"),
    _line_sql("interval", "shipping", "l_quantity", "intime", "l_shipdate"),
    _line_sql("procedure", "open_line", "l_linestatus = 'O'", end="l_shipdate"),
    *[_line_sql("drug", "vasopressors", f"{c} > 0", label=f"'{c}'") for c in ("l_discount", "l_tax")],
    *[_line_sql("medication", c, "l_quantity", label="p_name", where=f"regexp_matches(lower(p_name), '{'|'.join(p)}')")
      for c, p in DRUG_CLASSES.items()],
    *[f"""SELECT o_custkey, 'subject', o_orderdate, NULL, 'comorbidity', '{c}', '{c}', CASE WHEN {e} THEN 1.0 ELSE 0.0 END
       FROM orders WHERE ({e}) OR '{c}' = 'large'""" for c, e in ORDER_FLAGS.items()],
    """SELECT o_custkey, 'subject', o_orderdate, NULL, 'admission', 'emergency', 'emergency',
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0 ELSE 0.0 END FROM orders""",
    """SELECT p.stay_id, 'stay', p.intime, p.inclusion_start, 'weight', 'balance', 'balance', c.c_acctbal
       FROM pop p JOIN customer c ON c.c_custkey = p.subject_id""",
    f"SELECT stay_id, 'stay', starttime, endtime, domain, code, label, value FROM ({SCORE_SQL})"])


@register("covariate_events_all", f"""WITH {POP_E_SQL}, {X.ORDER_LINES_SQL.strip()},
lp AS (SELECT o.*, p.p_name FROM olines o JOIN part p ON p.p_partkey = o.l_partkey),
src AS ({_sources_sql}),
seen AS (SELECT p.subject_id, p.hadm_id, p.stay_id, s.starttime, s.endtime, s.domain, s.code, s.label, s.value
  FROM src s JOIN pop p ON s.key = CASE s.kind WHEN 'stay' THEN p.stay_id WHEN 'hadm' THEN p.hadm_id ELSE p.subject_id END
  WHERE s.starttime <= p.inclusion_start AND s.value IS NOT NULL)
SELECT subject_id, hadm_id, stay_id, starttime, endtime, domain, code, label, round(value, 6) AS value
FROM seen GROUP BY ALL HAVING count(*) = 1""")
def q_covariate_events_all(spark, sf_dir):
    """Twelve kinds of sources through one bridge of keys."""
    pop = cut_lineage(cohort_e_population(spark, sf_dir))
    found = [s.filter(F.col("value").isNotNull()) for s in sources(spark, sf_dir, pop)]
    return rounded(EV.bridged_events(found, pop))


# ------------------------------------------------------------------ A8, A11

@register("score_log", f"""WITH {SCORES_SQL}
SELECT r.run, n_samples, round(prevalence, 6) AS prevalence, round(accuracy, 6) AS accuracy, round(roc_auc, 6) AS roc_auc,
       round(pr_auc, 6) AS pr_auc, tn, fp, fn, tp FROM bs, rk, (VALUES ('first'), ('second')) r(run)""")
def q_score_log(spark, sf_dir):
    """Scores of two runs appended to a CSV log with a header, and the log read back."""
    folder = os.path.join(checkpoint_dir(spark), "logs", f"scores-{uuid.uuid4().hex}")
    scores = cut_lineage(DG.binary_scores(crossfit_d(spark, sf_dir).select(F.col("m").alias("p"), "y"), "p", "y"))
    frame = None
    for run in ("first", "second"):
        frame = scores.select(F.lit(run).alias("run"), *BINARY_SCORE_COLS)
        IO.log_rows(frame, folder, fmt="csv")
    return rounded(IO.read_log(spark, folder, frame.schema).drop("run_id"))


@register("memoised_events", f"""WITH {X.KEYED_EVENTS_SQL.strip()}
SELECT hadm_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM kev GROUP BY hadm_id, event_type""")
def q_memoised_events(spark, sf_dir):
    """An expensive table computed in the first call, and read back by the second."""
    root = os.path.join(checkpoint_dir(spark), "memo", uuid.uuid4().hex)

    def table():
        agg = X.keyed_events(spark, sf_dir).groupBy("hadm_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        return IO.memoise(spark, agg, "admission_events", {"by": ["hadm_id", "event_type"]}, root)

    first, second = table(), table()
    if sorted(first.inputFiles()) != sorted(second.inputFiles()):
        raise ValueError("the second call did not read the table of the first")
    return rounded(second)
