"""Registered queries for the relational primitives (A, B, C, D, E, F, G rows)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from trialframe.functions import hashing as H
from trialframe.functions import time as TM
from trialframe.functions.text import any_prefix, label_from_map, matches_any, normalise_ndc
from trialframe.operators import relational as R
from trialframe.plans import fixtures as X
from trialframe.plans.q_cohort import POP_E_SQL, cohort_e_population
from trialframe.plans.registry import register, rounded
from trialframe.session import checkpoint_dir
from trialframe.sources import io as IO

sec = X.sec_sql


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:10]}")


def T(spark, sf_dir, name):
    return IO.read_table(spark, sf_dir, name)


# ------------------------------------------------------------------ A

@register("scan_parquet", "SELECT * FROM orders")
def q_scan_parquet(spark, sf_dir):
    return T(spark, sf_dir, "orders")


@register("scan_pruned", """SELECT l_orderkey, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'""")
def q_scan_pruned(spark, sf_dir):
    li = IO.read_pruned(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_shipdate"])
    return li.filter(F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")) \
             .select("l_orderkey", "l_extendedprice")


@register("csv_roundtrip", "SELECT * FROM customer")
def q_csv_roundtrip(spark, sf_dir):
    cust = T(spark, sf_dir, "customer")
    path = IO.write_csv(cust, _scratch(spark, "customer_csv"), sep="|", compression="gzip")
    return IO.read_csv(spark, path, schema=cust.schema, sep="|")


CATALOG = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
           "conversations").split()


@register("export_tables", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in CATALOG))
def q_export_tables(spark, sf_dir):
    tables = {n: T(spark, sf_dir, n) for n in IO.list_tables(spark, sf_dir)}
    return IO.export_tables(spark, tables, _scratch(spark, "export"))


@register("cohort_roundtrip", f"WITH {POP_E_SQL} SELECT * FROM pop")
def q_cohort_roundtrip(spark, sf_dir):
    path = IO.write_parquet(cohort_e_population(spark, sf_dir), _scratch(spark, "target_population"))
    return spark.read.parquet(path)


def _cohort_config() -> dict:
    from trialframe.operators.cohort import CohortConfig
    cfg = CohortConfig(cohort_name="events_view_purchase", min_age=0, min_los_icu_unit_day=1,
                       treatment_observation_window_unit_day=2.5).as_dict()
    return {"folder": IO.cohort_folder_name(cfg), **cfg}


def _sql_text(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


@register("cohort_config", f"WITH {POP_E_SQL} " + " UNION ALL ".join(
    f"SELECT '{k}' AS config, {_sql_text(v)} AS value" for k, v in _cohort_config().items())
    + " UNION ALL SELECT 'n_units', CAST(count(*) AS VARCHAR) FROM pop")
def q_cohort_config(spark, sf_dir):
    """The configuration saved beside a cohort, with the cohort's size."""
    n = cohort_e_population(spark, sf_dir).agg(F.count("*").cast("string").alias("value"))
    return IO.config_table(spark, _cohort_config()).unionByName(n.select(F.lit("n_units").alias("config"), "value"))


# ------------------------------------------------------------------ B

@register("filter_predicates", """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag
FROM lineitem WHERE (l_quantity >= 10 AND l_discount <> 0.05) OR NOT (l_returnflag = 'N')""")
def q_filter_predicates(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    cond = ((F.col("l_quantity") >= 10) & (F.col("l_discount") != 0.05)) | ~(F.col("l_returnflag") == "N")
    return li.filter(cond).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")


@register("filter_isin", """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'P')""")
def q_filter_isin(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    return (od.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "P"))
              .select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"))


@register("filter_regex", """SELECT p_partkey, p_name FROM part
WHERE regexp_matches(lower(p_name), 'ring|bolt') OR contains(lower(p_type), 'small')""")
def q_filter_regex(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    return (p.filter(matches_any("p_name", ["RING", "bolt"]) | F.lower("p_type").contains("small"))
             .select("p_partkey", "p_name"))


@register("filter_prefix", """SELECT p_partkey, p_name FROM part
WHERE starts_with(p_name, 'red') OR starts_with(p_name, 'blue') OR starts_with(p_name, 'small')""")
def q_filter_prefix(spark, sf_dir):
    p = T(spark, sf_dir, "part")
    return p.filter(any_prefix("p_name", ["red", "blue", "small"])).select("p_partkey", "p_name")


@register("case_recode", """SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS building,
  CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_class,
  CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 'A' WHEN starts_with(c_mktsegment, 'MACH') THEN 'M'
       ELSE c_mktsegment END AS segment_code
FROM customer""")
def q_case_recode(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    return c.select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("building"),
        F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 5000, "low")
         .otherwise("high").alias("balance_class"),
        F.when(F.col("c_mktsegment").startswith("AUTO"), "A").when(F.col("c_mktsegment").startswith("MACH"), "M")
         .otherwise(F.col("c_mktsegment")).alias("segment_code"))


@register("null_fill", f"""WITH {POP_E_SQL}
SELECT stay_id, coalesce(intervention_start, inclusion_start) AS followup_start,
       CAST(dod IS NOT NULL AS INTEGER) AS has_dod,
       coalesce(round({sec('dod', 'inclusion_start')} / 86400.0, 6), -1.0) AS days_to_dod
FROM pop""")
def q_null_fill(spark, sf_dir):
    pop = cohort_e_population(spark, sf_dir)
    out = pop.select("stay_id",
                     F.coalesce("intervention_start", "inclusion_start").alias("followup_start"),
                     F.col("dod").isNotNull().cast("int").alias("has_dod"),
                     F.round(TM.days_between("dod", "inclusion_start"), 6).alias("days_to_dod"))
    return out.fillna({"days_to_dod": -1.0})


@register("project_event_schema", """SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id,
  l.l_orderkey AS stay_id, l.l_shipdate AS starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'lineitem' AS domain,
  l.l_returnflag AS code, 'returnflag_' || l.l_returnflag AS label, l.l_quantity AS value
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def q_project_event_schema(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir)
    ev = lines.select("subject_id", "hadm_id", "stay_id", F.col("l_shipdate").alias("starttime"),
                      F.col("l_returnflag").alias("code"),
                      F.concat(F.lit("returnflag_"), F.col("l_returnflag")).alias("label"),
                      F.col("l_quantity").alias("value"))
    return R.to_event_schema(ev, domain="lineitem")


@register("normalise_code", """SELECT o_orderkey, '0' || replace(o_orderpriority, '-', '') AS ndc FROM orders""")
def q_normalise_code(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    return od.select("o_orderkey", normalise_ndc("o_orderpriority").alias("ndc"))


@register("time_deltas", f"""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
  round({sec('l.l_shipdate', 'o.o_orderdate')}, 6) AS delta_seconds,
  round({sec('l.l_shipdate', 'o.o_orderdate')} / 3600.0, 6) AS delta_hours,
  round({sec('l.l_shipdate', 'o.o_orderdate')} / 60.0, 6) AS delta_minutes,
  round({sec('l.l_shipdate', 'o.o_orderdate')} / 86400.0, 6) AS delta_days,
  CAST(floor({sec('l.l_shipdate', 'o.o_orderdate')} / 86400.0) AS BIGINT) AS delta_floor_days
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def q_time_deltas(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir)
    return rounded(lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        TM.seconds_between("l_shipdate", "intime").alias("delta_seconds"),
        TM.hours_between("l_shipdate", "intime").alias("delta_hours"),
        TM.minutes_between("l_shipdate", "intime").alias("delta_minutes"),
        TM.days_between("l_shipdate", "intime").alias("delta_days"),
        TM.floor_days_between("l_shipdate", "intime").alias("delta_floor_days")))


@register("time_shift", """SELECT event_id, ts + INTERVAL 30 HOUR AS ts_plus_30h,
  ts - INTERVAL 90 MINUTE AS ts_minus_90m, ts + INTERVAL 1 DAY AS ts_plus_1d FROM events""")
def q_time_shift(spark, sf_dir):
    ev = T(spark, sf_dir, "events")
    return ev.select("event_id", TM.shift("ts", days=1, hours=6).alias("ts_plus_30h"),
                     TM.shift("ts", seconds=-5400).alias("ts_minus_90m"),
                     (F.col("ts") + F.make_dt_interval(F.lit(1))).alias("ts_plus_1d"))


@register("name_lookup", """WITH names AS (SELECT DISTINCT p_name FROM part WHERE instr(lower(p_name), 'widget') > 0)
SELECT p.p_name, count(*) AS n_lines FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
WHERE p.p_name IN (SELECT p_name FROM names) GROUP BY p.p_name""")
def q_name_lookup(spark, sf_dir):
    part = T(spark, sf_dir, "part")
    names = part.select("p_name").distinct().filter(F.instr(F.lower("p_name"), "widget") > 0)
    keys = part.join(names, "p_name", "left_semi").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = T(spark, sf_dir, "lineitem").select("l_partkey")
    return lines.join(keys, "l_partkey").groupBy("p_name").agg(F.count(F.lit(1)).alias("n_lines"))


@register("period_labels", r"""WITH l AS (SELECT event_id, regexp_extract(props, '"k": (\d+)', 1) || 'h' AS label FROM events)
SELECT event_id, label, CAST(regexp_extract(label, '(\d+)h', 1) AS INTEGER) AS hours,
       lpad(regexp_extract(label, '(\d+)h', 1), 2, '0') || 'h' AS padded FROM l""")
def q_period_labels(spark, sf_dir):
    ev = T(spark, sf_dir, "events")
    lab = ev.select("event_id", F.concat(F.regexp_extract("props", r'"k": (\d+)', 1), F.lit("h")).alias("label"))
    num = F.regexp_extract("label", r"(\d+)h", 1)
    return lab.select("event_id", "label", num.cast("int").alias("hours"),
                      F.concat(F.lpad(num, 2, "0"), F.lit("h")).alias("padded"))


# Fixed display labels of the customer segments.
SEGMENT_LABELS = {"AUTOMOBILE": "Automobile", "BUILDING": "Building", "FURNITURE": "Furniture",
                  "HOUSEHOLD": "Household", "MACHINERY": "Machinery"}


@register("label_map", """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile'
  WHEN 'BUILDING' THEN 'Building' WHEN 'FURNITURE' THEN 'Furniture' WHEN 'HOUSEHOLD' THEN 'Household'
  WHEN 'MACHINERY' THEN 'Machinery' ELSE 'Other' END AS segment_label FROM customer""")
def q_label_map(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    return c.select("c_custkey", label_from_map("c_mktsegment", SEGMENT_LABELS, "Other").alias("segment_label"))


@register("binarise_category", """SELECT c_custkey,
  CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS rich,
  CASE WHEN c_nationkey < 10 THEN 1 ELSE 0 END AS low_nation,
  concat_ws(', ', CASE WHEN c_acctbal > 5000 THEN 'balance > 5000' ELSE 'balance <= 5000' END,
                  CASE WHEN c_nationkey < 10 THEN 'nation < 10' ELSE 'nation >= 10' END) AS category
FROM customer""")
def q_binarise_category(spark, sf_dir):
    c = T(spark, sf_dir, "customer")
    rich = F.col("c_acctbal") > 5000
    low = F.col("c_nationkey") < 10
    return c.select("c_custkey", F.when(rich, 1).otherwise(0).alias("rich"),
                    F.when(low, 1).otherwise(0).alias("low_nation"),
                    F.concat_ws(", ", F.when(rich, "balance > 5000").otherwise("balance <= 5000"),
                                F.when(low, "nation < 10").otherwise("nation >= 10")).alias("category"))


@register("date_helpers", """SELECT event_id,
  CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3600000000.0) AS BIGINT) AS hours_since_origin,
  make_timestamp(2024, 1, CAST(1 + event_id % 28 AS BIGINT), 12, 30, 0.0) AS built_ts,
  CAST('2024-01-15 08:00:00' AS TIMESTAMP) AS parsed_ts,
  ts + INTERVAL 2 HOUR AS plus_2h,
  date_trunc('hour', ts) AS hour_start
FROM events""")
def q_date_helpers(spark, sf_dir):
    ev = T(spark, sf_dir, "events")
    origin = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return ev.select(
        "event_id",
        F.timestamp_diff("HOUR", origin, "ts").alias("hours_since_origin"),
        F.make_timestamp_ntz(F.lit(2024), F.lit(1), (F.lit(1) + F.col("event_id") % 28).cast("int"),
                             F.lit(12), F.lit(30), F.lit(0)).alias("built_ts"),
        F.to_timestamp_ntz(F.lit("2024-01-15 08:00:00")).alias("parsed_ts"),
        F.timestamp_add("HOUR", F.lit(2), "ts").alias("plus_2h"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start"))


@register("hour_grid", "WITH " + X.STAYS_SQL + """
SELECT stay_id, unnest(generate_series(
  (CASE WHEN date_trunc('hour', intime) = intime THEN intime ELSE date_trunc('hour', intime) + INTERVAL 1 HOUR END)
    - INTERVAL 24 HOUR, outtime, INTERVAL 1 HOUR)) AS hour_ts
FROM stays""")
def q_hour_grid(spark, sf_dir):
    st = X.stays(spark, sf_dir)
    return st.select("stay_id", F.explode(TM.hour_grid("intime", "outtime", 24)).alias("hour_ts"))


@register("sample_fraction", f"""SELECT o_orderkey, o_custkey FROM orders
WHERE {H.uniform_sql('o_orderkey', '42')} < 0.1""")
def q_sample_fraction(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    return od.filter(H.uniform("o_orderkey", F.lit(42)) < 0.1).select("o_orderkey", "o_custkey")


@register("limit_n", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def q_limit_n(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    return od.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10)


# ------------------------------------------------------------------ C

@register("join_inner", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_custkey, o.o_orderstatus
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def q_join_inner(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    od = T(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return li.join(od, "l_orderkey")


@register("join_composite", "WITH " + X.STAYS_SQL + """
SELECT k.event_id, k.stay_id, s.intime FROM kev k JOIN stays s
  ON s.subject_id = k.subject_id AND s.stay_id = k.stay_id""")
def q_join_composite(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir).select("event_id", "subject_id", "stay_id")
    st = X.stays(spark, sf_dir).select("subject_id", "stay_id", "intime")
    return kev.join(st, ["subject_id", "stay_id"]).select("event_id", "stay_id", "intime")


@register("join_left_fill", """SELECT c.c_custkey, coalesce(o.n_orders, 0) AS n_orders,
  coalesce(o.total, 0.0) AS total_price
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 6) AS total
                           FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""")
def q_join_left_fill(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey")
    agg = (T(spark, sf_dir, "orders")
           .groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 6).alias("total_price")))
    return R.fill_left(c, agg, "c_custkey", {"n_orders": 0, "total_price": 0.0})


@register("join_full_outer", """SELECT coalesce(a.k, b.k) AS subject_id, a.n_orders, b.n_events FROM
 (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY o_custkey) a
 FULL OUTER JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY user_id) b ON a.k = b.k""")
def q_join_full_outer(spark, sf_dir):
    """C4: per-source aggregates of one unit joined full outer (units present
    in either source; absent side null)."""
    a = (T(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id"))
         .agg(F.count(F.lit(1)).alias("n_orders")))
    b = (T(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject_id"))
         .agg(F.count(F.lit(1)).alias("n_events")))
    return a.join(b, "subject_id", "full")


@register("join_semi", """SELECT c_custkey, c_name FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def q_join_semi(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = T(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi")


@register("join_anti", """SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def q_join_anti(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = T(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


def _key_precedence(key: str):
    """Events that carry only ``key`` joined to the population on it (stay, else admission, else patient)."""
    def query(spark, sf_dir):
        ev = X.keyed_events(spark, sf_dir).select("event_id", key)
        return R.join_by_key_precedence(ev, cohort_e_population(spark, sf_dir)).select(
            "event_id", "subject_id", "hadm_id", "stay_id")
    return query


for _name, _key in (("join_key_precedence", "hadm_id"), ("join_key_stay", "stay_id"), ("join_key_patient", "subject_id")):
    register(_name, f"""WITH {POP_E_SQL}
SELECT k.event_id, p.subject_id, p.hadm_id, p.stay_id FROM kev k JOIN pop p ON p.{_key} = k.{_key}""")(_key_precedence(_key))


@register("join_time_bound", f"""WITH {POP_E_SQL}
SELECT k.subject_id, k.hadm_id, k.stay_id, k.ts AS starttime, CAST(NULL AS TIMESTAMP) AS endtime,
  'events' AS domain, k.event_type AS code, k.event_type AS label, k.value
FROM kev k JOIN pop p ON p.stay_id = k.stay_id WHERE k.ts <= p.inclusion_start""")
def q_join_time_bound(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    ev = R.to_event_schema(kev.select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"),
                                      F.col("event_type").alias("code"), F.col("event_type").alias("label"),
                                      "value"), domain="events")
    return R.observation_window(ev, cohort_e_population(spark, sf_dir))


@register("restrict_vocabulary", """SELECT event_id, event_type AS code, value FROM events
WHERE event_type IN ('view', 'click')""")
def q_restrict_vocabulary(spark, sf_dir):
    ev = T(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), "value")
    return R.restrict_vocabulary(ev, ["view", "click"])


@register("join_dictionary", """SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s
LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def q_join_dictionary(spark, sf_dir):
    s = T(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    n = T(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return R.dictionary_join(s, n, "n_nationkey").select("s_suppkey", "s_name", "n_name")


@register("join_ontology", """SELECT o.o_custkey AS subject_id, l.l_orderkey AS hadm_id, l.l_shipdate AS starttime,
  'ontology' AS domain, p.p_type AS code, p.p_name AS label, l.l_quantity AS value, l.l_linenumber
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""")
def q_join_ontology(spark, sf_dir):
    """Item -> class ontology join (every line gets its part's type as
    the event code)."""
    lines = X.order_lines(spark, sf_dir)
    onto = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"),
                                           F.col("p_name").alias("label"))
    j = R.dictionary_join(lines, onto, "l_partkey", "inner")
    return j.select("subject_id", "hadm_id", F.col("l_shipdate").alias("starttime"), F.lit("ontology").alias("domain"),
                    "code", "label", F.col("l_quantity").alias("value"), "l_linenumber")


# ------------------------------------------------------------------ D

@register("agg_first_last", """SELECT l_orderkey,
  arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS first_quantity,
  arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS last_quantity
FROM lineitem GROUP BY l_orderkey""")
def q_agg_first_last(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    order = ["l_shipdate", *X.LINE_TIEBREAK]
    f = R.first_last(li, "l_orderkey", order, ["l_quantity"], "first", "_first")
    last = R.first_last(li, "l_orderkey", order, ["l_quantity"], "last", "_last")
    return f.join(last, "l_orderkey").select("l_orderkey", F.col("l_quantity_first").alias("first_quantity"),
                                             F.col("l_quantity_last").alias("last_quantity"))


@register("agg_stats", """SELECT l_returnflag, l_linestatus, round(min(l_extendedprice), 6) AS min_price,
  round(max(l_extendedprice), 6) AS max_price, round(avg(l_extendedprice), 6) AS mean_price,
  round(median(l_extendedprice), 6) AS median_price, round(sum(l_extendedprice), 6) AS sum_price,
  round(stddev_samp(l_extendedprice), 6) AS std_price, count(l_extendedprice) AS count_price
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_agg_stats(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    v, by = F.col("l_extendedprice"), ["l_returnflag", "l_linestatus"]
    one = li.groupBy(*by).agg(
        F.min(v).alias("min_price"), F.max(v).alias("max_price"), F.avg(v).alias("mean_price"),
        F.sum(v).alias("sum_price"), F.stddev_samp(v).alias("std_price"), F.count(v).alias("count_price"))
    # The median of a few huge groups by distributed order statistics: no task holds a group.
    return rounded(one.join(R.exact_quantiles(li, "l_extendedprice", {"median_price": 0.5}, by), by))


@register("agg_count_distinct", """SELECT o_orderstatus, count(DISTINCT o_custkey) AS n_customers
FROM orders GROUP BY o_orderstatus""")
def q_agg_count_distinct(spark, sf_dir):
    return T(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n_customers"))


@register("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC")
def q_value_counts(spark, sf_dir):
    return (T(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc()))


@register("count_after_distinct", """SELECT user_id, count(*) AS n_event_types
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id""")
def q_count_after_distinct(spark, sf_dir):
    return (T(spark, sf_dir, "events").select("user_id", "event_type").distinct()
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_event_types")))


def describe_long(df, col: str):
    """Count, mean, std, min, quartiles, max of one column, as long rows.
    Moments are one aggregation; the quartiles are exact distributed order
    statistics (no single task holds the column)."""
    v = F.col(col)
    one = df.groupBy().agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    qs = R.exact_quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    from trialframe.operators.features import attach_row
    wide = attach_row(one, qs).select("count", "mean", "std", "min", "q25", "q50", "q75", "max")
    return wide.unpivot([], ["count", "mean", "std", "min", "q25", "q50", "q75", "max"], "statistic", "value")


@register("describe_deltas", f"""WITH d AS (SELECT {sec('l.l_shipdate', 'o.o_orderdate')} / 86400.0 AS x
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT statistic, round(value, 6) AS value FROM (
  SELECT 'count' AS statistic, CAST(count(x) AS DOUBLE) AS value FROM d
  UNION ALL SELECT 'mean', avg(x) FROM d UNION ALL SELECT 'std', stddev_samp(x) FROM d
  UNION ALL SELECT 'min', min(x) FROM d UNION ALL SELECT 'q25', quantile_cont(x, 0.25) FROM d
  UNION ALL SELECT 'q50', quantile_cont(x, 0.5) FROM d UNION ALL SELECT 'q75', quantile_cont(x, 0.75) FROM d
  UNION ALL SELECT 'max', max(x) FROM d)""")
def q_describe_deltas(spark, sf_dir):
    lines = X.order_lines(spark, sf_dir).select(TM.days_between("l_shipdate", "intime").alias("x"))
    return rounded(describe_long(lines, "x"))


@register("subgroup_quantiles", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS q95, round(avg(l_extendedprice), 6) AS mean
FROM lineitem GROUP BY l_returnflag""")
def q_subgroup_quantiles(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    qs = R.exact_quantiles(li, "l_extendedprice", {"q05": 0.05, "q95": 0.95}, ["l_returnflag"])
    mean = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("mean"))
    return rounded(qs.join(mean, "l_returnflag").select("l_returnflag", "q05", "q95", "mean"))


@register("prevalence", f"""WITH {POP_E_SQL}
SELECT round(avg(mortality_1day), 6) AS prevalence_1day, round(avg(mortality_3days), 6) AS prevalence_3days,
  CAST(sum(intervention_status) AS BIGINT) AS n_treated, CAST(sum(1 - intervention_status) AS BIGINT) AS n_control,
  round(100.0 * avg(intervention_status), 6) AS pct_treated
FROM pop""")
def q_prevalence(spark, sf_dir):
    pop = cohort_e_population(spark, sf_dir)
    return rounded(pop.groupBy().agg(
        F.avg("mortality_1day").alias("prevalence_1day"), F.avg("mortality_3days").alias("prevalence_3days"),
        F.sum("intervention_status").cast("bigint").alias("n_treated"),
        F.sum(1 - F.col("intervention_status")).cast("bigint").alias("n_control"),
        (F.avg("intervention_status") * 100.0).alias("pct_treated")))


def missing_counts(df, columns):
    """Number of nulls per column, one aggregation, long output."""
    one = df.groupBy().agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "n_missing")


@register("missing_counts", f"""WITH {POP_E_SQL}
SELECT 'intervention_start' AS column_name, count(*) FILTER (WHERE intervention_start IS NULL) AS n_missing FROM pop
UNION ALL SELECT 'dod', count(*) FILTER (WHERE dod IS NULL) FROM pop
UNION ALL SELECT 'inclusion_start', count(*) FILTER (WHERE inclusion_start IS NULL) FROM pop""")
def q_missing_counts(spark, sf_dir):
    return missing_counts(cohort_e_population(spark, sf_dir), ["intervention_start", "dod", "inclusion_start"])


# ------------------------------------------------------------------ E

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("unpivot_events", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, code, value FROM (
  UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
           FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME code VALUE value)
WHERE value IS NOT NULL AND NOT (code = 'l_discount' AND value = 0)""")
def q_unpivot_events(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem")
    long = R.unpivot_long(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], MEASURES)
    # zero flags are dropped except for the index-like measures (as comorbidities)
    return long.filter(~((F.col("code") == "l_discount") & (F.col("value") == 0)))


E_CODES = ["view", "click", "signup", "error", "purchase"]


def cohort_e_events(spark, sf_dir):
    """Cohort E covariate events restricted to the observation period."""
    kev = X.keyed_events(spark, sf_dir)
    ev = R.to_event_schema(kev.select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"),
                                      F.col("event_type").alias("code"), F.col("event_type").alias("label"),
                                      "value"), domain="events")
    return ev


OBS_EVENTS_SQL = POP_E_SQL + """,
obs AS (SELECT k.subject_id, k.hadm_id, k.stay_id, k.ts AS starttime, k.event_type AS code, k.value, k.event_id
        FROM kev k JOIN pop p ON p.stay_id = k.stay_id WHERE k.ts <= p.inclusion_start)"""


def _pivot_sql(aggs: list[str]) -> str:
    parts = []
    for code in E_CODES:
        for agg in aggs:
            if agg == "first":
                e = f"arg_min(value, (starttime, event_id)) FILTER (WHERE code = '{code}')"
            elif agg == "last":
                e = f"arg_max(value, (starttime, event_id)) FILTER (WHERE code = '{code}')"
            elif agg == "median":
                e = f"median(value) FILTER (WHERE code = '{code}')"
            else:
                e = f"{agg}(value) FILTER (WHERE code = '{code}')"
            parts.append(f"round({e}, 6) AS {agg}_code_{code}")
    return ", ".join(parts)


def _obs_events_spark(spark, sf_dir, pop=None):
    kev = X.keyed_events(spark, sf_dir)
    pop = pop if pop is not None else cohort_e_population(spark, sf_dir)
    ev = kev.select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"),
                    F.col("event_type").alias("code"), "value", "event_id")
    return R.observation_window(ev, pop, event_cols=["subject_id", "hadm_id", "stay_id", "starttime", "code",
                                                     "value", "event_id"])


@register("pivot_multi_agg", f"""WITH {OBS_EVENTS_SQL}
SELECT stay_id, {_pivot_sql(['first', 'last', 'median'])} FROM obs GROUP BY stay_id""")
def q_pivot_multi_agg(spark, sf_dir):
    ev = _obs_events_spark(spark, sf_dir)
    return rounded(R.pivot_codes(ev, ["stay_id"], E_CODES, ["first", "last", "median"],
                                 order=["starttime", "event_id"]))


@register("pivot_last", f"""WITH {OBS_EVENTS_SQL}
SELECT stay_id, {_pivot_sql(['last'])} FROM obs GROUP BY stay_id""")
def q_pivot_last(spark, sf_dir):
    ev = _obs_events_spark(spark, sf_dir)
    return rounded(R.pivot_codes(ev, ["stay_id"], E_CODES, ["last"], order=["starttime", "event_id"]))


@register("drop_all_duplicated", """SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem
GROUP BY l_orderkey, l_returnflag, l_linestatus HAVING count(*) = 1""")
def q_drop_all_duplicated(spark, sf_dir):
    li = T(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return R.drop_all_duplicated(li)


@register("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def q_distinct_rows(spark, sf_dir):
    return T(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").distinct()


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("one_hot", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def q_one_hot(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return R.one_hot(c, "c_mktsegment", SEGMENTS)


# ------------------------------------------------------------------ G

@register("first_stay", """SELECT * FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def q_first_stay(spark, sf_dir):
    return R.top1_per_group(T(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@register("sort_rows", "SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def q_sort_rows(spark, sf_dir):
    return (T(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
            .orderBy("o_custkey", F.col("o_orderdate").desc(), "o_orderkey"))


# ------------------------------------------------------------------ F

@register("union_all_events", f"""WITH {X.KEYED_EVENTS_SQL.strip()}, {X.ORDER_LINES_SQL.strip()}
SELECT subject_id, hadm_id, stay_id, ts AS starttime, CAST(NULL AS TIMESTAMP) AS endtime, 'events' AS domain,
       event_type AS code, event_type AS label, value FROM kev
UNION ALL
SELECT subject_id, hadm_id, stay_id, l_shipdate, NULL, 'lineitem', l_returnflag, l_returnflag, l_quantity FROM olines""")
def q_union_all_events(spark, sf_dir):
    kev = X.keyed_events(spark, sf_dir)
    a = R.to_event_schema(kev.select("subject_id", "hadm_id", "stay_id", F.col("ts").alias("starttime"),
                                     F.col("event_type").alias("code"), F.col("event_type").alias("label"),
                                     "value"), domain="events")
    lines = X.order_lines(spark, sf_dir)
    b = R.to_event_schema(lines.select("subject_id", "hadm_id", "stay_id", F.col("l_shipdate").alias("starttime"),
                                       F.col("l_returnflag").alias("code"), F.col("l_returnflag").alias("label"),
                                       F.col("l_quantity").alias("value")), domain="lineitem")
    return R.union_all([a, b])


@register("union_distinct", """SELECT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'F'
UNION SELECT user_id FROM events""")
def q_union_distinct(spark, sf_dir):
    a = T(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("subject_id"))
    b = T(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"))
    return R.union_distinct([a, b])


@register("intersect_ids", """SELECT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'F'
INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def q_intersect_ids(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    a = od.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("subject_id"))
    b = od.filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("subject_id"))
    return R.intersect_all_sets([a, b])


@register("except_ids", """SELECT o_custkey AS subject_id FROM orders WHERE o_orderstatus = 'F'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def q_except_ids(spark, sf_dir):
    od = T(spark, sf_dir, "orders")
    a = od.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("subject_id"))
    b = od.filter(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("subject_id"))
    return R.except_set(a, b)
