"""Mapping of the driver tables onto the clinical concepts of the library.

The library operators take generic frames (stays, events, population); this
module builds those frames from the parquet tables under ``sf_dir`` and keeps,
next to each builder, the DuckDB SQL text of the very same definition so that
the oracle queries share one source of truth.

Cohort E (temporal, from ``events`` + ``customer``):
  subject = user; stay = 5-day block of the user's events; admission = 15-day
  block; intime = block start; outtime = last event of the stay.
Cohort O (large, from ``orders`` + ``lineitem``): subject = customer, stay =
  order, intime = order date, line items are timed events at the ship date.
Cohort D (binary, from ``documents`` + ``labels``): unit = document,
  treatment = non-English, outcome = quality, strata = source x length band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.functions.time import seconds_between
from trialframe.sources.io import read_table

# Fixed values of the fixture mapping.
ORIGIN = "2024-01-01 00:00:00"
KEY_WIDTH = 1_000_000            # blocks of a user that a key can tell apart (over 13,000 years)
STAY_SECONDS = 432_000          # 5 days
STAYS_PER_ADMISSION = 3         # 15-day admission block
COHORT_E_WINDOW_DAYS = 2.5
COHORT_O_WINDOW_DAYS = 730.0


# ----------------------------------------------------------------- cohort E

def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the three stay keys attached."""
    ev = read_table(spark, sf_dir, "events")
    b = F.floor(seconds_between(F.col("ts"), F.lit(ORIGIN)) / STAY_SECONDS).cast("bigint")
    return (ev.withColumn("_b", b)
              .withColumn("subject_id", F.col("user_id"))
              .withColumn("stay_id", F.col("user_id") * KEY_WIDTH + F.col("_b"))
              .withColumn("hadm_id", F.col("user_id") * KEY_WIDTH + F.floor(F.col("_b") / STAYS_PER_ADMISSION).cast("bigint")))


def stays(spark: SparkSession, sf_dir: str, firsts: dict | None = None) -> DataFrame:
    """One row per stay: keys, intime (block start), outtime (last event) and
    the first ``error`` at or after the stay start (``dod``).

    ``firsts`` maps output names to event predicates; the first time of each
    is computed in the *same* aggregation (one scan of the events for the
    stays, the inclusion event and the first treatment).

    ``dod`` is a suffix minimum over the user's stays (a window over one row
    per stay, never over raw events), so a user with most of the events does
    not land in one task.
    """
    ev = keyed_events(spark, sf_dir)
    extra = [F.min(F.when(cond, F.col("ts"))).alias(name) for name, cond in (firsts or {}).items()]
    st = (ev.groupBy("subject_id", "hadm_id", "stay_id", "_b")
            .agg(F.max("ts").alias("outtime"),
                 F.min(F.when(F.col("event_type") == "error", F.col("ts"))).alias("_err_min"), *extra)
            .withColumn("intime", F.timestamp_add("DAY", F.col("_b") * 5, F.lit(ORIGIN).cast("timestamp_ntz"))))
    later = Window.partitionBy("subject_id").orderBy(F.col("_b").desc())
    return (st.withColumn("_next_err", F.min("_err_min").over(
                later.rowsBetween(Window.unboundedPreceding, -1)))
              .withColumn("dod", F.least("_err_min", "_next_err"))
              .select("subject_id", "hadm_id", "stay_id", "intime", "outtime", "dod", "_err_min", "_next_err",
                      *(firsts or {}).keys()))


def stay_detail(spark: SparkSession, sf_dir: str, firsts: dict | None = None) -> DataFrame:
    """icustay_detail analogue: stays + demographics + first-stay flag + dod.

    dod = first ``error`` of the user at or after the stay start.  ``firsts``
    as in ``stays``.
    """
    st = stays(spark, sf_dir, firsts)
    first = st.groupBy("subject_id").agg(F.min("intime").alias("_first_in"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject_id"), "c_acctbal", "c_mktsegment", "c_nationkey")
    nat = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("race"))
    return (st.join(first, "subject_id")
              .join(cust, "subject_id", "left")
              .join(nat, "c_nationkey", "left")
              .join(reg, "n_regionkey", "left")
              .select("subject_id", "hadm_id", "stay_id",
                      F.col("intime").alias("icu_intime"), "intime", "outtime",
                      (F.col("intime") == F.col("_first_in")).alias("first_icu_stay"),
                      F.col("c_acctbal").alias("admission_age"),
                      F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("F"))
                       .otherwise(F.lit("M")).alias("gender"),
                      "race", "c_mktsegment", "dod",
                      (seconds_between("outtime", "intime") / 86400.0).alias("los_icu"), *(firsts or {}).keys()))


def death_after(spark: SparkSession, sf_dir: str, population: DataFrame,
                start_col: str = "inclusion_start") -> DataFrame:
    """Adds ``dod`` = first ``error`` of the user at or after ``start_col``
    (which lies inside the stay): the stay's own errors after the start, else
    the first error of a later stay (``_next_err``, taken from the population
    when it carries it, else from the stays)."""
    ev = keyed_events(spark, sf_dir).filter(F.col("event_type") == "error").select("stay_id", "ts")
    own = (population.select("stay_id", start_col).join(ev, "stay_id")
                     .filter(F.col("ts") >= F.col(start_col))
                     .groupBy("stay_id").agg(F.min("ts").alias("_own_err")))
    pop = population
    if "_next_err" not in pop.columns:
        pop = pop.join(stays(spark, sf_dir).select("stay_id", "_next_err"), "stay_id", "left")
    return (pop.join(own, "stay_id", "left")
               .withColumn("dod", F.least("_own_err", "_next_err"))
               .drop("_own_err", "_next_err"))


# ----------------------------------------------------------------- cohort O

def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` joined to its order: subject/stay keys, intime, line time."""
    li = read_table(spark, sf_dir, "lineitem")
    od = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("intime"))
    return (li.join(od, "l_orderkey")
              .withColumn("stay_id", F.col("l_orderkey"))
              .withColumn("hadm_id", F.col("l_orderkey")))


def order_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = read_table(spark, sf_dir, "orders")
    return od.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"),
                     F.col("o_orderkey").alias("stay_id"), F.col("o_orderdate").alias("intime"),
                     "o_orderstatus", "o_orderpriority", "o_totalprice")


LINE_TIEBREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


# ----------------------------------------------------------------- cohort D

def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, a (non-English), y (quality), strata s1 (source), s2 (length band)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return (docs.join(lab, "doc_id")
                .select(F.col("doc_id").alias("unit_id"),
                        F.when(F.col("lang") != "en", 1).otherwise(0).alias("a"),
                        F.col("quality").cast("int").alias("y"),
                        F.col("source").alias("s1"),
                        F.floor(F.col("n_chars") / 2000).cast("bigint").alias("s2"),
                        F.col("toxic").cast("int").alias("toxic"),
                        F.col("n_chars").cast("double").alias("x_len")))


# ------------------------------------------------------------ SQL (DuckDB)

def sec_sql(end: str, start: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 1000000.0)"


KEYED_EVENTS_SQL = f"""
kev AS (
  SELECT *, user_id AS subject_id, user_id * {KEY_WIDTH} + _b AS stay_id,
         user_id * {KEY_WIDTH} + CAST(floor(_b / {STAYS_PER_ADMISSION}) AS BIGINT) AS hadm_id
  FROM (SELECT *, CAST(floor({sec_sql('ts', f"TIMESTAMP '{ORIGIN}'")} / {STAY_SECONDS}) AS BIGINT) AS _b FROM events)
)"""

STAYS_SQL = KEYED_EVENTS_SQL + f""",
stays AS (
  SELECT subject_id, hadm_id, stay_id,
         TIMESTAMP '{ORIGIN}' + to_days(CAST(_b*5 AS INTEGER)) AS intime, max(ts) AS outtime,
         (SELECT min(e.ts) FROM kev e WHERE e.subject_id = k.subject_id AND e.event_type = 'error'
            AND e._b >= k._b) AS dod
  FROM kev k GROUP BY subject_id, hadm_id, stay_id, _b
)"""

STAY_DETAIL_SQL = STAYS_SQL + f""",
stay_detail AS (
  SELECT s.subject_id, s.hadm_id, s.stay_id, s.intime AS icu_intime, s.intime, s.outtime,
         s.intime = f.first_in AS first_icu_stay, c.c_acctbal AS admission_age,
         CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'F' ELSE 'M' END AS gender,
         r.r_name AS race, c.c_mktsegment, s.dod,
         {sec_sql('s.outtime', 's.intime')} / 86400.0 AS los_icu
  FROM stays s
  JOIN (SELECT subject_id, min(intime) AS first_in FROM stays GROUP BY subject_id) f USING (subject_id)
  LEFT JOIN customer c ON c.c_custkey = s.subject_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)"""

ORDER_LINES_SQL = """
olines AS (
  SELECT l.*, o.o_custkey AS subject_id, o.o_orderdate AS intime, l.l_orderkey AS stay_id, l.l_orderkey AS hadm_id
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
)"""

DOC_UNITS_SQL = """
units AS (
  SELECT d.doc_id AS unit_id, CASE WHEN d.lang <> 'en' THEN 1 ELSE 0 END AS a,
         CAST(l.quality AS INTEGER) AS y, d.source AS s1, CAST(floor(d.n_chars / 2000) AS BIGINT) AS s2,
         CAST(l.toxic AS INTEGER) AS toxic, CAST(d.n_chars AS DOUBLE) AS x_len
  FROM documents d JOIN labels l USING (doc_id)
)"""
