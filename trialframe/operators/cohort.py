"""Cohort framing (H1-H16): population, inclusion event, criteria roll,
intervention assignment, outcomes, attrition.

Units are stays (``stay_id``) nested in admissions and patients.  Every step is
a lazy DataFrame transform; nothing is collected.  Per-step patient ids are
kept as a long table built from one bit-mask aggregation instead of one
collect per criterion.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field, asdict
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.time import seconds_between, floor_days_between, days_between, hours_between
from trialframe.operators.relational import code_medians, first_last, left_null_safe, top1_per_group

INCLUSION_EVENT = "inclusion_event"


@dataclass(frozen=True)
class CohortConfig:
    """Configuration of one target-trial cohort."""
    cohort_name: str = "cohort"
    min_age: float | None = None
    min_los_icu_unit_day: float | None = None
    min_icu_survival_unit_day: float | None = None
    treatment_observation_window_unit_day: float = 1.0
    first_stay_only: bool = False
    outcome_horizons: Mapping[str, int] = field(default_factory=lambda: {"mortality_28days": 28,
                                                                         "mortality_90days": 90})
    save_cohort: bool = False

    def as_dict(self) -> dict:
        d = asdict(self)
        d["outcome_horizons"] = dict(self.outcome_horizons)
        return d


# ------------------------------------------------------------------ H1

def base_population(stay_detail: DataFrame, min_age: float | None = 18,
                    min_los_days: float | None = 1, min_survival_days: float | None = 1,
                    survival_hours: float | None = None, first_stay_only: bool = True,
                    white_pattern: str = "white") -> DataFrame:
    """H1: first ICU stay per patient, age / length-of-stay / survival filters,
    ``Female`` and ``White`` flags.

    Survival is ``hours(dod - icu_intime) >= 24 * min_survival_days`` (the
    documented intent, S5) or a null ``dod``; ``survival_hours`` overrides it.
    """
    df = stay_detail
    if first_stay_only:
        df = df.filter(F.col("first_icu_stay"))
    if min_age is not None:
        df = df.filter(F.col("admission_age") >= F.lit(min_age))
    if first_stay_only:
        df = top1_per_group(df, "subject_id", ["icu_intime", "stay_id"])
    df = df.withColumns({
        "Female": F.when(F.col("gender") == "F", 1).otherwise(0),
        "White": F.when(F.lower(F.col("race")).contains(white_pattern.lower()), 1).otherwise(0),
    })
    if min_los_days is not None:
        df = df.filter(F.col("los_icu") >= F.lit(min_los_days))
    hours = survival_hours if survival_hours is not None else (
        None if min_survival_days is None else 24.0 * min_survival_days)
    if hours is not None:
        alive = (hours_between("dod", "icu_intime") >= F.lit(hours)) | F.col("dod").isNull()
        df = df.filter(alive)
    return df


# ------------------------------------------------------------------ H2

def first_event_in_window(events: DataFrame, stays: DataFrame, window_days: float,
                          time_col: str = "starttime", tiebreak: Sequence[str] = (),
                          out_col: str = "inclusion_start") -> DataFrame:
    """H2 (S1): first qualifying event per stay, kept when
    ``0 <= event - intime <= window_days * 86400 s`` (both ends inclusive).

    ``events`` is already restricted to the qualifying codes and carries
    ``stay_id``; the first event is found per stay *before* the join with the
    stays, so only one row per stay is shuffled to the join.
    """
    first = first_last(events, "stay_id", [time_col, *tiebreak], [time_col]).withColumnRenamed(time_col, out_col)
    j = first.join(stays.select("stay_id", "intime"), "stay_id")
    delta = seconds_between(out_col, "intime")
    return (j.filter((delta >= 0) & (delta <= F.lit(window_days * 86400.0)))
             .select("stay_id", out_col))


def include_in_window(stays: DataFrame, first_col: str, window_days: float, intime_col: str = "intime",
                      out_col: str = "inclusion_start") -> DataFrame:
    """H2 on a stay table that already carries the first qualifying time
    (``first_col``, e.g. from one fused per-stay aggregation)."""
    delta = seconds_between(first_col, intime_col)
    return (stays.filter((delta >= 0) & (delta <= F.lit(window_days * 86400.0)))
                 .withColumnRenamed(first_col, out_col))


# ------------------------------------------------------------------ H3

def roll_inclusion(stays: DataFrame, criteria: "OrderedDict[str, DataFrame] | Mapping[str, DataFrame]",
                   unit: str = "stay_id", subject: str = "subject_id"):
    """H3: successive inner joins of the criteria on the unit key.

    Returns ``(population, step_ids)``; ``step_ids`` is a long table
    ``(step_no, criterion, subject_id)`` with the distinct patients remaining
    after each step (step 0 = ``initial``), computed from one aggregation of a
    per-stay bit mask, not from one collect per step.
    """
    if INCLUSION_EVENT not in criteria:
        raise ValueError("an inclusion_event frame must be in the inclusion criteria")
    names = list(criteria.keys())
    pop = stays
    for name in names:
        c = criteria[name]
        extra = [x for x in c.columns if x == unit or x not in pop.columns]
        pop = pop.join(c.select(*extra), unit, "inner")
    step_ids = criteria_steps(stays, criteria, unit, subject)
    return pop, step_ids


def criteria_flags(stays: DataFrame, criteria: Mapping[str, DataFrame], unit: str = "stay_id",
                   subject: str = "subject_id") -> DataFrame:
    """Per unit: ``_mask`` with bit k set when the unit passes criterion k.

    One union of the criteria's unit ids and one aggregation (one shuffle),
    whatever the number of criteria.
    """
    names = list(criteria.keys())
    marks = None
    for k, name in enumerate(names):
        m = criteria[name].select(unit).withColumn("_bit", F.lit(1 << k).cast("bigint"))
        marks = m if marks is None else marks.unionByName(m)
    mask = marks.groupBy(unit).agg(F.bit_or("_bit").alias("_mask"))
    return (stays.select(unit, subject).join(mask, unit, "left")
                 .withColumn("_mask", F.coalesce("_mask", F.lit(0).cast("bigint"))))


def criteria_steps(stays: DataFrame, criteria: Mapping[str, DataFrame], unit: str = "stay_id",
                   subject: str = "subject_id") -> DataFrame:
    names = list(criteria.keys())
    flags = criteria_flags(stays, criteria, unit, subject)
    steps = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(n).alias("criterion"),
                               F.lit((1 << k) - 1).cast("bigint").alias("need"))
                      for k, n in enumerate(["initial", *names])])
    ex = flags.select(subject, "_mask", F.explode(steps).alias("s"))
    passed = ex.filter((F.col("_mask").bitwiseAND(F.col("s.need"))) == F.col("s.need"))
    return passed.select(F.col("s.step_no").alias("step_no"), F.col("s.criterion").alias("criterion"),
                         subject).distinct()


# ------------------------------------------------------------------ H4

def assign_intervention(population: DataFrame, treatment_events: DataFrame, window_days: float,
                        time_col: str = "starttime", tiebreak: Sequence[str] = (),
                        intime_col: str = "intime", inclusion_col: str = "inclusion_start") -> DataFrame:
    """H4 (S2): the *first* treatment event of the stay, then kept only if it
    is inside ``[0, window]`` from ``intime`` and strictly after inclusion.
    A stay whose first dose falls outside stays a control.
    """
    first = (first_last(treatment_events.join(population.select("stay_id"), "stay_id", "left_semi"),
                        "stay_id", [time_col, *tiebreak], [time_col])
             .withColumnRenamed(time_col, "_first_trt"))
    return assign_from_first(population.join(first, "stay_id", "left"), "_first_trt", window_days,
                             intime_col, inclusion_col)


def assign_from_first(population: DataFrame, first_col: str, window_days: float, intime_col: str = "intime",
                      inclusion_col: str = "inclusion_start") -> DataFrame:
    """H4 when the first treatment time per stay is already a column."""
    delta = seconds_between(first_col, intime_col)
    ok = (delta >= 0) & (delta <= F.lit(window_days * 86400.0)) & (F.col(first_col) > F.col(inclusion_col))
    return (population.withColumn("intervention_start", F.when(ok, F.col(first_col)))
                      .withColumn("intervention_status", F.col("intervention_start").isNotNull().cast("int"))
                      .drop(first_col))


# ------------------------------------------------------------------ H5

def outcome_horizon(population: DataFrame, horizons: Mapping[str, int], dod_col: str = "dod",
                    start_col: str = "inclusion_start") -> DataFrame:
    """H5 (S3/S4): death within ``h`` days = ``dod`` not null and
    ``floor((dod - start) / 1 day) <= h``."""
    d = floor_days_between(dod_col, start_col)
    return population.withColumns({
        name: (F.col(dod_col).isNotNull() & (d <= F.lit(h))).cast("int") for name, h in horizons.items()})


# ------------------------------------------------------------------ H7-H9

def attrition(flags: DataFrame, names: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """H7: selection flowchart counts at the patient level.

    ``flags`` has one row per (subject, criterion mask) as produced by
    ``patient_flags``; per step: patients entering, kept, excluded.  A
    patient passes step k when it passes every criterion up to k (running
    intersection).  One exploded aggregation over the flag table.
    """
    k = len(names)
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(n).alias("criterion"),
                               F.lit((1 << i) - 1).cast("bigint").alias("prev"),
                               F.lit((1 << (i + 1)) - 1).cast("bigint").alias("need"))
                      for i, n in enumerate(names)])
    ex = flags.select("_mask", F.explode(steps).alias("s"))
    inp = (F.col("_mask").bitwiseAND(F.col("s.prev")) == F.col("s.prev"))
    kept = (F.col("_mask").bitwiseAND(F.col("s.need")) == F.col("s.need"))
    return (ex.groupBy(F.col("s.step_no").alias("step_no"), F.col("s.criterion").alias("criterion"))
              .agg(F.count_if(inp).alias("n_input"), F.count_if(kept).alias("n_kept"),
                   F.count_if(inp & ~kept).alias("n_excluded")))


def patient_flags(criteria: Mapping[str, DataFrame], subject: str = "subject_id") -> DataFrame:
    """Per patient: bit k set when the patient is in criterion k's id set
    (criteria given as frames holding ``subject``)."""
    marks = None
    for k, name in enumerate(criteria):
        m = criteria[name].select(subject).withColumn("_bit", F.lit(1 << k).cast("bigint"))
        marks = m if marks is None else marks.unionByName(m)
    return marks.groupBy(subject).agg(F.bit_or("_bit").alias("_mask"))


def final_split(population: DataFrame, status_col: str = "intervention_status",
                subject: str = "subject_id") -> DataFrame:
    """H8: treated / control counts of the final population (units and patients)."""
    return (population.groupBy(F.col(status_col).alias("intervention_status"))
                      .agg(F.count(F.lit(1)).alias("n_units"),
                           F.countDistinct(subject).alias("n_patients")))


def excluded_profile(flags: DataFrame, names: Sequence[str], characteristics: DataFrame,
                     columns: Sequence[str], subject: str = "subject_id") -> DataFrame:
    """H9: mean characteristics of the patients excluded at each step."""
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(n).alias("criterion"),
                               F.lit((1 << i) - 1).cast("bigint").alias("prev"),
                               F.lit((1 << (i + 1)) - 1).cast("bigint").alias("need"))
                      for i, n in enumerate(names)])
    ex = flags.join(characteristics.select(subject, *columns), subject, "left") \
              .select("_mask", *columns, F.explode(steps).alias("s"))
    excl = ((F.col("_mask").bitwiseAND(F.col("s.prev")) == F.col("s.prev"))
            & (F.col("_mask").bitwiseAND(F.col("s.need")) != F.col("s.need")))
    return (ex.filter(excl)
              .groupBy(F.col("s.step_no").alias("step_no"), F.col("s.criterion").alias("criterion"))
              .agg(F.count(F.lit(1)).alias("n_excluded"),
                   *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns]))


# ------------------------------------------------------------------ H10-H11

def cohort_deltas(population: DataFrame, ref_col: str = "intime",
                  targets: Sequence[str] = ("dod", "intervention_start", "inclusion_start")) -> DataFrame:
    """Fractional days from ``ref_col`` to each target (null stays null)
    (the reference's ``add_delta`` lost its result; this returns it)."""
    return population.withColumns({f"delta_{t}_days": days_between(t, ref_col) for t in targets})


def first_event_multi_window(events: DataFrame, stays: DataFrame, windows_days: Sequence[float],
                             time_col: str = "starttime", tiebreak: Sequence[str] = ()) -> DataFrame:
    """The inclusion step under several observation windows in one pass.

    The first event per stay is computed once; each stay row is then tested
    against every window of a literal array (``explode`` of a bounded list, no
    join), giving ``(window_days, stay_id, inclusion_start)``.
    """
    first = first_last(events, "stay_id", [time_col, *tiebreak], [time_col]).withColumnRenamed(time_col, "inclusion_start")
    j = first.join(stays.select("stay_id", "intime"), "stay_id")
    w = j.select("*", F.explode(F.array(*[F.lit(float(x)) for x in windows_days])).alias("window_days"))
    delta = seconds_between("inclusion_start", "intime")
    return (w.filter((delta >= 0) & (delta <= F.col("window_days") * 86400.0))
             .select("window_days", "stay_id", "inclusion_start", "intime"))


# ------------------------------------------------------------------ H12-H16

def early_flag(measurements: DataFrame, stays: DataFrame, hours: float,
               thresholds: Mapping[str, float], time_col: str = "starttime",
               key: str = "stay_id", exact: bool = True) -> DataFrame:
    """Per stay, median of each source's measurement within the first
    ``hours`` after intime; flag when any source's median is below its
    threshold.  ``measurements`` is long: (key, code, value, time).

    ``exact=False`` swaps the exact median for ``percentile_approx`` (bounded
    memory per group) for very large groups.
    """
    j = measurements.join(stays.select(key, "intime"), key)
    d = seconds_between(time_col, "intime")
    w = j.filter((d >= 0) & (d <= F.lit(hours * 3600.0)))
    codes = list(thresholds)
    if exact:
        kept = w.filter(F.col("code").isin(codes))
        per = left_null_safe(kept.select(key).distinct(), code_medians(kept, [key], codes), [key])
    else:
        per = (w.filter(F.col("code").isin(codes)).groupBy(key)
                .pivot("code", codes).agg(F.percentile_approx("value", 0.5, 10000)))
    cond = None
    for c, t in thresholds.items():
        x = F.coalesce(F.col(f"`{c}`") < F.lit(t), F.lit(False))
        cond = x if cond is None else (cond | x)
    return per.select(key, *[F.col(f"`{c}`").alias(f"median_{c}") for c in codes],
                      cond.cast("int").alias("early_flag"))


def first_exposure(sources: Sequence[DataFrame], key: str = "hadm_id", time_col: str = "starttime") -> DataFrame:
    """Union of exposure sources (each ``key, time_col``), first time per key."""
    u = sources[0].select(key, time_col)
    for s in sources[1:]:
        u = u.unionByName(s.select(key, time_col))
    return u.groupBy(key).agg(F.min(time_col).alias("first_exposure"))
