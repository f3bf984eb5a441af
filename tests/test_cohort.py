"""Cohort semantics S1-S9 on hand-written frames."""

from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from timestamps import ts
from trialframe.operators import cohort as C
from trialframe.operators import relational as R

STAYS = "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz"
EV = "stay_id bigint, starttime timestamp_ntz, event_id bigint"


def stays(spark):
    return spark.createDataFrame([
        (1, 10, 100, ts("2024-01-01 00:00:00")),
        (1, 10, 101, ts("2024-02-01 00:00:00")),
        (2, 20, 200, ts("2024-01-01 00:00:00")),
        (3, 30, 300, ts("2024-01-01 00:00:00")),
    ], STAYS)


def test_inclusion_window_inclusive_both_ends(spark):
    ev = spark.createDataFrame([
        (100, ts("2024-01-02 00:00:00"), 1),            # exactly 24 h -> kept
        (200, ts("2024-01-02 00:00:00.000001"), 2),     # 1 us over -> dropped
        (300, ts("2023-12-31 23:59:59"), 3),            # before intime -> dropped
        (300, ts("2024-01-01 12:00:00"), 4),            # but the FIRST event decides (S1)
        (101, ts("2024-02-01 00:00:00"), 5),            # exactly at intime -> kept
    ], EV)
    out = {r.stay_id for r in C.first_event_in_window(ev, stays(spark), 1.0).collect()}
    assert out == {100, 101}


def test_treatment_first_then_filter(spark):
    pop = spark.createDataFrame([
        (1, 10, 100, ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:00")),
        (2, 20, 200, ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:00")),
        (3, 30, 300, ts("2024-01-01 00:00:00"), ts("2024-01-01 06:00:00")),
    ], STAYS + ", inclusion_start timestamp_ntz")
    trt = spark.createDataFrame([
        (100, ts("2024-01-01 05:00:00"), 1),   # first dose before inclusion -> control (S2)
        (100, ts("2024-01-01 08:00:00"), 2),   # a later qualifying dose does not count
        (200, ts("2024-01-01 06:00:00"), 3),   # equal to inclusion: strictly after required
        (300, ts("2024-01-01 07:00:00"), 4),   # treated
    ], EV)
    out = {r.stay_id: r.intervention_status for r in C.assign_intervention(pop, trt, 1.0).collect()}
    assert out == {100: 0, 200: 0, 300: 1}


def test_outcome_floor_days(spark):
    df = spark.createDataFrame([
        (1, ts("2024-01-10 00:00:00"), ts("2024-01-08 12:00:00")),   # -1.5 d -> floor -2 -> death
        (2, ts("2024-01-10 00:00:00"), None),                         # alive
        (3, ts("2024-01-10 00:00:00"), ts("2024-02-08 00:00:00")),   # 29 d -> no
        (4, ts("2024-01-10 00:00:00"), ts("2024-02-07 23:59:59")),   # 28.99 d -> floor 28 -> yes
    ], "id int, inclusion_start timestamp_ntz, dod timestamp_ntz")
    out = {r.id: r.m28 for r in C.outcome_horizon(df, {"m28": 28}).collect()}
    assert out == {1: 1, 2: 0, 3: 0, 4: 1}


def test_base_population_survival_hours(spark):
    sd = spark.createDataFrame([
        (1, 10, 100, ts("2024-01-01"), True, 30.0, "F", "WHITE", 2.0, ts("2024-01-01 23:00:00")),
        (1, 11, 101, ts("2024-03-01"), False, 30.0, "F", "WHITE", 2.0, None),
        (2, 20, 200, ts("2024-01-01"), True, 30.0, "M", "BLACK", 2.0, ts("2024-01-02 00:00:00")),
        (3, 30, 300, ts("2024-01-01"), True, 10.0, "M", "WHITE", 2.0, None),
    ], "subject_id bigint, hadm_id bigint, stay_id bigint, icu_intime timestamp_ntz, first_icu_stay boolean, "
       "admission_age double, gender string, race string, los_icu double, dod timestamp_ntz")
    out = C.base_population(sd, min_age=18, min_los_days=1, min_survival_days=1)
    rows = {r.stay_id: (r.Female, r.White) for r in out.collect()}
    # patient 1 dies after 23 h (< 24 h), patient 3 is too young
    assert rows == {200: (0, 0)}


def test_roll_inclusion_requires_inclusion_event(spark):
    with pytest.raises(ValueError):
        C.roll_inclusion(stays(spark), {"a": stays(spark).select("stay_id")})


def test_roll_and_attrition(spark):
    st = stays(spark)
    crit = OrderedDict([("c1", st.filter("stay_id <> 300").select("stay_id")),
                        (C.INCLUSION_EVENT, st.filter("stay_id IN (100, 300)").select("stay_id"))])
    pop, steps = C.roll_inclusion(st, crit)
    assert {r.stay_id for r in pop.collect()} == {100}
    got = sorted((r.step_no, r.subject_id) for r in steps.collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (2, 1)]
    flags = C.patient_flags(OrderedDict([("init", st), ("c1", st.filter("subject_id <> 3")),
                                         ("c2", st.filter("subject_id = 1"))]))
    att = C.attrition(flags.withColumn("_mask", F.shiftright("_mask", 1)), ["c1", "c2"])
    rows = {r.step_no: (r.n_input, r.n_kept, r.n_excluded) for r in att.collect()}
    assert rows == {1: (3, 2, 1), 2: (2, 1, 1)}
    for r in rows.values():
        assert r[1] + r[2] == r[0]


def test_drop_all_duplicated_removes_every_copy(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "c"), (3, "c")], "k int, v string")
    assert [tuple(r) for r in R.drop_all_duplicated(df).collect()] == [(2, "b")]


def test_first_last_tiebreak_deterministic(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), 2, 5.0), (1, ts("2024-01-01"), 1, None),
                                (1, ts("2024-01-02"), 0, 7.0)], "k int, t timestamp_ntz, tb int, v double")
    f = R.first_last(df, "k", ["t", "tb"], ["v"], "first").collect()[0]
    last = R.first_last(df, "k", ["t", "tb"], ["v"], "last").collect()[0]
    assert f.v is None and last.v == 7.0     # the first row's null value is kept


def test_key_precedence_and_no_lower_bound(spark):
    pop = spark.createDataFrame([(1, 10, 100, ts("2024-01-05"))],
                                "subject_id bigint, hadm_id bigint, stay_id bigint, inclusion_start timestamp_ntz")
    ev = spark.createDataFrame([(10, ts("2023-12-01"), "x", 1.0),      # long before: still kept (S6)
                                (10, ts("2024-01-06"), "x", 2.0)],     # after inclusion: dropped
                               "hadm_id bigint, starttime timestamp_ntz, code string, value double")
    out = R.observation_window(ev, pop).collect()
    assert [(r.subject_id, r.stay_id, r.value) for r in out] == [(1, 100, 1.0)]


def test_flagship_with_extra_criteria_rolls(spark):
    from trialframe.plans import fixtures as X
    from trialframe.plans.q_cohort import cohort_e_population
    sf = "/root/testdata/sf0.001"
    base = cohort_e_population(spark, sf)
    sd = X.stay_detail(spark, sf)
    crit = {"long_stay": sd.filter(F.col("los_icu") >= 4.5).select("stay_id")}
    rolled = cohort_e_population(spark, sf, extra_criteria=crit)
    want = base.join(crit["long_stay"], "stay_id", "left_semi")
    assert sorted(map(tuple, rolled.collect())) == sorted(map(tuple, want.select(*rolled.columns).collect()))
    assert 0 < rolled.count() < base.count()
