"""Sources/sinks and event extraction on hand-written frames."""

import os
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timestamps import ts
from trialframe.functions.time import floor_days_between, hour_grid, seconds_between
from trialframe.operators import events as EV
from trialframe.session import checkpoint_dir
from trialframe.sources import io as IO


def _folder(spark, name):
    return os.path.join(checkpoint_dir(spark), "test", f"{name}-{uuid.uuid4().hex[:8]}")


def test_log_rows_appends_without_overwrite(spark):
    folder = _folder(spark, "log")
    row = spark.createDataFrame([(0.1, 0.0, 0.2, None, "last", "ipw", "lr", "lr", "All", "c", "y", 1.0)],
                                IO.ESTIMATE_SCHEMA)
    r1, r2 = IO.log_rows(row, folder), IO.log_rows(row, folder)
    assert r1 != r2
    back = IO.read_log(spark, folder)
    assert back.count() == 2 and set(IO.ESTIMATE_SCHEMA.names) <= set(back.columns)


def test_memoise_reuses_materialised_table(spark):
    root = _folder(spark, "memo")
    df = spark.range(10)
    a = IO.memoise(spark, df, "t", {"k": 1}, root=root)
    b = IO.memoise(spark, df, "t", {"k": 1}, root=root)                 # same config and input: read back
    c = IO.memoise(spark, spark.range(3), "t", {"k": 1}, root=root)     # another input
    d = IO.memoise(spark, df, "t", {"k": 2}, root=root)
    assert a.count() == 10 and b.inputFiles() == a.inputFiles() and c.count() == 3
    assert d.inputFiles() != a.inputFiles()


def test_cohort_folder_name_and_config_table(spark):
    cfg = {"cohort_name": "study", "treatment_observation_window_unit_day": 0.25, "min_age": 18}
    assert IO.cohort_folder_name(cfg) == "study__obs_0f25d"
    t = {r.config: r.value for r in IO.config_table(spark, cfg).collect()}
    assert t["min_age"] == "18"


def test_csv_roundtrip_with_schema(spark):
    df = spark.createDataFrame([(1, "a|b", 2.5), (2, None, None)], "k int, s string, v double")
    path = IO.write_csv(df, _folder(spark, "csv"), sep=";", compression="gzip")
    back = IO.read_csv(spark, path, schema=df.schema, sep=";")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_drug_classes_one_pass_multi_class(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), "Red Bolt"), (2, ts("2024-01-02"), "ring"),
                                (3, ts("2024-01-03"), "anvil")], "stay_id bigint, t timestamp_ntz, name string")
    out = EV.drug_class_events(df, "name", {"fastener": ["bolt"], "red": ["^red"], "round": ["ring"]},
                               ["stay_id"], "t")
    got = sorted((r.stay_id, r.code) for r in out.collect())
    assert got == [(1, "fastener"), (1, "red"), (2, "round")]


def test_any_agent_events_flags(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), 0.0, None), (2, ts("2024-01-01"), 0.2, 0.1)],
                               "stay_id bigint, t timestamp_ntz, norepinephrine double, dopamine double")
    out = EV.any_agent_events(df, ["stay_id"], "t", ["norepinephrine", "dopamine"])
    got = sorted((r.stay_id, r.label, r.value) for r in out.collect())
    assert got == [(1, "norepinephrine", 0.0), (2, "dopamine", 1.0), (2, "norepinephrine", 1.0)]


def test_flag_events_keep_index_zero(spark):
    df = spark.createDataFrame([(1, ts("2024-01-01"), 0, 1, 0)], "stay_id bigint, t timestamp_ntz, a int, b int, idx int")
    out = EV.flag_events(df, ["stay_id"], "t", ["a", "b", "idx"], keep_zero=["idx"])
    assert sorted(r.code for r in out.collect()) == ["b", "idx"]


def test_time_helpers(spark):
    df = spark.createDataFrame([(ts("2024-01-01 10:30:00"), ts("2024-01-01 12:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(seconds_between("b", "a").alias("s"), floor_days_between("a", "b").alias("d"),
                  F.size(hour_grid("a", "b", before_hours=2)).alias("n")).first()
    assert r.s == 5400.0 and r.d == -1 and r.n == 4   # ceil(10:30) = 11:00, minus 2 h: 09, 10, 11, 12


def test_covariate_events_shape_each_source(spark):
    from trialframe.operators import events as EV
    pop = spark.createDataFrame([(1, 10, 100, ts("2024-01-02 00:00:00"))],
                                "subject_id long, hadm_id long, stay_id long, inclusion_start timestamp_ntz")
    one = spark.createDataFrame([(100, ts("2024-01-01 00:00:00"), "hr", 1.0), (100, ts("2024-01-03 00:00:00"), "hr", 2.0)],
                                "stay_id long, starttime timestamp_ntz, code string, value double")
    twice = spark.createDataFrame([(100, ts("2024-01-01 00:00:00"), "bp", 3)] * 2,
                                  "stay_id long, starttime timestamp_ntz, code string, value int")
    got = EV.covariate_events([one, twice], pop).collect()
    assert [(r.subject_id, r.stay_id, r.code, r.value) for r in got] == [(1, 100, "hr", 1.0)]


def test_bridge_equals_a_join_for_each_source(spark):
    pop = spark.createDataFrame([(1, 10, 100, ts("2024-01-05")), (1, 11, 101, ts("2024-01-09")), (2, None, 102, ts("2024-01-05"))],
                                "subject_id long, hadm_id long, stay_id long, inclusion_start timestamp_ntz")
    rows = [(1, ts("2024-01-01"), 1.0), (1, ts("2024-01-07"), 2.0), (2, ts("2024-01-01"), 3.0), (2, ts("2024-01-01"), 3.0),
            (None, ts("2024-01-01"), 4.0), (9, ts("2024-01-01"), 5.0)]

    def source(key, base):
        return spark.createDataFrame([(None if k is None else base + k, t, "d", key, v) for k, t, v in rows],
                                     f"{key} long, starttime timestamp_ntz, domain string, code string, value double")

    some = [source("subject_id", 0), source("hadm_id", 9), source("stay_id", 99)]
    got = EV.bridged_events(some, pop)
    want = EV.covariate_events(some, pop)
    assert got.columns == want.columns and want.count() > 3
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    mixed = [some[0].select(F.lit("subject_id").alias("key_kind"), F.col("subject_id").alias("key"), "starttime", "domain", "code", "value")]
    assert EV.bridged_events(mixed, pop).exceptAll(EV.covariate_events(some[:1], pop)).count() == 0
    assert EV.bridged_events([s.limit(0) for s in some], pop).count() == 0


def test_bridged_events_of_repeated_units_and_rows(spark):
    """Repeats within and between the kinds of keys, units that occur twice, null keys and ends; patients' events
    are counted before they meet the units."""
    import datetime
    rng = random.Random(4)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    units = [(rng.choice([1, 2, 3, None]), rng.choice([10, 11, None]), rng.choice([100, 101, 102, None]), rng.choice([day(1), day(3), None]))
             for _ in range(14)]
    pop = spark.createDataFrame(units, "subject_id long, hadm_id long, stay_id long, inclusion_start timestamp_ntz")
    values = {"subject_id": [1, 2, 3, 4, None], "hadm_id": [10, 11, 12, None], "stay_id": [100, 101, 102, None]}
    rows = [(k, rng.choice(values[k]), rng.choice([day(0), day(2), day(4), None]), rng.choice(["a", None]), rng.choice([1.0, None]))
            for k in values for _ in range(40)]
    source = spark.createDataFrame(rows, "key_kind string, key long, starttime timestamp_ntz, code string, value double")
    want = Counter()
    for kind, key, start, code, value in rows:
        for *unit, end in units:
            if key is not None and unit[list(values).index(kind)] == key and start and end and start <= end:
                want[(*unit, start, None, None, code, None, value)] += 1
    once = sorted(str(r) for r, n in want.items() if n == 1)
    few = EV.bridged_events([source], pop)
    assert sorted(str(tuple(r)) for r in few.collect()) == once and 0 < len(once) < len(want)
    distinct = source.distinct()
    assert EV.bridged_events([distinct], pop.distinct()).count() > 0
    plan = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-")) for x in plan if word in x)
    assert depth("Join LeftOuter") < depth("Aggregate")        # nothing is aggregated after patients' events meet the units


def test_csv_log_keeps_one_header(spark):
    folder = _folder(spark, "csvlog")
    rows = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, v double")
    IO.log_rows(rows, folder, fmt="csv")
    IO.log_rows(rows, folder, fmt="csv")
    back = IO.read_log(spark, folder, rows.schema)
    assert back.count() == 4 and back.select("run_id").distinct().count() == 2 and rows.columns == ["name", "v"]
    assert {(r["name"], r["v"]) for r in back.collect()} == {("a", 0.5), ("b", None)}
