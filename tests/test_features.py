"""Relative-period aggregation and design matrix against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timestamps import ts
from trialframe.operators import features as FE


def test_relative_periods_first_and_last_fraction(spark):
    rows = [(1, ts("2024-01-01 00:00:00"), "hr", 1.0), (1, ts("2024-01-01 01:00:00"), "hr", 2.0),
            (1, ts("2024-01-01 05:00:00"), "hr", 3.0), (1, ts("2024-01-01 10:00:00"), "hr", 4.0),
            (2, ts("2024-01-01 00:00:00"), "hr", 9.0)]                       # single-event unit
    ev = spark.createDataFrame(rows, "subject_id int, starttime timestamp_ntz, code string, value double")
    out = FE.relative_period_aggregation(ev, [100, 10, 50, -10, -50], ["max", "count"], vocabulary=["hr"])
    r = {x.subject_id: x.asDict() for x in out.collect()}
    assert r[1]["count_code_hr__p100"] == 4
    assert r[1]["max_code_hr__p10"] == 2.0           # first 10 % of 10 h = first hour, inclusive
    assert r[1]["max_code_hr__p50"] == 3.0
    assert r[1]["max_code_hr__p-10"] == 4.0 and r[1]["count_code_hr__p-10"] == 1
    assert r[1]["count_code_hr__p-50"] == 2
    assert r[2]["count_code_hr__p10"] == 1           # zero-length trajectory keeps its event
    with pytest.raises(ValueError):
        FE.relative_period_aggregation(ev, [-100])


def test_design_matrix_standardise_then_impute(spark):
    df = spark.createDataFrame([(1, 1.0, None, "A"), (2, 3.0, 1, "B"), (3, None, 0, "Z")],
                               "id int, x double, b int, c string")
    out = FE.design_matrix(df, numerical=["x"], binary=["b"], categorical={"c": ["A", "B"]}, passthrough=["id"])
    r = {x.id: x.asDict() for x in out.collect()}
    assert r[1]["x"] == pytest.approx(-1.0) and r[2]["x"] == pytest.approx(1.0)
    assert r[3]["x"] == pytest.approx(0.0)       # median of the standardised column
    assert r[1]["b"] == 0 and r[3]["c_A"] == 0 and r[3]["c_B"] == 0


@pytest.mark.parametrize("n_parts", [1, 3, 7])
def test_exact_quantiles_match_percentile(spark, n_parts):
    from trialframe.operators.relational import exact_quantiles
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 1500, p=[.7, .2, .1]),
                        "v": np.round(rng.normal(size=1500), 1)})
    pdf.loc[:500, "v"] = 1.0                         # a value held by a third of the rows
    pdf.loc[1400:, "v"] = None
    df = spark.createDataFrame(pdf)
    probs = {"q0": 0.0, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q1": 1.0}
    got = exact_quantiles(df, "v", probs, ["g"], n_parts=n_parts).toPandas() \
        .set_index("g").sort_index()
    ref = (df.groupBy("g").agg(*[F.percentile("v", p).alias(k) for k, p in probs.items()])
             .toPandas().set_index("g").sort_index())
    assert np.allclose(got[list(probs)].to_numpy(), ref[list(probs)].to_numpy())
    g = exact_quantiles(df, "v", probs, [], n_parts=n_parts).toPandas()
    r = df.agg(*[F.percentile("v", p).alias(k) for k, p in probs.items()]).toPandas()
    assert np.allclose(g[list(probs)].to_numpy(), r[list(probs)].to_numpy())


def test_column_stats_match_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(size=500), "z": np.r_[rng.normal(size=400), [None] * 100]})
    got = FE.column_stats(spark.createDataFrame(pdf), ["x", "z"]).first().asDict()
    for c in ("x", "z"):
        v = pdf[c].dropna().astype(float)
        assert got[f"{c}__mean"] == pytest.approx(v.mean()) and got[f"{c}__std"] == pytest.approx(v.std(ddof=0))
        assert got[f"{c}__median"] == pytest.approx(v.median())
    assert "x__median" not in FE.column_stats(spark.createDataFrame(pdf), ["x"], medians=None).columns
