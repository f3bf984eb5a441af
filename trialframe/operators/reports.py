"""Report tables (M1-M7): small aggregated frames behind the reference's
tables and figures (baseline table, forest plots, subgroup boxes, score
comparisons).  Plot drawing and LaTeX export are out of scope."""

from __future__ import annotations

from typing import Mapping, Sequence


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.text import label_from_map


def table_one(df: DataFrame, arm: str, numerical: Sequence[str] = (),
              categorical: Sequence[str] = ()) -> DataFrame:
    """M1: baseline characteristics by arm.

    Numerical rows: n (non-missing), mean, sd, missing count; categorical
    rows: n and percentage of the arm per level.  One unpivot and one
    ``groupBy(variable, level, arm)`` each; the result has a few rows per
    variable whatever the population size.
    """
    out = None
    if numerical:
        long = df.select(F.col(arm).alias("arm"), *[F.col(c).cast("double").alias(c) for c in numerical]) \
                 .unpivot(["arm"], list(numerical), "variable", "x")
        num = long.groupBy("variable", "arm").agg(
            F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
            F.count_if(F.col("x").isNull()).alias("n_missing"))
        out = num.select("variable", F.lit(None).cast("string").alias("level"), "arm", "n", "mean", "sd",
                         "n_missing", F.lit(None).cast("double").alias("pct"))
    if categorical:
        long = df.select(F.col(arm).alias("arm"), *[F.col(c).cast("string").alias(c) for c in categorical]) \
                 .unpivot(["arm"], list(categorical), "variable", "level")
        cnt = long.groupBy("variable", "level", "arm").agg(F.count(F.lit(1)).alias("n"))
        tot = df.groupBy(F.col(arm).alias("arm")).agg(F.count(F.lit(1)).alias("_tot"))
        cat = cnt.join(F.broadcast(tot), "arm").select(
            "variable", "level", "arm", "n", F.lit(None).cast("double").alias("mean"),
            F.lit(None).cast("double").alias("sd"), F.lit(None).cast("bigint").alias("n_missing"),
            (100.0 * F.col("n") / F.col("_tot")).alias("pct"))
        out = cat if out is None else out.unionByName(cat)
    return out


def forest_table(estimates: DataFrame, labels: Mapping[str, str], groups: Mapping[str, str],
                 order: Sequence[str], method_col: str = "estimation_method") -> DataFrame:
    """M3/M4: estimates with display label, group and a custom sort key; rows
    whose method is not in ``order`` are filtered out."""
    sort_key = label_from_map(method_col, {m: i for i, m in enumerate(order)})
    return (estimates.filter(F.col(method_col).isin(list(order)))
                     .withColumn("label", label_from_map(method_col, labels))
                     .withColumn("group", label_from_map(method_col, groups))
                     .withColumn("sort_key", sort_key.cast("int")))


def period_label(hours_col) -> F.Column:
    """``6`` -> ``'06h'``."""
    return F.concat(F.lpad(F.col(hours_col).cast("string"), 2, "0"), F.lit("h"))


def subgroup_summary(df: DataFrame, value: str, features: Sequence[str]) -> DataFrame:
    """Per (binary feature, value): count, mean and exact 5 % / 95 %
    quantiles of a per-unit quantity (e.g. the CATE); the quantiles are
    distributed order statistics (``exact_quantiles``), so a subgroup holding
    most units is never gathered in one task."""
    from trialframe.operators.relational import exact_quantiles
    long = df.select(F.col(value).alias("_v"), *[F.col(c).cast("int").alias(c) for c in features]) \
             .unpivot(["_v"], list(features), "feature", "feature_value")
    mom = long.groupBy("feature", "feature_value").agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    qs = exact_quantiles(long, "_v", {"q05": 0.05, "q95": 0.95}, ["feature", "feature_value"])
    return mom.join(qs, ["feature", "feature_value"], "left")


def metrics_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """M6: wide score rows -> (keys..., metric, value)."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]) \
             .unpivot(list(keys), list(metrics), "metric", "value")


def baseline_tests(df: DataFrame, arm: str, numerical: Sequence[str] = (),
                   categorical: Sequence[str] = ()) -> DataFrame:
    """M1 tests: Welch's t (numerical) and Pearson's chi-square without
    continuity correction (categorical) between the two arms (0/1).

    Per-arm moments and per-level counts are one aggregation each; the test
    statistic and degrees of freedom are column expressions over the few
    aggregated rows.  Zero cells (a level seen in one arm only) are counted.
    """
    out = None
    if numerical:
        long = df.select(F.col(arm).cast("int").alias("_arm"), *[F.col(c).cast("double").alias(c) for c in numerical]) \
                 .unpivot(["_arm"], list(numerical), "variable", "x")
        m = long.groupBy("variable").agg(
            F.count(F.when(F.col("_arm") == 1, F.col("x"))).alias("n1"),
            F.count(F.when(F.col("_arm") == 0, F.col("x"))).alias("n0"),
            F.avg(F.when(F.col("_arm") == 1, F.col("x"))).alias("m1"),
            F.avg(F.when(F.col("_arm") == 0, F.col("x"))).alias("m0"),
            F.var_samp(F.when(F.col("_arm") == 1, F.col("x"))).alias("v1"),
            F.var_samp(F.when(F.col("_arm") == 0, F.col("x"))).alias("v0"))
        s1, s0 = F.try_divide(F.col("v1"), F.col("n1")), F.try_divide(F.col("v0"), F.col("n0"))
        t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(s1 + s0))
        dof = F.try_divide((s1 + s0) ** 2, F.try_divide(s1 ** 2, F.col("n1") - 1) + F.try_divide(s0 ** 2, F.col("n0") - 1))
        out = m.select("variable", F.lit("welch_t").alias("test"), t.alias("statistic"), dof.alias("dof"))
    if categorical:
        long = df.select(F.col(arm).cast("int").alias("_arm"), *[F.col(c).cast("string").alias(c) for c in categorical]) \
                 .unpivot(["_arm"], list(categorical), "variable", "level")
        cells = long.groupBy("variable", "level").agg(F.count_if(F.col("_arm") == 1).alias("o1"),
                                                      F.count_if(F.col("_arm") == 0).alias("o0"))
        tot = cells.groupBy("variable").agg(F.sum("o1").alias("t1"), F.sum("o0").alias("t0"),
                                            F.count(F.lit(1)).alias("n_levels"))
        j = cells.join(tot, "variable")
        n = F.col("t1") + F.col("t0")
        e1 = (F.col("o1") + F.col("o0")) * F.col("t1") / n
        e0 = (F.col("o1") + F.col("o0")) * F.col("t0") / n
        contrib = F.try_divide((F.col("o1") - e1) ** 2, e1) + F.try_divide((F.col("o0") - e0) ** 2, e0)
        chi = j.groupBy("variable").agg(F.sum(contrib).alias("statistic"),
                                        ((F.first("n_levels") - 1) * 1.0).alias("dof"))
        chi = chi.select("variable", F.lit("chi_square").alias("test"), "statistic", "dof")
        out = chi if out is None else out.unionByName(chi)
    return out


def with_p_values(tests: DataFrame) -> DataFrame:
    """Add ``p_value`` to ``baseline_tests`` rows (two-sided t / chi-square
    upper tail).  The input has one row per covariate (a bounded table, a few
    dozen rows at most), so the tail probabilities are evaluated on those rows
    on the driver; no code has to be shipped to the executors."""
    from trialframe.functions.stats import chi2_sf, t_two_sided_p
    rows = tests.collect()
    out = []
    for r in rows:
        stat = None if r["statistic"] is None else float(r["statistic"])
        dof = None if r["dof"] is None else float(r["dof"])
        p = t_two_sided_p(stat, dof) if r["test"] == "welch_t" else chi2_sf(stat, dof)
        out.append((*r, p))
    schema = tests.schema.add("p_value", "double")
    return tests.sparkSession.createDataFrame(out, schema)
