"""Feature engineering (J1-J11): events -> unit x feature matrix, scaling,
imputation, deterministic splits and folds.

Statistics needed by every row (means, standard deviations, medians) are
computed by one aggregation and attached through an equi-join on a constant
key whose other side is a single row (explicitly broadcast: its size is one
row), never by an unpartitioned window.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.functions.hashing import hash_rank_key
from trialframe.operators.relational import code_medians, left_null_safe, pivot_codes

# The named sets of percentages.
PERIOD_SETS = {"all": [100, 10, 25, 50, -10, -25, -50], "100": [100]}
SUMMARY = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp, "count": F.count}


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a 1-row frame to every row (broadcast of one row)."""
    return (df.withColumn("_one", F.lit(1))
              .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


# ------------------------------------------------------------------ J1/J4

def feature_subset(events: DataFrame, codes: Sequence[str], code_col: str = "code") -> DataFrame:
    """Keep the events of the chosen feature subset."""
    return events.filter(F.col(code_col).isin(list(codes)))


def patient_matrix(events: DataFrame, units: DataFrame, vocabulary: Sequence[str], aggs: Sequence[str],
                   unit_key: str = "stay_id", order: Sequence[str] = ("starttime",),
                   how: str = "inner") -> DataFrame:
    """Pivot the unit's events with the chosen aggregates (``first``,
    ``last``, ``median``, ...), columns ``{agg}_code_{code}``, then join the
    unit table (statics, treatment, outcome).  Inner by default: a unit
    without any event drops out (S13)."""
    piv = pivot_codes(events, [unit_key], vocabulary, aggs, order=list(order))
    return piv.join(units, unit_key, how)


def typed_aggregation(events: DataFrame, unit_key: str, rules: Mapping[str, Sequence[str]],
                      order: Sequence[str] = ("starttime",)) -> DataFrame:
    """One ``groupBy`` with conditional aggregates: each aggregate type
    (``max``, ``median``, ``last``, ``sum``, ``min``, ``first``) applies to its
    own code list; output columns ``{code}``.  Medians come from ``code_medians``."""
    exprs, medians = [], []
    key = F.struct(*[F.col(c) for c in order])
    for agg, codes in rules.items():
        for code in codes:
            v = F.when(F.col("code") == code, F.col("value"))
            if agg == "last":
                e = F.max_by(v, F.when(F.col("code") == code, key))
            elif agg == "first":
                e = F.min_by(v, F.when(F.col("code") == code, key))
            elif agg == "median":
                medians.append(code)
                continue
            else:
                e = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "count": F.count}[agg](v)
            exprs.append(e.alias(code))
    out = events.groupBy(unit_key).agg(*exprs) if exprs else events.select(unit_key).distinct()
    if medians:
        out = left_null_safe(out, code_medians(events, [unit_key], medians), [unit_key])
    return out.select(unit_key, *[F.col(f"`{c}`") for codes in rules.values() for c in codes])


# ------------------------------------------------------------------ J3

def relative_period_aggregation(events: DataFrame, periods: str | Sequence[int] = "100",
                                aggs: Sequence[str] = tuple(SUMMARY), unit_key: str = "subject_id",
                                vocabulary: Sequence[str] | None = None, time_col: str = "starttime") -> DataFrame:
    """Summaries of the first (p > 0) or last (p < 0) ``|p|`` percent of
    each unit's trajectory, per code; columns ``{agg}_code_{code}__p{p}``.

    A trajectory runs from a unit's first to its last event.  An event at t
    lies in the first p % when ``100 (t - start) <= p (end - start)``, and in
    the last p % when ``100 (end - t) <= p (end - start)``, in whole seconds.
    The events are written once; their bounds are one aggregation and the
    result another, with one conditional aggregate per (code, period).
    ``vocabulary`` gives the codes; without it they are the distinct codes.
    """
    from trialframe.session import cut_lineage
    percents = PERIOD_SETS[periods] if isinstance(periods, str) else list(periods)
    outside = [p for p in percents if not -100 < p <= 100]
    if outside:
        raise ValueError(f"percentages must lie above -100 and at most at 100: {outside}")
    ev = events.select(unit_key, F.col(time_col).alias("_t"), "code", "value")
    ev = cut_lineage(ev if vocabulary is None else ev.filter(F.col("code").isin(list(vocabulary))))
    codes = list(vocabulary) if vocabulary is not None else sorted(r["code"] for r in ev.select("code").distinct().collect())
    bounds = ev.groupBy(unit_key).agg(F.min("_t").alias("_start"), F.max("_t").alias("_end"))
    seconds = lambda a, b: F.timestamp_diff("SECOND", F.col(a), F.col(b))  # noqa: E731  (whole seconds, as a duration's)
    j = ev.join(bounds, unit_key).select(unit_key, "code", "value", seconds("_start", "_t").alias("_since"),
                                         seconds("_start", "_end").alias("_span"))
    inside = {p: (F.col("_since") if p > 0 else F.col("_span") - F.col("_since")) * 100 <= abs(p) * F.col("_span")
              for p in percents}
    out = []
    for code in codes:
        for p in percents:
            here = (F.col("code") == code) & inside[p]
            value = F.when(here, F.col("value"))
            for a in aggs:
                x = SUMMARY[a](value)
                # No event in the period: unknown, not 0.
                out.append((F.when(F.max(here), x) if a == "count" else x).alias(f"{a}_code_{code}__p{p}"))
    return j.groupBy(unit_key).agg(*out)


# ------------------------------------------------------------------ J5-J8

def normalise_by_weight(df: DataFrame, value_col: str, weight_col: str, default_weight: float = 70.0,
                        out_col: str | None = None) -> DataFrame:
    """J5 (S16): ``value / coalesce(weight, default)``."""
    return df.withColumn(out_col or value_col,
                         F.col(value_col) / F.coalesce(F.col(weight_col), F.lit(default_weight)))


def column_stats(df: DataFrame, cols: Sequence[str], medians: str | None = "exact") -> DataFrame:
    """One row: null-skipping mean, population std and (unless ``medians`` is
    None) median per column.

    Moments are one aggregation.  Exact medians are distributed order
    statistics over the unpivoted columns (``exact_quantiles``: no task holds a
    whole column); ``medians="approx"`` uses ``percentile_approx``."""
    from trialframe.operators.relational import exact_quantiles
    exprs = []
    for c in cols:
        exprs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    if medians == "approx":
        exprs += [F.percentile_approx(c, 0.5, 10000).alias(f"{c}__median") for c in cols]
    mom = df.groupBy().agg(*exprs)
    if medians != "exact":
        return mom
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_var", "_x")
    med = exact_quantiles(long, "_x", {"m": 0.5}, ["_var"])
    row = med.groupBy().pivot("_var", list(cols)).agg(F.first("m"))
    row = row.select(*[F.col(f"`{c}`").alias(f"{c}__median") for c in cols])
    return attach_row(mom, row)


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std_pop`` with null-skipping statistics (a zero std
    leaves ``x - mean``, as a scaler does)."""
    st = stats if stats is not None else column_stats(df, cols, medians=None)
    j = attach_row(df, st.select(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols]))
    out = j.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) /
                         F.when(F.col(f"{c}__std") == 0, 1.0).otherwise(F.col(f"{c}__std")) for c in cols})
    return out.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def impute_median(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Nulls replaced by the column median."""
    st = stats if stats is not None else column_stats(df, cols)
    j = attach_row(df, st.select(*[f"{c}__median" for c in cols]))
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__median")) for c in cols}) \
            .drop(*[f"{c}__median" for c in cols])


def design_matrix(df: DataFrame, numerical: Sequence[str] = (), binary: Sequence[str] = (),
                  categorical: Mapping[str, Sequence] | None = None, passthrough: Sequence[str] = ()) -> DataFrame:
    """J8 (S10): numerical -> standardise then median-impute (the median of
    the standardised column), binary -> null to 0, categorical -> one-hot with
    unknown ignored, passthrough untouched.

    One aggregation gives every statistic: standardising is monotone and
    affine, so the median of the standardised column is
    ``(median - mean) / std``."""
    out = df
    if numerical:
        # the statistics are one fixed-size row (3 numbers per column): taken
        # once and inlined as literals, so the plan below does not carry (and
        # re-run) the aggregation wherever the matrix is read
        st = column_stats(df, numerical).first()
        z = {}
        for c in numerical:
            mean, std, med = st[f"{c}__mean"], st[f"{c}__std"], st[f"{c}__median"]
            sd = 1.0 if not std else float(std)
            mean = 0.0 if mean is None else float(mean)
            zc = (F.col(c) - F.lit(mean)) / F.lit(sd)
            zmed = F.lit(None).cast("double") if med is None else F.lit((float(med) - mean) / sd)
            z[c] = F.coalesce(zc, zmed)
        out = df.withColumns(z)
    if binary:
        out = out.fillna({b: 0 for b in binary})
    for col, cats in (categorical or {}).items():
        out = out.select("*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{col}_{v}") for v in cats]).drop(col)
    keep = [*passthrough, *numerical, *binary,
            *[f"{col}_{v}" for col, cats in (categorical or {}).items() for v in cats]]
    return out.select(*keep)


# ------------------------------------------------------------------ J9-J11

def hash_ranks(df: DataFrame, id_col: str, strata: Sequence[str], seed: int,
               bucket_bits: int = 16) -> DataFrame:
    """Exact rank (0-based) of every row within its stratum in the order of
    ``(md5(id|seed), id)``, without a window over a whole stratum.

    The hash's top ``bucket_bits`` bits define buckets; bucket counts per
    stratum are a small table (<= strata x 2^bits rows) whose prefix sums give
    each bucket's offset; the rank is offset + rank inside the bucket (a window
    over ~n / 2^bits rows).  Adds ``_n`` (stratum size) and ``_rank``.
    """
    h = hash_rank_key(F.col(id_col), F.lit(seed))
    x = df.withColumn("_h", h).withColumn("_bucket", F.shiftright("_h", 32 - bucket_bits))
    sk = list(strata)
    counts = x.groupBy(*sk, "_bucket").agg(F.count(F.lit(1)).alias("_bn"))
    wcum = Window.partitionBy(*sk).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*sk)
    offs = counts.select(*sk, "_bucket", F.coalesce(F.sum("_bn").over(wcum), F.lit(0)).alias("_off"),
                         F.sum("_bn").over(wall).alias("_n"))
    inner = Window.partitionBy(*sk, "_bucket").orderBy("_h", id_col)
    return (x.join(offs, [*sk, "_bucket"])
             .withColumn("_rank", F.col("_off") + F.row_number().over(inner) - 1)
             .drop("_h", "_bucket", "_off"))


def stratified_split(df: DataFrame, id_col: str, strata: Sequence[str], test_fraction: float,
                     seed: int = 0) -> DataFrame:
    """``split`` = 'test' for the first ``round(f * n_s)`` units of each
    stratum in hash order, else 'train' (exact proportions per stratum)."""
    r = hash_ranks(df, id_col, strata, seed)
    k = F.round(F.col("_n") * F.lit(test_fraction))
    return r.withColumn("split", F.when(F.col("_rank") < k, "test").otherwise("train")).drop("_rank", "_n")


def assign_folds(df: DataFrame, id_col: str, strata: Sequence[str], k: int = 5, seed: int = 0,
                 out_col: str = "fold") -> DataFrame:
    """Stratified k-fold id = rank-in-stratum (hash order) mod k."""
    r = hash_ranks(df, id_col, strata, seed)
    return r.withColumn(out_col, (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def check_binary_treatment(df: DataFrame, col: str = "a") -> DataFrame:
    """Value counts of the treatment; raises ``ValueError`` when a value
    other than 0/1 occurs (the check reads at most 3 grouped rows)."""
    counts = df.groupBy(F.col(col).alias("treatment")).agg(F.count(F.lit(1)).alias("n"))
    bad = counts.filter(~F.col("treatment").isin(0, 1) | F.col("treatment").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"treatment column {col!r} must be binary 0/1, found {bad[0]['treatment']!r}")
    return counts
