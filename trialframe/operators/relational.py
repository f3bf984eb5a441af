"""Relational building blocks shared by the cohort, event and feature operators.

Design rules applied throughout:
* "first/last row per group" is an aggregate (``min_by``/``max_by`` over a
  struct ordering with a total tie-break), not a sort or a ranking window:
  it is partially aggregated map-side, so a group holding a third of all rows
  is reduced before the shuffle and never sorted in one task;
* code lists and dictionaries given as Python literals are broadcast (their
  size is the literal's size); data-sized frames are left to AQE, which
  broadcasts only below ``spark.sql.autoBroadcastJoinThreshold``;
* pivots always take an explicit vocabulary (no extra distinct job, stable
  output schema).
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cols(xs) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


# ------------------------------------------------------------ first / last

def first_last(df: DataFrame, by, order, values, which: str = "first",
               suffix: str | None = None) -> DataFrame:
    """value(s) of the first (or last) row per group in ``order``.

    ``order`` must be a total order (append a tie-break key); a null value of
    the chosen row is kept, as a sort-then-take would.
    """
    by, order, values = _cols(by), _cols(order), _cols(values)
    key = F.struct(*[F.col(c) for c in order])
    payload = F.struct(*[F.col(c).alias(c) for c in values])
    pick = F.min_by if which == "first" else F.max_by
    out = df.groupBy(*by).agg(pick(payload, key).alias("_pick"))
    sfx = "" if suffix is None else suffix
    return out.select(*by, *[F.col(f"_pick.{c}").alias(f"{c}{sfx}") for c in values])


def top1_per_group(df: DataFrame, by, order) -> DataFrame:
    """G1: whole first row per group (first ICU stay per patient).

    Same result as ``row_number() over (partition by .. order by ..) = 1`` with
    a total order, but as a partial aggregate: skew-safe, no sort.
    """
    by, order = _cols(by), _cols(order)
    rest = [c for c in df.columns if c not in by]
    return first_last(df, by, order, rest, "first").select(*df.columns)


# ------------------------------------------------------------ range buckets

BUCKET_ROWS = 20_000      # rows a bucket of an ordered computation is meant to hold


def bucket_count(df: DataFrame) -> int:
    """Buckets for a materialised table, in proportion to its rows."""
    return 1 + df.count() // BUCKET_ROWS


def range_buckets(df: DataFrame, order: Sequence[str], n_buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """Cut a materialised table into ranges of ``order`` that hold about ``BUCKET_ROWS`` rows each, and
    add the range's index.  Used to split an order-dependent computation (prefix sums, nearest
    neighbours) into bounded, independent parts instead of one global sort.

    The rows are range-partitioned (Spark samples the bounds) and written with the partition's number,
    so no cut point reaches the driver, and no join or search finds a row's range.  Rows of equal
    ``order`` share a range: collapse repeated values before."""
    from trialframe.session import cut_lineage
    n = n_buckets or bucket_count(df)
    if n == 1:
        return df.withColumn(out, F.lit(0))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id()))


# ------------------------------------------------------------ duplicates

def drop_all_duplicated(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Remove *every* copy of a row that occurs more than once."""
    cols = list(subset) if subset else df.columns
    if subset is None or set(subset) == set(df.columns):
        return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
                  .filter(F.col("_n") == 1).drop("_n").select(*df.columns))
    once = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") == 1).drop("_n"))
    return df.join(once, cols, "left_semi")


# ------------------------------------------------------------ reshaping

def unpivot_long(df: DataFrame, ids: Sequence[str], value_cols: Sequence[str],
                 var_name: str = "code", value_name: str = "value",
                 drop_nulls: bool = True, cast: str = "double") -> DataFrame:
    """Wide -> long in one pass over the table (``unpivot`` keeps nulls,
    so they are filtered explicitly)."""
    wide = df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in value_cols])
    out = wide.unpivot(list(ids), list(value_cols), var_name, value_name)
    return out.filter(F.col(value_name).isNotNull()) if drop_nulls else out


AGGREGATES = {
    "first": None, "last": None,  # ordered, handled by first_last
    "median": None,                # by ``code_medians``
    "min": F.min, "max": F.max, "mean": F.avg,
    "sum": F.sum, "std": F.stddev_samp, "count": F.count,
}


def pivot_codes(df: DataFrame, by: Sequence[str], vocabulary: Sequence[str],
                aggs: Sequence[str], order: Sequence[str] | None = None,
                code_col: str = "code", value_col: str = "value",
                name_fmt: str = "{agg}_code_{code}") -> DataFrame:
    """Long events -> one row per unit, one column per (aggregate, code).

    ``first``/``last`` use ``order`` (a total order); the other aggregates are
    the usual null-skipping SQL aggregates.  The pivot values are the explicit
    ``vocabulary`` so no distinct job runs and the schema is stable.  Medians
    come from ``code_medians``, so that no task holds a unit's values.
    """
    by = list(by)
    if "median" in aggs:
        med = code_medians(df, by, vocabulary, code_col, value_col, lambda c: name_fmt.format(agg="median", code=c))
        rest = [x for x in aggs if x != "median"]
        base = (pivot_codes(df, by, vocabulary, rest, order, code_col, value_col, name_fmt) if rest else
                df.filter(F.col(code_col).isin(list(vocabulary))).select(*by).distinct())
        names = [name_fmt.format(agg=x, code=c) for c in vocabulary for x in aggs]
        return left_null_safe(base, med, by).select(*by, *[F.col(f"`{x}`") for x in names])
    exprs = []
    for agg in aggs:
        if agg in ("first", "last"):
            key = F.struct(*[F.col(c) for c in order])
            f = F.min_by if agg == "first" else F.max_by
            exprs.append(f(F.col(value_col), key).alias(agg))
        else:
            exprs.append(AGGREGATES[agg](F.col(value_col)).alias(agg))
    restricted = df.filter(F.col(code_col).isin(list(vocabulary)))
    piv = restricted.groupBy(*by).pivot(code_col, list(vocabulary)).agg(*exprs)
    renames = []
    for code in vocabulary:
        for agg in aggs:
            src = f"{code}_{agg}" if len(aggs) > 1 else str(code)
            renames.append(F.col(f"`{src}`").alias(name_fmt.format(agg=agg, code=code)))
    return piv.select(*by, *renames)


def one_hot(df: DataFrame, col: str, categories: Sequence, prefix: str | None = None,
            drop: bool = True) -> DataFrame:
    """One 0/1 column per known category (``col_value``); unknown -> all 0."""
    p = prefix if prefix is not None else col
    out = df.select("*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{p}_{v}")
                           for v in categories])
    return out.drop(col) if drop else out


# ------------------------------------------------------------ joins

STAY_KEYS = ["subject_id", "hadm_id", "stay_id"]


def literal_frame(spark: SparkSession, values: Iterable, name: str, dtype: str = "string") -> DataFrame:
    """A one-column frame from a Python list (size known: safe to broadcast)."""
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def restrict_vocabulary(df: DataFrame, vocabulary: Sequence, code_col: str = "code") -> DataFrame:
    """Keep rows whose code is in the vocabulary (broadcast semi join on
    the literal list; below the IN-list threshold Catalyst turns it into a
    pushed-down ``In`` filter anyway)."""
    spark = df.sparkSession
    dtype = df.schema[code_col].dataType.simpleString()
    vocab = literal_frame(spark, list(dict.fromkeys(vocabulary)), code_col, dtype)
    return df.join(F.broadcast(vocab), code_col, "left_semi")


def join_key(df: DataFrame) -> str:
    """Most specific stay key present in ``df`` (stay > admission > patient)."""
    for k in ("stay_id", "hadm_id", "subject_id"):
        if k in df.columns:
            return k
    raise ValueError(f"no join key among {STAY_KEYS} in columns {df.columns}")


def join_by_key_precedence(events: DataFrame, population: DataFrame,
                           pop_cols: Sequence[str] = ()) -> DataFrame:
    """Join events to the population on the most specific shared key and
    take the missing keys (and ``pop_cols``) from the population."""
    key = join_key(events)
    keep = [c for c in STAY_KEYS if c != key and c in population.columns]
    ev = events.drop(*[c for c in keep if c in events.columns])
    pop = population.select(key, *keep, *[c for c in pop_cols if c not in keep and c != key])
    return ev.join(pop, key, "inner")


def observation_window(events: DataFrame, population: DataFrame,
                       end_col: str = "inclusion_start", time_col: str = "starttime",
                       event_cols: Sequence[str] | None = None) -> DataFrame:
    """Events of the population observed up to ``end_col`` (S6: no lower
    bound), keys completed by precedence (S7), value cast to DOUBLE."""
    j = join_by_key_precedence(events, population, [end_col])
    out = j.filter(F.col(time_col) <= F.col(end_col)).drop(end_col)
    if "value" in out.columns:
        out = out.withColumn("value", F.col("value").cast("double"))
    cols = event_cols or [c for c in EVENT_COLUMNS if c in out.columns]
    return out.select(*cols)


EVENT_COLUMNS = ["subject_id", "hadm_id", "stay_id", "starttime", "endtime",
                 "domain", "code", "label", "value"]

EVENT_SCHEMA = T.StructType([
    T.StructField("subject_id", T.LongType()), T.StructField("hadm_id", T.LongType()),
    T.StructField("stay_id", T.LongType()),
    T.StructField("starttime", T.TimestampNTZType()), T.StructField("endtime", T.TimestampNTZType()),
    T.StructField("domain", T.StringType()), T.StructField("code", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType()),
])


def to_event_schema(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Project any frame onto the 9-column event schema (missing -> null)."""
    cols = []
    for f in EVENT_SCHEMA.fields:
        if f.name == "domain" and domain is not None:
            cols.append(F.lit(domain).alias("domain"))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """F2."""
    return union_all(frames).distinct()


def intersect_all_sets(frames: Sequence[DataFrame]) -> DataFrame:
    """set intersection of id frames (same columns)."""
    return reduce(lambda a, b: a.intersect(b), frames)


def except_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """set difference (EXCEPT DISTINCT)."""
    return left.subtract(right)


def dictionary_join(df: DataFrame, dictionary: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Lookup join against a dictionary table (AQE broadcasts it when
    its measured size is under the threshold; otherwise sort-merge)."""
    return df.join(dictionary, on, how)


def fill_left(df: DataFrame, other: DataFrame, on, fill: dict) -> DataFrame:
    """Left join then default-fill the joined columns."""
    out = df.join(other, on, "left")
    return out.fillna(fill) if fill else out


# ------------------------------------------------------------ exact quantiles

def exact_quantiles(df: DataFrame, col: str, probs: dict, by: Sequence[str] = (),
                    n_parts: int | None = None, _key: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation, as ``percentile`` /
    ``quantile_cont``) per group, without holding a group in one task.

    1. collapse to distinct ``(group, value)`` with counts (partial
       aggregation: a value repeated by a third of the rows is one row);
    2. range-partition the distinct values by ``(group, value)`` and
       materialise them (read twice below);
    3. per (group, partition): counts -> prefix offsets (a table of
       groups x partitions rows);
    4. the order statistics ``floor``/``ceil`` of ``p (n - 1)`` are located in
       their partition; only those partitions get a running count, over about
       ``n_distinct / n_parts`` rows each;
    5. the two values are interpolated.

    ``probs`` maps output column names to probabilities.  Null values are
    ignored; null group columns form a group (inside a struct nulls are equal).
    """
    from trialframe.session import cut_lineage
    if by:
        q = exact_quantiles(df.select(F.struct(*[F.col(c) for c in by]).alias("_by"), F.col(col).alias("_value")), "_value",
                            probs, (), n_parts, _key="_by")
        return q.select(*[F.col("_by")[c].alias(c) for c in by], *probs)
    by = [_key] if _key else []
    spark = df.sparkSession
    parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d0 = (df.select(*by, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
          .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    d = cut_lineage(d0.repartitionByRange(parts, *by, "_v").withColumn("_pid", F.spark_partition_id()))
    from pyspark.sql.window import Window
    per = d.groupBy(*by, "_pid").agg(F.sum("_c").alias("_pc"))
    wo = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    wn = Window.partitionBy(*by)
    per = per.select(*by, "_pid", "_pc", F.coalesce(F.sum("_pc").over(wo), F.lit(0)).alias("_off"),
                     F.sum("_pc").over(wn).alias("_n"))
    # target order statistics (0-based ranks) per group and probability
    tg = per.select(*by, "_n").distinct().select(
        *by, "_n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(p)).alias("p"))
                                       for k, p in probs.items()])).alias("_q"))
    tg = tg.select(*by, "_n", F.col("_q.name").alias("_name"), F.col("_q.p").alias("_p"),
                   (F.col("_q.p") * (F.col("_n") - 1)).alias("_pos"))
    tg = tg.select("*", F.explode(F.array(F.floor("_pos").cast("bigint"), F.ceil("_pos").cast("bigint"))).alias("_r"))
    # groups x probabilities, groups x partitions: broadcast by AQE where they measure small
    loc = tg.join(per, by) if by else tg.withColumn("_k", F.lit(0)).join(per.withColumn("_k", F.lit(0)), "_k")
    loc = loc.filter((F.col("_r") >= F.col("_off")) & (F.col("_r") < F.col("_off") + F.col("_pc")))
    loc = loc.select(*by, "_pid", "_off", "_name", "_p", "_pos", "_r")
    # running counts inside the partitions holding a target rank only
    keys = [*by, "_pid"]
    sel = d.join(loc.select(*keys).distinct(), keys, "left_semi")
    wr = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sel = sel.select(*keys, "_v", "_c", F.sum("_c").over(wr).alias("_cum"))
    hit = sel.join(loc, keys).filter(
        (F.col("_r") - F.col("_off") < F.col("_cum")) & (F.col("_r") - F.col("_off") >= F.col("_cum") - F.col("_c")))
    vals = hit.groupBy(*by, "_name", "_p", "_pos").agg(
        F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"))
    q = F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_hi") - F.col("_lo"))
    out = vals.groupBy(*by).pivot("_name", list(probs)).agg(F.first(q))
    return out


def left_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join on columns of the same name in which nulls are equal."""
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return left.alias("l").join(right.alias("r"), cond, "left").select(
        "l.*", *[F.col(f"r.`{c}`") for c in right.columns if c not in on])


def code_medians(df: DataFrame, by: Sequence[str], vocabulary: Sequence, code_col: str = "code",
                 value_col: str = "value", name=str) -> DataFrame:
    """Exact median per (unit, code), one row per unit and one column ``name(code)`` per code.
    Units without a non-null value have no row.  The values are ranges of (unit, code, value), so a unit
    with a third of all events is spread over tasks."""
    q = exact_quantiles(df.filter(F.col(code_col).isin(list(vocabulary))), value_col, {"_median": 0.5}, [*by, code_col])
    piv = q.groupBy(*by).pivot(code_col, list(vocabulary)).agg(F.first("_median"))
    return piv.select(*by, *[F.col(f"`{c}`").alias(name(c)) for c in vocabulary])
