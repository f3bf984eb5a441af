"""Event extraction (I1-I16): many wide, interval and flag tables -> one long
9-column event table, restricted to each unit's observation period.

Each source is turned into events with *one* scan (``unpivot`` / exploded
class arrays) instead of one scan per concept; the union is lazy and the
population join happens once, after the union.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions.time import shift
from trialframe.operators.relational import (
    EVENT_SCHEMA, STAY_KEYS, drop_all_duplicated, join_key, observation_window, to_event_schema, union_all,
    unpivot_long,
)


def measurement_events(df: DataFrame, keys: Sequence[str], time_col: str, value_cols: Sequence[str],
                       domain: str = "measurement", labels: Mapping[str, str] | None = None) -> DataFrame:
    """A wide measurement table -> events (code = column name), nulls dropped."""
    long = unpivot_long(df.withColumn("starttime", F.col(time_col)), [*keys, "starttime"], value_cols)
    lab = F.col("code") if not labels else F.coalesce(
        F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("code")], F.col("code"))
    return to_event_schema(long.withColumn("label", lab), domain=domain)


def drug_class_events(df: DataFrame, name_col: str, classes: Mapping[str, Sequence[str]],
                      keys: Sequence[str], time_col: str, end_col: str | None = None,
                      value: F.Column | None = None, domain: str = "medication") -> DataFrame:
    """Events for every class whose case-insensitive regex matches the drug
    name.  One pass: an array of (class, hit) structs is filtered and exploded,
    so a drug may fall in several classes and the table is scanned once."""
    name = F.lower(F.col(name_col))
    arr = F.array(*[F.struct(F.lit(c).alias("cls"), name.rlike("|".join(p.lower() for p in pats)).alias("hit"))
                    for c, pats in classes.items()])
    hits = F.filter(arr, lambda s: s["hit"])
    ex = df.select(*keys, F.col(time_col).alias("starttime"),
                   (F.col(end_col) if end_col else F.lit(None).cast("timestamp_ntz")).alias("endtime"),
                   F.col(name_col).alias("label"),
                   (value if value is not None else F.lit(1.0)).alias("value"),
                   F.explode(hits).alias("_h"))
    return to_event_schema(ex.withColumn("code", F.col("_h.cls")), domain=domain)


def interval_events(df: DataFrame, keys: Sequence[str], start_col: str, end_col: str | None,
                    value_col: str | F.Column, code: str, domain: str) -> DataFrame:
    """Interval (or point) table -> events with start/end and a value."""
    v = F.col(value_col) if isinstance(value_col, str) else value_col
    out = df.select(*keys, F.col(start_col).alias("starttime"),
                    (F.col(end_col) if end_col else F.col(start_col)).alias("endtime"),
                    F.lit(code).alias("code"), F.lit(code).alias("label"), v.alias("value"))
    return to_event_schema(out, domain=domain)


def first_day_score_events(scores: DataFrame, stays: DataFrame, key: str, score_col: str,
                           code: str, domain: str = "score") -> DataFrame:
    """A per-stay score with no time of its own takes ``intime`` and
    ``intime + 1 day`` from the stay."""
    j = scores.select(key, F.col(score_col).alias("value")).join(stays, key)
    out = j.select(*[c for c in ("subject_id", "hadm_id", "stay_id") if c in j.columns],
                   F.col("intime").alias("starttime"), shift("intime", days=1).alias("endtime"),
                   F.lit(code).alias("code"), F.lit(code).alias("label"), "value")
    return to_event_schema(out, domain=domain)


def any_agent_events(df: DataFrame, keys: Sequence[str], time_col: str, agents: Sequence[str],
                     code: str = "vasopressors", end_col: str | None = None) -> DataFrame:
    """I7 (S11): one event per non-null agent rate: value = 1 if rate > 0 else
    0, label = agent name."""
    base = df.select(*keys, F.col(time_col).alias("starttime"),
                     (F.col(end_col) if end_col else F.lit(None).cast("timestamp_ntz")).alias("endtime"),
                     *[F.col(a).cast("double").alias(a) for a in agents])
    long = base.unpivot([*keys, "starttime", "endtime"], list(agents), "label", "rate").filter(F.col("rate").isNotNull())
    out = long.select(*keys, "starttime", "endtime", F.lit(code).alias("code"), "label",
                      F.when(F.col("rate") > 0, 1.0).otherwise(0.0).alias("value"))
    return to_event_schema(out, domain="drug")


def flag_events(df: DataFrame, keys: Sequence[str], time_col: str, flag_cols: Sequence[str],
                keep_zero: Sequence[str] = (), domain: str = "comorbidity") -> DataFrame:
    """Wide 0/1 flags -> events; zero flags are dropped except for the
    columns in ``keep_zero`` (an index that is informative at 0)."""
    long = unpivot_long(df.withColumn("starttime", F.col(time_col)), [*keys, "starttime"], flag_cols)
    long = long.filter((F.col("value") != 0) | F.col("code").isin(list(keep_zero)))
    return to_event_schema(long.withColumn("label", F.col("code")), domain=domain)


def covariate_events(sources: Sequence[DataFrame], population: DataFrame,
                     end_col: str = "inclusion_start") -> DataFrame:
    """Every event source restricted to the observation period of the
    population on its own most specific key (S6, S7), brought to the event
    schema, united, and every duplicated row removed (S8)."""
    seen = [to_event_schema(observation_window(s, population, end_col=end_col)) for s in sources]
    return drop_all_duplicated(union_all(seen))


KEYED_FIELDS = ["starttime", "endtime", "domain", "code", "label", "value"]


def keyed_source(source: DataFrame) -> DataFrame:
    """A source's events as ``key_kind, key`` and the event fields.  A source with these two columns
    may mix kinds of keys; any other goes by its most specific stay key."""
    if not {"key_kind", "key"} <= set(source.columns):
        name = join_key(source)
        source = source.withColumns({"key_kind": F.lit(name), "key": F.col(name)})
    fields = [(F.col(c) if c in source.columns else F.lit(None)).cast(EVENT_SCHEMA[c].dataType).alias(c) for c in KEYED_FIELDS]
    return source.select("key_kind", F.col("key").cast("bigint").alias("key"), *fields)


def bridged_events(sources: Sequence[DataFrame], population: DataFrame, end_col: str = "inclusion_start") -> DataFrame:
    """Any number of event sources, keyed by stay, admission or patient, as events of the population up
    to ``end_col``, every duplicated row removed (S8).

    A patient's event is a row of every one of the patient's units, so these rows are counted before they meet
    the units, once a patient, and what comes out of that join is final: it is never shuffled.  Events by stay or
    admission meet their units first (a bridge of two rows a unit) and are counted with their units; one
    aggregation by (patient, event) then puts them beside the patient's events.  What a unit gets from both is
    there more than once.  A unit that occurs several times counts as often as its end lets it see the event.
    Events and units with a null key meet nothing; a patient's key that many events share is split by AQE."""
    keys = [F.col(k).cast(EVENT_SCHEMA[k].dataType).alias(k) for k in STAY_KEYS]
    units = population.select(*keys, F.col(end_col).alias("_end")).groupBy(*STAY_KEYS).agg(F.collect_list("_end").alias("_ends"))
    sees = F.size(F.filter("_ends", lambda end: end >= F.col("starttime"))).cast("bigint")
    rows = union_all([keyed_source(s) for s in sources]).filter("key is not null")
    narrow = F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).cast("bigint").alias("key")) for k in STAY_KEYS if k != "subject_id"])
    bridge = units.select("*", F.explode(narrow).alias("_k")).select(*STAY_KEYS, "_ends", "_k.*").filter("key is not null")
    near = (rows.filter("key_kind <> 'subject_id'").join(bridge, ["key_kind", "key"]).withColumn("_n", sees).filter("_n > 0")
            .groupBy(*STAY_KEYS, *KEYED_FIELDS).agg(F.sum("_n").alias("_n"))
            .select(F.col("subject_id").cast("bigint").alias("key"), *KEYED_FIELDS, F.struct("hadm_id", "stay_id", "_n").alias("_unit")))
    wide = rows.filter("key_kind = 'subject_id'").select("key", *KEYED_FIELDS, F.lit(None).cast(near.schema["_unit"].dataType).alias("_unit"))
    events = wide.union(near).groupBy("key", *KEYED_FIELDS).agg(F.count_if(F.col("_unit").isNull()).alias("_wide"),
                                                                F.collect_list("_unit").alias("_near"))
    # One read of the events: those of units only go by the join, which keeps them, and bring their own units.
    of = units.select(F.col("subject_id").cast("bigint").alias("_subject"), F.struct("hadm_id", "stay_id").alias("_of"), "_ends")
    met = events.filter("_wide < 2").join(of, (F.col("key") == F.col("_subject")) & (F.col("_wide") == 1), "left")
    unit = lambda u: F.struct(u["hadm_id"].alias("hadm_id"), u["stay_id"].alias("stay_id"))
    also = F.exists("_near", lambda u: unit(u).eqNullSafe(unit(F.col("_of"))))
    got = (F.when(F.col("_wide") == 0, F.transform(F.filter("_near", lambda u: u["_n"] == 1), unit))
           .when(F.col("_subject").isNotNull() & (sees == 1) & ~also, F.array(unit(F.col("_of")))))
    return to_event_schema(met.select(F.col("key").alias("subject_id"), *KEYED_FIELDS, F.explode(got).alias("_unit"))
                           .select("subject_id", "_unit.*", *KEYED_FIELDS))


def static_flags(units: DataFrame, flags: Mapping[str, F.Column]) -> DataFrame:
    """0/1 static covariates from boolean expressions (null -> 0)."""
    return units.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in flags.items()})


def composite_flag(units: DataFrame, key: str, components: Mapping[str, DataFrame],
                   name: str = "composite") -> DataFrame:
    """A unit is flagged when it is in *every* component id set (each a
    frame holding ``key``); semi joins, then a left join back (null -> 0)."""
    hit = units.select(key).distinct()
    for comp in components.values():
        hit = hit.join(comp.select(key), key, "left_semi")
    return units.join(hit.withColumn(name, F.lit(1)), key, "left").fillna({name: 0})


def followup_variants(population: DataFrame, variants: Mapping[str, F.Column]) -> DataFrame:
    """I16: the same population with the observation end replaced by each
    variant expression, stacked with a ``variant`` column (explode of a bounded
    literal list, no join)."""
    arr = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("obs_end")) for k, v in variants.items()])
    return population.select("*", F.explode(arr).alias("_v")).select(
        *population.columns, F.col("_v.variant").alias("variant"), F.col("_v.obs_end").alias("obs_end"))
