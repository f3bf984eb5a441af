"""Sources and sinks.

All readers return lazy DataFrames: projections and filters applied later are
pushed into the parquet scan by Catalyst (``PushedFilters`` / ``ReadSchema``).
Writers are partition-parallel (one file per task) and idempotent
(``overwrite`` for tables, ``append`` only for logs keyed by a run id).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    """A table is a parquet file or a directory of parquet files."""
    p = os.path.join(sf_dir, f"{name}.parquet")
    return p if os.path.exists(p) or "://" in sf_dir else os.path.join(sf_dir, name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A1: lazy parquet scan of one table."""
    return spark.read.parquet(table_path(sf_dir, name))


def list_tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the parquet tables of a folder, from the file system that Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def read_pruned(spark: SparkSession, sf_dir: str, name: str, columns) -> DataFrame:
    """A2: scan only the listed columns (the scan's ReadSchema shrinks)."""
    return read_table(spark, sf_dir, name).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             sep: str = ",", header: bool = True) -> DataFrame:
    """A3: CSV with header and separator; gzip is detected from the suffix.

    A schema should be given at scale (inference reads the data twice).
    """
    r = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str | None = None) -> str:
    """CSV export, header once per part file."""
    w = df.write.mode("overwrite").option("header", True).option("sep", sep)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by=None) -> str:
    """Overwrite a parquet table (cohort, target population)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def export_tables(spark: SparkSession, tables: dict[str, DataFrame], out_dir: str) -> DataFrame:
    """A5: write every table to ``out_dir/<name>`` and return (table, n_rows).

    Row counts are read back from the written files (one parquet metadata
    scan per table), not from the driver.
    """
    rows = []
    for name, df in tables.items():
        path = os.path.join(out_dir, name)
        write_parquet(df, path)
        rows.append(spark.read.parquet(path).groupBy().agg(F.count(F.lit(1)).alias("n_rows"))
                    .select(F.lit(name).alias("table_name"), "n_rows"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def jdbc_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
               properties: dict | None = None) -> DataFrame:
    """A4: relational-database read, split into ranges of ``partition_column``.

    Thin by design: Spark's JDBC source does the work; a partition column is
    required at scale, otherwise one task reads the whole table.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


# ------------------------------------------------------------------ logs

ESTIMATE_SCHEMA = T.StructType([
    T.StructField("ATE", T.DoubleType()),
    T.StructField("ATE lower bound", T.DoubleType()),
    T.StructField("ATE upper bound", T.DoubleType()),
    T.StructField("ntv", T.DoubleType()),
    T.StructField("event_aggregations", T.StringType()),
    T.StructField("estimation_method", T.StringType()),
    T.StructField("treatment_model", T.StringType()),
    T.StructField("outcome_model", T.StringType()),
    T.StructField("feature_subset", T.StringType()),
    T.StructField("cohort_name", T.StringType()),
    T.StructField("outcome_name", T.StringType()),
    T.StructField("compute_time", T.DoubleType()),
])


def log_rows(df: DataFrame, folder: str, fmt: str = "parquet") -> str:
    """Append result rows to a log folder.

    Each call writes its own ``run_id`` partition, so two runs in the same
    second never overwrite each other (the reference's file names do).
    """
    run_id = f"{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    out = df.withColumn("run_id", F.lit(run_id))
    w = out.write.mode("append").partitionBy("run_id")
    if fmt == "csv":
        w.option("header", True).csv(folder)
    else:
        w.parquet(folder)
    return run_id


def read_log(spark: SparkSession, folder: str, csv_schema: T.StructType | None = None) -> DataFrame:
    """Read every appended run back; schemas of older runs are merged.  A CSV log
    is read with its schema (and the run's folder name)."""
    if csv_schema is not None:
        return spark.read.schema(T.StructType([*csv_schema.fields, T.StructField("run_id", T.StringType())])).option("header", True).csv(folder)
    return spark.read.option("mergeSchema", True).parquet(folder)


# ---------------------------------------------------------------- configs

def cohort_folder_name(config: dict) -> str:
    """``<name>__obs_<window>d`` with the decimal point written ``f``."""
    name = str(config["cohort_name"])
    w = config.get("treatment_observation_window_unit_day")
    if w is not None:
        name += f"__obs_{w}d".replace(".", "f")
    return name


def config_table(spark: SparkSession, config: dict) -> DataFrame:
    """One (config, value) row per key, values as text."""
    rows = [(str(k), None if v is None else str(v)) for k, v in config.items()]
    return spark.createDataFrame(rows, "config string, value string")


def config_digest(config: dict) -> str:
    """Stable digest of a configuration (Python's ``hash`` is salted per run)."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def memoise(spark: SparkSession, df: DataFrame, name: str, config: dict, root: str | None = None) -> DataFrame:
    """Materialise an expensive frame once per configuration and input.

    The table lives in the shared checkpoint folder, keyed by the digest of the
    configuration and of the input: the files that ``df`` reads, else its plan.  A second call with both
    the same reads it back, on any file system.  Every write goes to a folder
    of its own that counts once its ``_SUCCESS`` file is there, so no call
    overwrites a table that another one reads.
    """
    from trialframe.session import checkpoint_dir

    base = root or os.path.join(checkpoint_dir(spark), "memo")
    source = sorted(df.inputFiles()) or df.semanticHash()      # a frame of no files is known by its plan
    key = config_digest({"config": config, "source": source})
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}-{key}")
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    done = [s.getPath().getParent().toString()
            for s in (fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*/_SUCCESS")) or [])]
    path = min(done) if done else f"{folder.toString()}/{uuid.uuid4().hex}"
    if not done:
        df.write.parquet(path)
    return spark.read.parquet(path)
