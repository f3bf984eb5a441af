"""Helpers shared by the text operators: inputs, shared tables, Arrow mapping, span digests."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.session import checkpoint_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CHUNK = 256      # rows a Python worker holds at a time inside an Arrow batch
FILE_ROWS = 10_000          # rows of numbers in a file of a shared table whose size is known beforehand


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it,
    and bound the rows of an Arrow batch where the session does not."""
    sc = spark.sparkContext
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, "1000")          # whole texts: memory goes by rows times length
    if getattr(sc, "_trialframe_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="trialframe-")) / "trialframe_package.zip"     # Spark serves it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._trialframe_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    Where the table is known to have ``rows`` rows at most, it gets a file for
    every ``per_file`` of them at most: a small table in a file a shuffle
    partition costs more in files than in rows, and on local disks every file
    makes the JVM start processes (chmod).

    The folder is the session's ``spark.checkpoint.dir``.  The table cuts the
    lineage: a lost executor costs a re-read, not a recomputation.  Nothing
    reads the shuffle files of the job again, so Spark may remove them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    few = df if rows is None else df.coalesce(max(1, -(-rows // per_file)))
    try:
        few.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``shared_table`` that nothing will read again; with Spark Connect it stays."""
    jvm = getattr(df.sparkSession, "_jvm", None)
    path = getattr(df, "_shared_path", None)
    if jvm is not None and path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterable[tuple]]],
             schema: str | T.StructType, chunk: int = CHUNK) -> DataFrame:
    """``mapInArrow`` over rows in small chunks.

    ``make()`` runs once per task and returns ``f(rows) -> tuples``; ``rows``
    are the input rows as tuples in column order.  At most ``chunk`` input rows
    and their results are held as Python objects at a time.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        out = to_arrow_schema(schema)
        f = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                part = batch.slice(lo, chunk)
                got = list(f(list(zip(*(c.to_pylist() for c in part.columns), strict=True))))
                if got:
                    cols = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=t.type) for c, t in zip(cols, out, strict=True)], schema=out)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task's temporaries left in a reused Python worker to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def sha_hex(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def span_text(spans: Iterable[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed in ``kinds``, then end."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def one_row_per(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row key; stable only once the result is written (see ``shared_table``)."""
    return df.withColumn(name, F.monotonically_increasing_id())


def outside(spans: Iterable[tuple[int, int]], taken: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those of ``spans`` (ascending by start) that meet neither ``taken`` nor an earlier one kept."""
    merged: list[list[int]] = []
    for s, e in sorted(taken):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    at, done = 0, 0
    for s, e in spans:
        while at < len(merged) and merged[at][1] <= s:
            at += 1
        if s >= done and (at == len(merged) or merged[at][0] >= e):
            done = e
            yield s, e
