"""Filter interaction audit: what each of several text filters removes, in every order of applying them.

One pass of a table-driven byte transducer measures a text.  A table of 256
entries gives each UTF-8 byte its outputs (starts a code point, is a capital,
is a symbol) and the next state (inside or outside a word).  The state depends
on the last byte alone, so the transitions of a whole Arrow batch are one look
up and one comparison of neighbours.  Every word span the transducer closes
goes into an open-addressing hash table of its document; spans that meet in a
slot are compared byte by byte, so equal hashes never merge different words.

Each document becomes a bit mask of the filters it fails.  Documents are
counted by (part, mask) before anything is laid out by order, so the
orders multiply a table of at most 2^filters rows a part, not the corpus.

Defined cases: null text counts as empty; null part as the empty string.  A
null id is never a copy's smaller or larger id.  Rows that repeat an id count
each; rows of one id are no copies of each other.  Labels that repeat an id
count once, as set if any of them is set.  An empty table gives no rows.
Texts of any length are read whole, in pieces cut at white space.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm.common import give_back, shared_table, table

PIECE = 1 << 20           # bytes the transducer takes at a time; a longer word makes a longer piece
SALTS = 32                # tasks over which the rows of one text are spread
MIX = np.uint64(0x9E3779B97F4A7C15)
POINT, CAPITAL, SYMBOL, WORD = 1, 2, 4, 8
MEASURES = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

#: Failure conditions over the measures, by letter; the last one is about other rows (see ``failures``).
FILTERS = {"A": "n_words < 200",
           "B": "100 * n_distinct < 50 * n_words",
           "C": "100 * n_capitals > 3 * n_points",
           "D": "n_symbols > 0",
           "E": "is_copy"}


def byte_table() -> np.ndarray:
    """Outputs and next state of every byte."""
    b = np.arange(256)
    out = np.where(b & 0xC0 != 0x80, POINT, 0) | np.where((b != 32) & ((b < 9) | (b > 13)), WORD, 0)
    out |= np.where((b >= 65) & (b <= 90), CAPITAL, 0)
    return (out | np.where(np.isin(b, list(b"#$%&*|")), SYMBOL, 0)).astype(np.uint8)


TABLE = byte_table()
LOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2 ** 64 - 1], np.uint64)      # the first k bytes of a load


class Spans:
    """Word spans of a buffer: eight bytes at a time from any offset."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray):
        self.start, self.size, self.doc = start, size, doc
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.loads = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def load(self, spans: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of spans that are longer than 8k, zeros beyond their end."""
        return self.loads[self.start[spans] + 8 * k] & LOW[np.minimum(self.size[spans] - 8 * k, 8)]

    def hashes(self) -> np.ndarray:
        h = (self.doc.astype(np.uint64) + np.uint64(1)) * MIX
        live, k = np.arange(len(self.start)), 0
        while len(live):
            x = (h[live] ^ self.load(live, k)) * MIX
            h[live] = x ^ (x >> np.uint64(29))
            k += 1
            live = live[self.size[live] > 8 * k]
        return h * MIX

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a and b are the same word of the same document, by their bytes."""
        same = (self.doc[a] == self.doc[b]) & (self.size[a] == self.size[b])
        live, k = np.flatnonzero(same), 0
        while len(live):
            differ = self.load(a[live], k) != self.load(b[live], k)
            same[live[differ]] = False
            k += 1
            live = live[~differ]
            live = live[self.size[a[live]] > 8 * k]
        return same

    def first(self) -> np.ndarray:
        """True for the one span of each distinct word that holds its slot."""
        n = len(self.start)
        bits = max(4, (2 * n).bit_length())
        slot = (self.hashes() >> np.uint64(64 - bits)).astype(np.int64)
        held = np.full(1 << bits, -1, np.int64)
        new, todo = np.zeros(n, bool), np.arange(n)
        while len(todo):
            s = slot[todo]
            free = held[s] < 0
            held[s[free]] = todo[free]                   # of several claimants one stays
            owner = held[s]
            mine = owner == todo
            new[todo[mine]] = True
            rest, owner = todo[~mine], owner[~mine]
            todo = rest[~self.equal(rest, owner)]
            slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
        return new


def transduce(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, Spans, np.ndarray]:
    """(measures of every document, word spans, the spans that are distinct words).

    ``data`` holds documents end to end, ``begin`` their n + 1 borders.
    """
    out = TABLE[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = out >= WORD
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[begin] = False                                # every document starts outside a word
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[begin[1:][begin[1:] > 0] - 1] = False          # and ends outside
    size = np.flatnonzero(inside & ~after) + 1 - start
    doc = np.searchsorted(begin, start, "right") - 1
    spans = Spans(data, start, size, doc)
    new = spans.first()
    n = len(begin) - 1
    per = [np.bincount(doc, minlength=n), np.bincount(doc[new], minlength=n)]
    for bit in (CAPITAL, POINT, SYMBOL):
        total = np.concatenate([[0], np.cumsum(out & bit != 0)])
        per.append(total[begin[1:]] - total[begin[:-1]])
    return np.stack(per, 1), spans, new


def measure_long(data: np.ndarray) -> np.ndarray:
    """Measures of one long document, piece by piece; its distinct words are kept as bytes."""
    total, seen, lo = np.zeros(len(MEASURES), np.int64), set(), 0
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        while hi < len(data):                            # a piece ends before white space
            gap = np.flatnonzero(TABLE[data[hi:hi + PIECE]] < WORD)
            hi = hi + int(gap[0]) if len(gap) else min(hi + PIECE, len(data))
            if len(gap):
                break
        part = data[lo:hi]
        per, spans, new = transduce(part, np.array([0, len(part)]))
        total += per[0]
        raw = part.tobytes()
        seen.update(raw[s:s + n] for s, n in zip(spans.start[new].tolist(), spans.size[new].tolist(), strict=True))
        lo = hi
    total[1] = len(seen)
    return total


def measure(texts: pa.Array) -> np.ndarray:
    """Measures of every text of an Arrow array of strings."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    begin = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out, at = np.zeros((len(texts), len(MEASURES)), np.int64), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + PIECE, "right")) - 1)
        part, borders = data[begin[at]:begin[stop]], begin[at:stop + 1] - begin[at]
        out[at:stop] = measure_long(part) if len(part) > PIECE else transduce(part, borders)[0]
        at = stop
    return out


def measures(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the measures of ``text_col`` for every row."""
    place = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(batch.column(place))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:place], *(pa.array(got[:, i]) for i in range(len(MEASURES)))],
                names=[*keep, *MEASURES])
        give_back()

    kept = df.select(*keep).schema
    for m in MEASURES:
        kept = kept.add(m, T.LongType())
    return df.select(*keep, text_col).mapInArrow(run, kept)


def failures(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, part, mask`` of every row; bit i of ``mask`` is the i-th of ``FILTERS``.

    A copy is a row whose text some row of a smaller id has.  The rows of one
    text are spread over salts; a text's smallest id goes to those salts that
    hold the text, so a text of a third of all rows is in no single task.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(part_col, F.lit("")).alias("part"),
                     F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = shared_table(measures(rows, "text", ["id", "part", "digest", "salt"]), "measures")
    per = rows.groupBy("digest", "salt").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least = (per.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"),
                                       F.collect_set("salt").alias("salt"))
             .filter("least < most").select("digest", "least", F.explode("salt").alias("salt")))
    rows = rows.join(least, ["digest", "salt"], "left").withColumn("is_copy", F.coalesce(F.expr("id > least"), F.lit(False)))
    mask = " + ".join(f"if({c}, {1 << i}, 0)" for i, c in enumerate(FILTERS.values()))
    return rows.select("id", "part", F.expr(mask).alias("mask"))


def audit(failed: DataFrame, labels: DataFrame, letters: str = "".join(FILTERS)) -> DataFrame:
    """One row per part, order of the filters and step.

    ``failed``: ``id, part, mask``.  ``labels``: ``id, good, toxic`` (booleans), any number of rows an id.
    """
    marks = labels.filter("id IS NOT NULL").groupBy("id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"),
                                   F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    marks = marks.filter("good OR toxic")
    # Rows that repeat an id are counted before they meet the labels.
    rows = failed.groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "id", "left")
    cells = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(good, n, 0)")).alias("good"), F.sum(F.expr("if(toxic, n, 0)")).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    bits = lambda text: " + ".join(
        f"if(instr({text}, '{x}') > 0, {1 << i}, 0)" for i, x in enumerate(letters))
    laid = (cells.withColumn("filter_order", F.explode(orders))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
            .withColumn("own", F.expr(bits("substring(filter_order, step, 1)")))
            .withColumn("earlier", F.expr(bits("substring(filter_order, 1, step - 1)"))))
    fails, fresh = "mask & own != 0", "mask & earlier = 0"
    return laid.groupBy("part", "filter_order", "step").agg(*[
        F.sum(F.expr(f"if({c}, {v}, 0)")).cast("bigint").alias(name) for name, c, v in (
            ("kept", "mask & (own | earlier) = 0", "n"), ("removed", f"{fails} AND {fresh}", "n"),
            ("redundant", f"{fails} AND NOT ({fresh})", "n"), ("unique_fails", "mask = own", "n"),
            ("good_lost", f"{fails} AND {fresh}", "good"), ("toxic_lost", f"{fails} AND {fresh}", "toxic"),
            # A mask of k filters is removed by each of them in one order out of k.
            ("shapley", fails, f"n * {math.factorial(len(letters))} div bit_count(mask)"))])


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"),
                                                   (F.col("toxic") == 1).alias("toxic"))
    return audit(failures(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), labels)


def op13_sql() -> str:
    letters = "".join(FILTERS)
    bits = lambda text: " + ".join(
        f"CASE WHEN contains({text}, '{x}') THEN {1 << i} ELSE 0 END" for i, x in enumerate(letters))
    return rf"""WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
letter AS (SELECT unnest(string_split_regex('{letters}', '')) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, {bits("substr(filter_order, step, 1)")} AS own,
  {bits("substr(filter_order, 1, step - 1)")} AS earlier
  FROM orders, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6))),
cells AS (SELECT part, mask, good, toxic, count(*) AS n FROM masks GROUP BY ALL),
laid AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
  coalesce(sum(n) FILTER (WHERE good AND mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost,
  coalesce(sum(n) FILTER (WHERE toxic AND mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM laid"""
