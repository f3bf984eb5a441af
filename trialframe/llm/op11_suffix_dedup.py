"""Removal of repeated long byte strings by a logarithmic family of suffix arrays.

A byte goes if some ``LENGTH``-byte string covering it also starts anywhere
else, in the same text or another.  Matches never cross texts.

*Sampled suffixes.*  Every window of ``LENGTH`` bytes takes the smallest hash of
its ``GRAM``-byte strings as its key, so equal windows have equal keys.
Windows in a row with one key are a run; a run is one entry of the index: its
key, a fingerprint of all its bytes, its place.  There is about one entry for
every 69 bytes of text.

*Index family.*  Entries of a new batch are sorted by key and fingerprint (a
sampled suffix array in fingerprint order: equal strings are neighbours in any
fixed order) with equal entries counted once, so that copies of a third of all
rows are one entry.  The batch is scanned against every existing level by a
merge join on the key; keys met twice are remembered.  Then levels of equal
rank merge to the next rank, as digits carry in a binary counter.

*Exact matches.*  An entry that occurs twice is removed whole.  Where different
runs share a key, the bytes of one run of each kind are fetched, laid out per
key, and a suffix array (prefix doubling to ``LENGTH`` bytes) shows by its
neighbours which windows occur twice.  A key whose runs hold more than
``HOT_BYTES`` is not laid out in one task: its windows are spread by their
fingerprints instead, with the same result.

Equality of whole runs rests on 128 hash bits.  Defined cases: null text counts
as empty; texts under ``LENGTH`` bytes keep all bytes; repeated rows are copies
of each other, whatever their id; a null id is kept.  An empty table gives no
rows.  Texts of any length are read whole.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import drop_table, give_back, map_rows, shared_table, table

LENGTH = 200              # bytes of a match
GRAM = 64                 # bytes of the strings whose smallest hash is a window's key
SPAN = LENGTH - GRAM + 1  # strings of a window
BATCHES = 4               # batches the query deals its documents into
PIECE = 1 << 20           # bytes sampled at a time
BLOCK = 1 << 21           # bytes of one suffix array, beyond the key it begins with
HOT_BYTES = 1 << 22       # runs of a key laid out in one task
SALTS = 32                # tasks over which the rows of one entry are spread
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
VALUE = np.random.default_rng(11).integers(1, 2 ** 63, 256, dtype=np.uint64) * U(2) + U(1)      # value of each byte


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the 0..n-1, and the inverses, modulo 2^64."""
    inverse = U(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Hashes:
    """Fingerprints of any byte string of a buffer by prefix sums."""

    UP, DOWN = powers(PIECE + 2 * LENGTH)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(self.UP):
            Hashes.UP, Hashes.DOWN = powers(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(VALUE[data] * self.UP[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        x = (self.sums[start + size] - self.sums[start]) * self.DOWN[start]
        return mix(x + np.asarray(size).astype(np.uint64))

    def all_grams(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.DOWN[:len(self.sums) - size])


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    m, done = h, 1
    while 2 * done <= span:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    return m if done == span else np.minimum(m[:len(h) - span + 1], m[span - done:])


def runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, key, fingerprint, twice) of every run of the texts ``data[begin:end]``.

    ``twice``: the key's string occurs more than once in the run, so that its
    own windows may be equal.
    """
    hashes = Hashes(data)
    grams = hashes.all_grams(GRAM)
    low = sliding_min(grams, SPAN)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, begin, 1)
    np.add.at(mark, end - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(mark[:len(low)]))
    key = low[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1] + 1)
    new[np.searchsorted(valid, begin)] = True
    at = np.flatnonzero(new)
    start, windows, key = valid[at], np.diff(np.append(at, len(valid))), key[at]
    view = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    twice = np.empty(len(start), bool)
    for lo in range(0, len(start), 8192):
        s, k = slice(lo, lo + 8192), key[lo:lo + 8192, None]
        last = start[s] + windows[s] - 1
        first_hit = start[s] + (view[start[s]] == k).argmax(1)
        last_hit = last + SPAN - 1 - (view[last] == k)[:, ::-1].argmax(1)
        twice[s] = first_hit != last_hit
    return start, windows, key, hashes.of(start, windows + LENGTH - 1), twice


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about ``PIECE`` bytes: (data, text number, begin, end, offset in the text) of their texts.

    Longer texts are cut into pieces that overlap by a window less one byte.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            part = t[at:at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if held and size + len(part) > PIECE + LENGTH - 1:
                yield pack(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield pack(held)


def pack(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join([p for _, _, p in held]), np.uint8)
    end = np.cumsum([len(p) for _, _, p in held])
    begin = end - np.array([len(p) for _, _, p in held])
    return data, np.array([i for i, _, _ in held]), begin, end, np.array([at for _, at, _ in held])


def entries(docs: DataFrame) -> DataFrame:
    """Runs of every text of ``docs`` (``d1, d2, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1, d2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            for data, number, begin, end, offset in pieces(texts):
                start, windows, key, fp, twice = runs(data, begin, end)
                part = np.searchsorted(begin, start, "right") - 1
                of = number[part]
                yield pa.RecordBatch.from_arrays([
                    pa.array(d1[of]), pa.array(d2[of]), pa.array(start - begin[part] + offset[part]),
                    pa.array(windows.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)),
                    pa.array(twice)], names=["d1", "d2", "start", "windows", "key", "run", "twice"])
        give_back()

    return docs.select("d1", "d2", "text").mapInArrow(
        run, "d1 bigint, d2 bigint, start bigint, windows bigint, key bigint, run bigint, twice boolean")


# ------------------------------------------------------------------ index family

class IndexFamily:
    """Levels of counted entries ``key, run, n, twice, salts``; level i stands for 2^i batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Enter a batch of entries; the keys it shares with itself or with earlier batches."""
        new = shared_table(ordered(batch.groupBy("key", "run").agg(
            F.count("*").alias("n"), F.max("twice").alias("twice"),
            F.bit_or(F.expr(f"shiftleft(1, cast(pmod(d1, {SALTS}) AS int))")).alias("salts"))), "level")
        keys = new.groupBy("key").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"))
        met = keys.filter("n > 1 OR twice").select("key")
        for level in self.levels.values():
            met = met.union(keys.select("key").join(level.select("key").distinct(), "key", "left_semi"))
        self.found.append(shared_table(met.distinct(), "met"))
        rank = 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            merged = shared_table(ordered(summed(new.union(old))), "level")
            drop_table(new)
            drop_table(old)
            new, rank = merged, rank + 1
        self.levels[rank] = new
        return self.found[-1]

    def shared(self) -> DataFrame:
        """Entries of all levels whose key was met twice."""
        found, *more = self.found
        for x in more:
            found = found.union(x)
        first, *rest = self.levels.values()
        for x in rest:
            first = first.union(x)
        return summed(first.join(found.distinct(), "key", "left_semi"))

    def drop(self) -> None:
        for x in (*self.levels.values(), *self.found):
            drop_table(x)
        self.levels, self.found = {}, []


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "run").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"), F.bit_or("salts").alias("salts"))


def ordered(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("key", "run")


# ------------------------------------------------------------------ exact matches

def suffix_ranks(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Rank of every suffix among all by its first ``depth`` bytes (prefix doubling; equal prefixes, equal ranks).

    Bytes beyond the end count as zeros.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)
    rank, done = np.unique(words, return_inverse=True)[1].astype(np.uint64), 8
    while done < depth:
        step = min(done, depth - done)
        after = np.zeros(len(rank), np.uint64)
        after[:-step or None] = rank[step:] + U(1)
        rank = np.unique(rank << U(32) | after, return_inverse=True)[1].astype(np.uint64)
        done += step
    return rank


def twice_in(parts: list[bytes]) -> list[np.ndarray]:
    """For each byte string the starts of its windows that occur more than once among all windows."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    windows, begin = size - LENGTH + 1, np.cumsum(size) - size
    of = np.repeat(np.arange(len(parts)), windows)
    local = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = suffix_ranks(data)[begin[of] + local].astype(np.int64)
    order = np.argsort(rank, kind="stable")                    # the suffix array of the windows
    equal = rank[order][1:] == rank[order][:-1]
    hit = np.zeros(len(order), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    return np.split(local[hit], np.cumsum(np.bincount(of[hit], minlength=len(parts)))[:-1])


def covered(starts: np.ndarray) -> list[int]:
    """Borders of the bytes that windows at ``starts`` (ascending) cover: from, to, from, to..."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH], 1).ravel().tolist()


def match_blocks(rows: DataFrame) -> DataFrame:
    """``key, run, borders`` of the removed bytes of every run; ``rows``: ``key, run, bytes``."""
    schema = "key bigint, run bigint, borders array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}

        def emit() -> pa.RecordBatch:
            got = [covered(x) for x in twice_in([*held.values()])]
            ids = [k for k, b in zip(held, got, strict=True) if b]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in ids], pa.int64()), pa.array([r for _, r in ids], pa.int64()),
                 pa.array([b for b in got if b], pa.list_(pa.int64()))], names=["key", "run", "borders"])

        size, last = 0, None
        for batch in batches:
            for key, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and key != last:
                    yield emit()
                    held.clear()
                    size = 0
                held[key, fp] = raw
                size, last = size + len(raw), key
        if held:
            yield emit()
        held.clear()
        give_back()

    return rows.select("key", "run", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def match_spread(rows: DataFrame) -> DataFrame:
    """The same as ``match_blocks`` for keys with very many runs: windows meet by their fingerprints."""

    def make():
        def run(got):
            for key, fp, raw in got:
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                hashes = Hashes(data)
                half = [hashes.of(at, LENGTH // 2).view(np.int64), hashes.of(at + LENGTH // 2, LENGTH // 2).view(np.int64)]
                yield from zip([key] * len(at), [fp] * len(at), at.tolist(), *(h.tolist() for h in half), strict=True)
        return run

    windows = map_rows(rows.select("key", "run", "bytes"), make,
                       "key bigint, run bigint, at bigint, f1 bigint, f2 bigint", chunk=64).distinct()
    windows = shared_table(windows.withColumn("salt", F.pmod("run", F.lit(SALTS))), "windows")
    hit = windows.join(met_twice(windows, ["f1", "f2"]), ["f1", "f2", "salt"], "left_semi")
    starts = hit.groupBy("key", "run").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    # A window begins or ends a stretch of removed bytes where its neighbour is more than a window away.
    first = f"filter(starts, (x, i) -> i = 0 OR x - starts[i - 1] > {LENGTH})"
    last = f"filter(starts, (x, i) -> i = size(starts) - 1 OR starts[least(i + 1, size(starts) - 1)] - x > {LENGTH})"
    return starts.select("key", "run", F.expr(
        f"flatten(zip_with({first}, {last}, (a, b) -> array(a, b + {LENGTH})))").alias("borders"))


def met_twice(rows: DataFrame, keys: list[str], least: str = "n > 1") -> DataFrame:
    """``keys, salt`` of the values of ``keys`` on more than one row, for the salts in which they are."""
    per = rows.groupBy(*keys, "salt").agg(F.count("*").alias("n"))
    return (per.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_set("salt").alias("salt")).filter(least)
            .select(*keys, F.explode("salt").alias("salt")))


def partial_matches(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``key, run, borders`` of the entries whose key has several kinds of runs, or one that may match itself."""
    kinds = hits.groupBy("key", "run").agg(F.min(F.struct("d1", "d2", "start", "windows")).alias("at"), F.max("twice").alias("twice"))
    kinds = kinds.withColumn("salt", F.pmod("run", F.lit(SALTS)))
    per = kinds.groupBy("key", "salt").agg(F.count("*").alias("n"), F.max("twice").alias("twice"),
                                           F.sum(F.expr(f"at.windows + {LENGTH - 1}")).alias("bytes"))
    several = (per.groupBy("key").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"), F.sum("bytes").alias("bytes"),
                                      F.collect_set("salt").alias("salt"))
               .filter("n > 1 OR twice").select("key", (F.col("bytes") > HOT_BYTES).alias("hot"), F.explode("salt").alias("salt")))
    wanted = kinds.join(several, ["key", "salt"]).groupBy("at.d1", "at.d2").agg(
        F.collect_list(F.struct("key", "run", "hot", "at.start", "at.windows")).alias("runs"))

    def make():
        def run(rows):
            for runs_, text in rows:
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs_:
                    yield r["key"], r["run"], r["hot"], raw[r["start"]:r["start"] + r["windows"] + LENGTH - 1]
        return run

    got = shared_table(map_rows(docs.join(wanted, ["d1", "d2"]).select("runs", "text"), make,
                                "key bigint, run bigint, hot boolean, bytes binary"), "bytes")
    return match_blocks(got.filter("NOT hot")).union(match_spread(got.filter("hot")))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text`` and two hashes of both: the same for a row however often it is read."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.withColumns({"d1": F.xxhash64("id", "text"), "d2": F.xxhash64("text", F.lit(1), "id")})


def repeated_spans(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``d1, d2, spans``: removed byte ranges (they may overlap) of the texts of ``docs`` (from ``keyed``)."""
    found = shared_table(entries(docs.filter(f"octet_length(text) >= {LENGTH}")), "entries")
    family = IndexFamily()
    for i in range(batches):
        family.add(found.filter(F.pmod(F.xxhash64("d1"), F.lit(batches)) == i))
    kinds = family.shared().select("key", "run", "n", F.explode(F.expr(
        f"filter(sequence(0, {SALTS - 1}), i -> getbit(salts, i) = 1)")).alias("salt"))
    hits = shared_table(found.withColumn("salt", F.pmod("d1", F.lit(SALTS)).cast("int"))
                        .join(kinds, ["key", "run", "salt"]).drop("salt"), "hits")
    family.drop()
    drop_table(found)
    whole = hits.filter("n > 1").select("d1", "d2", F.col("start").alias("from"),
                                        (F.col("start") + F.col("windows") + LENGTH - 1).alias("to"))
    partial = hits.filter("n = 1").join(partial_matches(hits, docs), ["key", "run"]).select(
        "d1", "d2", F.explode(F.expr("transform(sequence(0, size(borders) div 2 - 1), i -> struct(start + borders[2 * i] AS `from`,"
                                     " start + borders[2 * i + 1] AS `to`))")).alias("s")).select("d1", "d2", "s.from", "s.to")
    return whole.union(partial).groupBy("d1", "d2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def without_repeats(df: DataFrame, id_col: str, text_col: str, batches: int = BATCHES) -> DataFrame:
    """``id_col, n_bytes, spans, kept`` of every row: the removed byte ranges and the remaining bytes."""
    docs = keyed(df, id_col, text_col)
    found = docs.join(repeated_spans(docs, batches), ["d1", "d2"], "left").select("id", "text", "spans")

    def make():
        def run(rows):
            for key, text, spans in rows:
                raw = text.encode("utf-8", "surrogatepass")
                cut = merged([(s["from"], s["to"]) for s in spans or ()])
                borders = [0, *(x for span in cut for x in span), len(raw)]
                kept = b"".join([raw[lo:hi] for lo, hi in zip(borders[::2], borders[1::2], strict=True)])
                yield key, len(raw), [{"from": lo, "to": hi} for lo, hi in cut], kept
        return run

    key = df.schema[id_col].dataType.simpleString()
    return map_rows(found, make, f"`{id_col}` {key}, n_bytes bigint, spans array<struct<from:bigint,to:bigint>>, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "n_bytes", F.expr("n_bytes - octet_length(kept)").alias("n_removed"),
                      F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_sql() -> str:
    return f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS raw, octet_length(raw) AS len
  FROM documents),
hashed AS (SELECT rid, unnest(range(0, len - {LENGTH - 1})) AS s,
  unnest(list_transform(range(0, len - {LENGTH - 1}), lambda i: md5(raw[i + 1:i + {LENGTH}]))) AS m FROM texts),
hits AS (SELECT rid, s FROM hashed WHERE m IN (SELECT m FROM hashed GROUP BY m HAVING count(*) > 1)),
marked AS (SELECT rid, s, coalesce(s - lag(s) OVER (PARTITION BY rid ORDER BY s) > {LENGTH}, true) AS fresh FROM hits),
numbered AS (SELECT rid, s, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY s) AS span FROM marked),
spans AS (SELECT rid, span, min(s) AS a, max(s) + {LENGTH} AS b FROM numbered GROUP BY rid, span),
cuts AS (SELECT rid, list([a, b] ORDER BY a) AS cut, count(*) AS n, sum(b - a) AS gone FROM spans GROUP BY rid),
kept AS (SELECT doc_id, len AS n_bytes, coalesce(gone, 0) AS gone, coalesce(n, 0) AS n, hex(raw) AS h,
  list_concat([0], flatten(coalesce(cut, [])), [len]) AS edge FROM texts LEFT JOIN cuts USING (rid))
SELECT doc_id, n_bytes, CAST(gone AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(array_to_string(list_transform(
  range(0, n + 1), lambda i: substr(h, 2 * edge[2 * i + 1] + 1, 2 * (edge[2 * i + 2] - edge[2 * i + 1]))), ''))) AS kept_sha256
FROM kept"""
