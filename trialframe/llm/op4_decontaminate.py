"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

The index holds the benchmark; the training texts are the queries.  Items are
cut into units of at most ``UNIT`` words, texts into passages of ``PASSAGE``
words every ``STEP``, so that any copied unit lies whole in a passage.  A
posting's impact is its BM25 weight as a share of the unit's own score, so one
threshold fits units of all lengths.  Units are numbered by length and grouped
into ``BLOCKS`` blocks; per term and block the largest impact is kept.

Every passage first sums the block maxima of its rarer words, in numpy for all
passages of a batch, and gets a block's whole share of common words; a passage
that no such bound lifts over the threshold has no hit.  The others are
searched by block-max WAND, which returns every unit at or above the
threshold.  A found item is a hit when the text around
the passage holds enough of the word 4-grams of its question, and of those that reach into its
answer.

The benchmark is a stated query set: it is indexed in groups of about
``GROUP`` units (document frequencies cover the whole benchmark), each group
broadcast (bounded by ``GROUP * UNIT`` postings) and run over all texts.

Defined cases: null or wordless texts and items have no hits; texts of any
length are cut whole into passages; of several passages with one item the best
overlap counts, then the first; repeated texts give repeated hits, repeated
items (same id) a hit each; empty tables give an empty table; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm import shingles as S
from trialframe.llm.common import give_back, map_rows, one_row_per, shared_table, table

UNIT = 48
PASSAGE, STEP = 96, 48
K1, B = 1.2, 0.75
THRESHOLD = 0.5           # share of a unit's own score
OVERLAP = 0.5             # share of 4-grams of question, and of answer
GRAM = 4
BLOCKS = 256              # blocks of an index
COMMON = 0.05             # share of units beyond which a term counts as common in the first bound
GROUP = 4000              # units of an index
SENTENCE = re.compile(r"[.!?\n][\"')\]]*\s+")


def answer_at(text: str) -> int:
    """Character where the answer begins: after the last question mark, else the last sentence, else the last third."""
    body = text.rstrip()
    q = body.rfind("?")
    if 0 <= q < len(body) - 1:
        return q + 1
    ends = [m.end() for m in SENTENCE.finditer(body)]
    if ends:
        return ends[-1]
    return len(body) * 2 // 3


def hashed(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    return S.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), plain=True)[0]


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashed n-grams of words; none of fewer words."""
    return S.shingle_sets(w, np.array([len(w)]), n)[0] if len(w) >= n else w[:0]


def sides(w: np.ndarray, question: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, n-grams of the question, n-grams that reach into the answer); n is ``GRAM``, less for a shorter item."""
    n = min(GRAM, len(w))
    ask = w[:max(question, n)] if question else w[:0]
    reply = w[max(0, question - n + 1):] if question < len(w) else w[:0]
    return n, grams(ask, n), grams(reply, n)


def units(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_row, item_id, unit, size, question, words, term, tf) postings of every unit."""

    def make():
        def run(rows):
            for row, key, text in rows:
                w = hashed(text or "")
                q = len(hashed(text[:answer_at(text)])) if len(w) else 0
                parts = -(-len(w) // UNIT)
                for u in range(parts):
                    mine = w[u * len(w) // parts:(u + 1) * len(w) // parts]
                    for i, (t, n) in enumerate(zip(*np.unique(mine, return_counts=True), strict=True)):
                        words = w.view(np.int64).tolist() if i == u == 0 else None
                        yield row, key, u, len(mine), q, words, int(t.view(np.int64)), int(n)
        return run

    key = benchmark.schema[id_col].dataType.simpleString()
    src = one_row_per(benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")), "item_row")
    return map_rows(src.select("item_row", "item_id", "text"), make, f"item_row long, item_id {key}, unit int, "
                    "size int, question int, words array<long>, term long, tf int")


class Index:
    """Impact postings of a group of units with list and block maxima."""

    def __init__(self, postings, n_units: int, mean_size: float):
        by_unit: dict[tuple[int, int], list] = {}
        self.items: dict[int, tuple] = {}
        for p in postings:
            by_unit.setdefault((p["item_row"], p["unit"]), []).append(p)
            if p["words"] is not None:
                w = np.array(p["words"], np.int64).view(np.uint64)
                self.items[p["item_row"]] = (p["item_id"], len(w), *sides(w, p["question"]))
        order = sorted(by_unit, key=lambda u: (by_unit[u][0]["size"], u))
        self.unit_item = [u[0] for u in order]
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, u in enumerate(order):
            weight = {p["term"]: math.log(1 + (n_units - p["df"] + 0.5) / (p["df"] + 0.5)) * p["tf"] * (K1 + 1) / (
                p["tf"] + K1 * (1 - B + B * p["size"] / mean_size)) for p in by_unit[u]}
            own = sum(weight.values())
            for t, w in weight.items():
                lists.setdefault(t, []).append((i, w / own))
        terms = np.array(list(lists), np.int64).view(np.uint64)
        order_t = np.argsort(terms)
        self.terms = terms[order_t]
        self.lists = [lists[int(t)] for t in self.terms.view(np.int64)]
        self.block = max(1, -(-len(order) // BLOCKS))
        self.blocks = -(-max(1, len(order)) // self.block)
        self.block_max: list[dict[int, float]] = []
        for post in self.lists:
            top: dict[int, float] = {}
            for i, w in post:
                top[i // self.block] = max(top.get(i // self.block, 0.0), w)
            self.block_max.append(top)
        self.list_max = np.array([max(x.values()) for x in self.block_max])
        # Terms of many units bring little: a passage gets their whole share of a unit at once.  The others'
        # block maxima are laid end to end for the first bound; words that are no term have none.
        often = [len(x) > max(4, COMMON * len(order)) for x in self.lists]
        rest = np.zeros(max(1, len(order)))
        for post, common in zip(self.lists, often, strict=True):
            for i, w in post:
                rest[i] += w * common
        self.rest = np.maximum.reduceat(rest, np.arange(0, len(rest), self.block))
        rare = [{} if common else x for x, common in zip(self.block_max, often, strict=True)]
        self.size = np.array([len(x) for x in rare] + [0])
        self.begin = np.cumsum(self.size) - self.size
        self.at = np.array([b for x in rare for b in x], np.int64)
        self.gain = np.array([w for x in rare for w in x.values()])

    def bounds(self, number: np.ndarray, step: np.ndarray, steps: int) -> np.ndarray:
        """(steps, blocks) sums of the block maxima of the rarer terms by step."""
        size = self.size[number]
        entry = np.repeat(self.begin[number] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(step, size) * self.blocks + self.at[entry]
        return np.bincount(cell, self.gain[entry], steps * self.blocks).reshape(steps, self.blocks)

    def numbers(self, w: np.ndarray) -> np.ndarray:
        """Term number of every word; the number of terms for other words."""
        if not len(self.terms):
            return np.zeros(len(w), np.int64)
        at = np.searchsorted(self.terms, w)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == w, at, len(self.terms))

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (unit, score) at or above ``threshold`` for a set of terms, by block-max WAND."""
        lists = [[self.lists[t], 0, float(self.list_max[t]), int(t)] for t in terms]
        end, out, slack = len(self.unit_item), [], 1e-6
        while True:
            lists = [x for x in lists if x[1] < len(x[0])]
            lists.sort(key=lambda x: x[0][x[1]][0])
            bound, pivot = 0.0, -1
            for i, x in enumerate(lists):
                bound += x[2]
                if bound >= threshold - slack:
                    pivot = i
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == unit:
                pivot += 1
            block = unit // self.block
            if sum(self.block_max[x[3]].get(block, 0.0) for x in lists[:pivot + 1]) < threshold - slack:
                # No unit of this block before the next list begins can reach the threshold.
                nxt = min((block + 1) * self.block, lists[pivot + 1][0][lists[pivot + 1][1]][0] if pivot + 1 < len(lists) else end)
                _advance(lists[:pivot + 1], nxt)
            elif lists[0][0][lists[0][1]][0] == unit:
                score = sum(x[0][x[1]][1] for x in lists[:pivot + 1])
                if score >= threshold:
                    out.append((unit, score))
                _advance(lists[:pivot + 1], unit + 1)
            else:
                _advance(lists[:pivot], unit)


def _advance(lists: list, unit: int) -> None:
    """Move each list to its first posting at or after ``unit``."""
    for x in lists:
        while x[1] < len(x[0]) and x[0][x[1]][0] < unit:
            x[1] += 1


def share(want: np.ndarray, have: np.ndarray) -> float:
    return float(np.isin(want, have, assume_unique=True).mean()) if len(want) else 1.0


def text_hits(w: np.ndarray, bounds: np.ndarray, number: np.ndarray, index: Index, threshold: float,
              overlap: float) -> list[tuple]:
    """(item_id, passage, score, question share, answer share) of one text, best passage of each item."""
    best: dict[int, tuple] = {}
    for p in np.flatnonzero(bounds >= threshold - 1e-4):
        lo, hi = int(p) * STEP, min(len(w), int(p) * STEP + PASSAGE)
        terms = np.unique(number[lo:hi])
        found: dict[int, float] = {}
        for unit, score in index.search(terms[terms < len(index.terms)], threshold):
            row = index.unit_item[unit]
            found[row] = max(score, found.get(row, 0.0))
        for row, score in found.items():
            key, size, n, question, answer = index.items[row]
            have = grams(w[max(0, lo - size):hi + size], n)
            q, a = share(question, have), share(answer, have)
            if q >= overlap and a >= overlap and (row not in best or q + a > best[row][3] + best[row][4]):
                best[row] = (key, int(p), float(score), q, a)
    return [best[r] for r in sorted(best)]


def indexes(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[Index]:
    """The benchmark's indexes, one of each group of units; the next is built when it is asked for."""
    post = shared_table(units(benchmark, item_col, item_text), "postings")
    sums = post.select("item_row", "unit", "size").distinct().agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    groups = -(-sums["n"] // GROUP)
    df_count = post.groupBy("term").agg(F.count("*").alias("df"))
    post = post.join(df_count, "term").withColumn("group", F.pmod(F.xxhash64("item_row"), F.lit(max(1, groups))))
    for g in range(groups):
        yield Index(post.filter(F.col("group") == g).collect(), sums["n"], sums["mean"])


def batch_hits(index: Index, column: pa.Array, threshold: float, overlap: float) -> Iterator[tuple[int, list[tuple]]]:
    """(row, hits) of the rows of a text column that hold an item."""
    for lo, _, data, offsets in S.text_pieces(column):
        w, count = S.words(data, offsets, plain=True)
        if not len(w):
            continue
        number = index.numbers(w)
        begin = np.cumsum(count) - count
        # Bounds of steps, then of the two steps of a passage.
        steps = -(-count // STEP)
        first = np.cumsum(steps) - steps
        inner = np.arange(steps.sum()) - np.repeat(first, steps)
        place = np.arange(len(w)) - np.repeat(begin, count)
        part = index.bounds(number, np.repeat(first, count) + place // STEP, len(inner))
        bound = part + index.rest
        more = inner + 1 < np.repeat(steps, steps)
        bound[:-1][more[:-1]] += part[1:][more[:-1]]
        bound = bound.max(1)
        owner = np.repeat(np.arange(len(count)), steps)
        for i in np.unique(owner[bound >= threshold - 1e-4]):
            b, n = begin[i], count[i]
            hits = text_hits(w[b:b + n], bound[first[i]:first[i] + steps[i]], number[b:b + n], index, threshold, overlap)
            if hits:
                yield lo + int(i), hits


def find_leaks(df: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
               threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``id_col, item_id, passage, score, question_overlap, answer_overlap``, a row per text row and item found."""
    spark = df.sparkSession
    key, item = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = T._parse_datatype_string(f"`{id_col}` {key}, item_id {item}, passage int, score double, "
                                      "question_overlap double, answer_overlap double")
    found = spark.createDataFrame([], schema)
    for index in indexes(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            from pyspark.sql.pandas.types import to_arrow_schema
            out = to_arrow_schema(schema)
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), *hit)
                        for i, hits in batch_hits(shared.value, batch.column(1), threshold, overlap) for hit in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        found = found.unionByName(df.select(id_col, text_col).mapInArrow(run, schema))
    return found


def without_leaks(df: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str,
                  threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows whose text holds no item, unchanged."""
    place = df.columns.index(text_col)
    for index in indexes(benchmark, item_col, item_text):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[i for i, _ in batch_hits(shared.value, batch.column(place), threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))
            give_back()

        df = df.mapInArrow(run, df.schema)
    return df


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text",
                      table(spark, sf_dir, "benchmark"), "item_id", "text")
