"""Approximate nearest neighbours by a forest of random-projection trees.

Largest inner product becomes nearest direction by one extra coordinate,
``sqrt(M^2 - |x|^2)`` (M the largest norm; 0 for queries).  Each tree cuts
space by the difference of two random points at the median projection.  The
trees are fitted on a bounded sample (``SAMPLE`` distinct vectors in hash
order); every row is then routed to one leaf of each tree by Spark.  A query
walks all trees through one priority queue, best margin first, and takes as
many leaves as a calibration says: ``CALIBRATION`` query vectors are searched
exactly over all rows, and the fewest leaves that give ``TARGET`` recall on
them are used.  Queries and rows meet by (tree, leaf, block); inner products
of the original vectors in double precision rank them.

Equal vectors are one entry with their ``k + 1`` smallest ids, enough for any
answer, so a vector that a third of all rows share is no hot group.  A lower
bound that a query gets from the sample, in all leaves but its first, drops
pairs that cannot be among its ``k`` best, no others.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; neither do null ids.  A repeated row (same id and
vector) counts once.  Ties go to the smaller id.  With fewer than ``k``
candidates all found are returned; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.llm.common import shared_table, table

K = 20
TREES = 8
LEAF = 400              # rows a leaf is meant to hold
MAX_DEPTH = 10
SAMPLE = 20_000         # distinct vectors that the trees are fitted on
CALIBRATION = 200       # query vectors that set the number of leaves
TARGET = 0.95           # recall on them
BLOCK = 2048            # rows of a leaf in one task group
SALTS = 32


def entries(df: DataFrame, id_col: str, vec_col: str, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(classes, queries): distinct vectors as ``cid, vec, ids, asked`` and query rows as ``query_id, cid``."""
    x = F.col("vec")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
            .filter(F.col("id").isNotNull() & x.isNotNull() & good).distinct())
    asked = F.pmod("id", F.lit(every)) == 0
    # The k + 1 smallest ids of a vector, in two steps so that no task holds all rows of a frequent one.
    part = (rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "id").agg(F.max(asked).alias("asked")))
    first = part.withColumn("n", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).filter(F.col("n") <= k + 1)
    flags = part.groupBy("vec").agg(F.max("asked").alias("asked"))
    classes = (first.groupBy("vec").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
               .join(flags, "vec").select(F.monotonically_increasing_id().alias("cid"), "vec", "ids", "asked"))
    classes = shared_table(classes, "ann-classes")
    queries = rows.filter(asked).join(classes.filter("asked").select("vec", "cid"), "vec").select(
        F.col("id").alias("query_id"), "cid")
    return classes, queries


def matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


class Forest:
    """Complete trees of median cuts over the augmented vectors of a sample."""

    def __init__(self, sample: np.ndarray, top_norm: float, depth: int, trees: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.top, self.depth, self.n = top_norm, depth, trees
        x = self.augment(sample)
        cuts = 2 ** depth - 1
        self.normal = np.zeros((trees, cuts, x.shape[1]), np.float32)
        self.at = np.zeros((trees, cuts), np.float32)
        for t in range(trees):
            members = {0: np.arange(len(x))}
            for node in range(cuts):
                idx = members.pop(node)
                d = x[rng.choice(idx)] - x[rng.choice(idx)] if len(idx) > 1 else np.zeros(x.shape[1])
                norm = np.linalg.norm(d)
                if norm < 1e-9:
                    d = rng.normal(size=x.shape[1])
                    norm = np.linalg.norm(d)
                self.normal[t, node] = d / norm
                p = x[idx] @ self.normal[t, node]
                self.at[t, node] = np.median(p) if len(idx) else 0.0
                right = p > self.at[t, node]
                members[2 * node + 1], members[2 * node + 2] = idx[~right], idx[right]

    def augment(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top ** 2 - (x ** 2).sum(1)))
        return np.concatenate([x, extra[:, None]], 1).astype(np.float32)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees) leaf numbers."""
        a = self.augment(x)
        out = np.zeros((len(x), self.n), np.int32)
        for t in range(self.n):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", a, self.normal[t, node]) > self.at[t, node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2 ** self.depth - 1)
        return out

    def walk(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) pairs of one query through the shared priority queue, best margin first."""
        a = self.augment(q[None], query=True)[0]
        margin = self.normal @ a - self.at
        first = 2 ** self.depth - 1
        queue = [(0.0, t, 0) for t in range(self.n)]
        while queue:
            worst, t, node = heapq.heappop(queue)
            if node >= first:
                yield t, node - first
                continue
            m = float(margin[t, node])
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (worst, t, near))
            heapq.heappush(queue, (max(worst, abs(m)), t, far))


def top_pairs(q: np.ndarray, x: np.ndarray, low: np.ndarray, first_id: np.ndarray, k: int):
    """(query row, entry row, score) of each query's ``k`` best entries at or above its bound."""
    score = q @ x.T
    for i, s in enumerate(score):
        at = np.flatnonzero(s >= low[i])
        if len(at) > k:
            at = at[np.lexsort((first_id[at], -s[at]))[:k]]
        for j in at:
            yield i, j, float(s[j])


def calibrate(classes: DataFrame, forest: Forest, k: int) -> int:
    """Fewest leaves a query has to take for ``TARGET`` recall on the calibration queries."""
    asked = classes.filter("asked").orderBy(F.xxhash64("cid"), "cid").limit(CALIBRATION).select("cid", "vec").collect()
    if not asked or not forest.depth:
        return forest.n
    q, own = matrix(r["vec"] for r in asked), [r["cid"] for r in asked]

    def best(frames):
        # A task keeps its k + 1 best of each calibration query while it reads.
        kept: dict[int, list] = {i: [] for i in range(len(q))}
        for f in frames:
            if len(f):
                x, cid = matrix(f["vec"]), f["cid"].to_numpy()
                got = list(top_pairs(q, x, np.full(len(q), -np.inf), cid, k + 1))
                leaf = forest.leaves(x[[j for _, j, _ in got]]).tolist()
                for (i, j, s), at in zip(got, leaf, strict=True):
                    kept[i].append((-s, int(cid[j]), at))
                kept = {i: sorted(v)[:k + 1] for i, v in kept.items()}
        rows = [(i, c, -s, at) for i, v in kept.items() for s, c, at in v]
        yield pd.DataFrame(rows, columns=["q", "cid", "score", "leaf"])

    found = (classes.select("cid", "vec").mapInPandas(best, "q int, cid long, score double, leaf array<int>")
             .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    top = lambda: F.slice(F.sort_array(F.collect_list(F.struct("score", "cid", "leaf")), False), 1, k + 1)
    exact = (found.groupBy("q", "salt").agg(top().alias("best")).select("q", F.inline("best"))
             .groupBy("q").agg(top().alias("best")).collect())
    need: list[int] = []
    for r in exact:
        order = {leaf: n for n, leaf in enumerate(forest.walk(q[r["q"]]), 1)}
        near = [b for b in r["best"] if b["cid"] != own[r["q"]]][:k]
        need += [min(order[t, leaf] for t, leaf in enumerate(b["leaf"])) for b in near]
    need.sort()
    return need[min(len(need) - 1, int(TARGET * len(need)))] if need else forest.n


def nearest(df: DataFrame, id_col: str, vec_col: str, every: int = 20, k: int = K, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for rows whose id is divisible by ``every`` against all rows."""
    spark = df.sparkSession
    classes, queries = entries(df, id_col, vec_col, every, k)
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(r["vec"] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").collect())
    depth = int(np.clip(np.ceil(np.log2(facts["n"] / LEAF)), 0, MAX_DEPTH))
    forest = Forest(sample, float(np.sqrt(facts["top"])), depth, trees if depth else 1)
    probes = calibrate(classes, forest, k)
    blocks = max(1, int(np.ceil(facts["n"] / 2 ** depth / BLOCK)))
    shared = spark.sparkContext.broadcast((forest, sample.astype(np.float32)))     # SAMPLE vectors and 2^MAX_DEPTH cuts at most

    def index(frames):
        forest, _ = shared.value
        for f in frames:
            if len(f):
                leaf = forest.leaves(matrix(f["vec"]))
                for t in range(forest.n):
                    yield pd.DataFrame({"tree": t, "leaf": leaf[:, t], "block": f["cid"] % blocks, "cid": f["cid"],
                                        "first": [i[0] for i in f["ids"]], "vec": f["vec"]})

    def routed(frames):
        forest, sample = shared.value
        for f in frames:
            for lo in range(0, len(f), 256):
                g = f.iloc[lo:lo + 256]
                q = matrix(g["vec"])
                s = q @ sample.T.astype(np.float64)
                # Itself and 3 k others reach the bound.  The first leaf goes without one, so that an answer is
                # full even where the walk misses most of those.
                low = np.partition(s, -(3 * k + 1), axis=1)[:, -(3 * k + 1)] if s.shape[1] > 3 * k else np.full(len(q), -np.inf)
                rows = [(t, leaf, b, i, at) for i in range(len(g))
                        for at, (t, leaf) in enumerate(first_n(forest.walk(q[i]), probes)) for b in range(blocks)]
                t, leaf, b, i, at = (np.array(c) for c in zip(*rows, strict=True))
                yield pd.DataFrame({"tree": t, "leaf": leaf, "block": b, "cid": g["cid"].to_numpy()[i],
                                    "low": np.where(at == 0, -np.inf, low[i] - 1e-9 * np.abs(low[i])), "vec": g["vec"].to_numpy()[i]})

    def meet(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, first, cid = matrix(a["vec"]), a["first"].to_numpy(), a["cid"].to_numpy()
            for lo in range(0, len(b), 512):
                g = b.iloc[lo:lo + 512]
                own = g["cid"].to_numpy()
                out += [(own[i], cid[j], s) for i, j, s in
                        top_pairs(matrix(g["vec"]), x, g["low"].to_numpy(), first, k + 1)]
        return pd.DataFrame(out, columns=["qid", "cid", "score"])

    vec = df.schema[vec_col].dataType.simpleString()
    keys = ["tree", "leaf", "block"]
    rows = classes.select("cid", "ids", "vec").mapInPandas(
        index, f"tree int, leaf int, block int, cid long, first long, vec {vec}")
    asks = classes.filter("asked").select("cid", "vec").mapInPandas(
        routed, f"tree int, leaf int, block int, cid long, low double, vec {vec}")
    pairs = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(meet, "qid long, cid long, score double")
    pairs = pairs.groupBy("qid", "cid").agg(F.max("score").alias("score"))
    hits = pairs.join(classes.select("cid", "ids"), "cid").select("qid", F.col("score"), F.explode("ids").alias("vec_id"))
    best = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("far"), F.col("vec_id")))).alias("best"))
    own = queries.join(best.select(F.col("qid").alias("cid"), F.slice("best", 1, k + 1).alias("best")), "cid")
    mine = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(mine).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (-F.col("b.far")).alias("score"))


def first_n(it: Iterator, n: int) -> Iterator:
    for _, x in zip(range(n), it, strict=False):
        yield x


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
