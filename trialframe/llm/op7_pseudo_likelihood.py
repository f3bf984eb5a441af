"""LM scoring by masked pseudo-likelihood.

A network with a bidirectional window predicts every word of a text from the
``SIDE`` words on either side, the word itself masked; the sum of the
conditional log-probabilities scores the text.  The network knows ``WORDS``
frequent words, counted by Spark over the whole corpus, and hash buckets for
the others; a word of a bucket has the bucket's probability times the word's
share of the bucket's occurrences, so every distinct word has its own
probability.  The shares come from the table of all word counts, joined to the
words of the texts; the table is never held whole.  The hidden layer adds one
vector per window place and word; the output is a two-step softmax, first a
class of ``CLASS`` words, then a word of the class.

Training is numpy inside Spark tasks: in each of ``ROUNDS`` rounds every task
trains a copy of the network on a share of the positions of all its texts
(every ``ROUNDS``-th of each text, another share each round, so that the
rounds together train on every position), and Spark averages the copies,
weighted by positions.  What is gathered, word counts and one copy a
task, grows with the corpus; what reaches the driver are four averages.

Defined cases: a null, empty or wordless text has no words, log-probability 0
and null mean; any length is scored whole; repeated rows are scored each; an
empty table gives an empty table; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm import shingles as S
from trialframe.llm.common import give_back, shared_table, table

WORDS, BUCKETS = 3072, 1024
CLASS = 64                             # words of a class; (WORDS + BUCKETS) / CLASS classes
SIDE = 2                               # words on either side
HIDDEN = 32
ROUNDS = 2
BATCH = 4096
SCORED = 4096                          # words scored at a time
RATE = 0.15
MERGE = (64, 4)                        # partial averages of network copies, in two steps
U = np.uint64


def word_counts(texts: DataFrame) -> DataFrame:
    """w, n: hash and count of every word of the only column, a written table."""
    def count(batches):
        for batch in batches:
            got = [S.words(data, offsets, plain=True)[0] for _, _, data, offsets in S.text_pieces(batch.column(0))]
            w, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, U), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    return shared_table(texts.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")


def vocabulary(texts: DataFrame, counts: DataFrame | None = None) -> np.ndarray:
    """Hashes of the most frequent words of the only column, in order of their counts over the whole corpus (ties by hash)."""
    counts = word_counts(texts) if counts is None else counts
    rows = counts.orderBy(F.desc("n"), "w").limit(WORDS).toArrow()
    w, n = (rows[c].to_numpy().astype(np.int64) for c in ("w", "n"))
    return w[np.lexsort((w, -n))].view(U)


def shares(counts: DataFrame, vocab: np.ndarray) -> DataFrame:
    """w, share: log of the part that every word beyond the vocabulary has of its bucket's occurrences."""
    known = counts.sparkSession.createDataFrame([(int(x),) for x in vocab.view(np.int64)], "w long")       # at most WORDS rows
    rare = (counts.join(F.broadcast(known), "w", "left_anti")
            .withColumn("bucket", F.shiftrightunsigned("w", 40) % BUCKETS))
    total = rare.groupBy("bucket").agg(F.sum("n").alias("total"))                                        # at most BUCKETS rows
    return rare.join(F.broadcast(total), "bucket").select("w", F.log(F.col("n") / F.col("total")).alias("share"))


class Coder:
    """Word numbers: rank by frequency, or a hash bucket after the frequent words."""

    def __init__(self, vocab: np.ndarray):
        self.order = np.argsort(vocab)
        self.sorted = vocab[self.order]

    def __call__(self, w: np.ndarray) -> np.ndarray:
        other = (WORDS + (w >> U(40)) % U(BUCKETS)).astype(np.int32)
        if not len(self.sorted):
            return other
        at = np.searchsorted(self.sorted, w)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == w, self.order[at].astype(np.int32), other)


def windows(ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(2 * SIDE, words) numbers around every word; the pad number beyond a text's ends."""
    pad = WORDS + BUCKETS
    place = np.arange(len(ids)) + 2 * SIDE * np.repeat(np.arange(len(count)), count) + SIDE
    row = np.full(len(ids) + 2 * SIDE * (len(count) + 1), pad, np.int32)
    row[place] = ids
    return np.stack([row[place + o] for o in range(-SIDE, SIDE + 1) if o])


class Network:
    """Parameters in one float32 vector, so that copies can be averaged.  The last row of a weight matrix is the
    bias: the hidden layer ends in a column of ones."""

    CLASSES = (WORDS + BUCKETS) // CLASS
    SHAPES = (("inner", (2 * SIDE, WORDS + BUCKETS + 1, HIDDEN)), ("bias", (HIDDEN,)),
              ("klass", (HIDDEN + 1, CLASSES)), ("word", (CLASSES, HIDDEN + 1, CLASS)))

    def __init__(self, flat: np.ndarray | None = None):
        size = sum(int(np.prod(s)) for _, s in self.SHAPES)
        if flat is None:
            flat = np.random.default_rng(3).normal(0, 0.1, size).astype(np.float32)
        self.flat, at, self.rooms = flat, 0, {}
        for name, shape in self.SHAPES:
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    def room(self, name: str, *shape: int) -> np.ndarray:
        """A work array that every batch uses again: new ones of this size cost more in page faults than the sums in them."""
        n = int(np.prod(shape))
        if name not in self.rooms or self.rooms[name].size < n:
            self.rooms[name] = np.empty(n, np.float32)
        return self.rooms[name][:n].reshape(shape)

    def rows(self, name: str, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """x[at] in a work array (all places are inside; ``clip`` only spares a copy)."""
        return np.take(x, at, axis=0, out=self.room(name, len(at), x.shape[1]), mode="clip")

    def hidden(self, around: np.ndarray) -> np.ndarray:
        n = around.shape[1]
        x = self.rows("sum", self.inner[0], around[0])
        for o in range(1, 2 * SIDE):
            x += self.rows("part", self.inner[o], around[o])
        x += self.bias
        np.tanh(x, out=x)
        h = self.room("hidden", n, HIDDEN + 1)
        h[:, :HIDDEN], h[:, HIDDEN] = x, 1
        return h

    def by_class(self, around: np.ndarray, target: np.ndarray):
        """Row order by class; in that order the words around, hidden layer, class, place in the class; and
        ``(class, from, to)`` runs."""
        order = np.argsort((target // CLASS).astype(np.int16), kind="stable")
        around, target = around[:, order], target[order]
        klass = target // CLASS
        cut = np.searchsorted(klass, np.arange(self.CLASSES + 1))
        runs = [(c, cut[c], cut[c + 1]) for c in np.flatnonzero(np.diff(cut))]
        return order, around, self.hidden(around), klass, target % CLASS, runs

    def logits(self, h: np.ndarray, runs) -> tuple[np.ndarray, np.ndarray]:
        """Of all classes, and of the words of each row's class."""
        of_class = np.matmul(h, self.klass, out=self.room("of class", len(h), self.CLASSES))
        of_word = self.room("of word", len(h), CLASS)
        for c, lo, hi in runs:
            np.matmul(h[lo:hi], self.word[c], out=of_word[lo:hi])
        return of_class, of_word

    def log_prob(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every target, given the words around it."""
        order, _, h, klass, place, runs = self.by_class(around, target)
        of_class, of_word = self.logits(h, runs)
        out = np.empty(len(target), np.float32)
        out[order] = pick(of_class, klass) + pick(of_word, place)
        return out

    def train(self, around: np.ndarray, target: np.ndarray, seen: Network) -> None:
        """One AdaGrad step on a batch; ``seen`` holds the squared gradients so far."""
        n = len(target)
        _, around, h, klass, place, runs = self.by_class(around, target)
        g, q = map(softmax, self.logits(h, runs))
        g[np.arange(n), klass] -= 1
        q[np.arange(n), place] -= 1
        back = np.matmul(g, self.klass[:HIDDEN].T, out=self.room("back", n, HIDDEN))
        part = self.room("part", n, HIDDEN)
        grad = self.room("of words", *self.word.shape)
        grad.fill(0)
        for c, lo, hi in runs:
            np.matmul(q[lo:hi], self.word[c, :HIDDEN].T, out=part[lo:hi])
            np.matmul(h[lo:hi].T, q[lo:hi], out=grad[c])
        back += part
        grad /= n
        self.step(self.klass, seen.klass, h.T @ g / n)
        self.step(self.word, seen.word, grad)
        slope = np.square(h[:, :HIDDEN], out=part)
        np.subtract(1, slope, out=slope)
        slope /= n
        back *= slope
        self.step(self.bias, seen.bias, back.sum(0))
        inner, sums = (net.inner.reshape(-1, HIDDEN) for net in (self, seen))
        places = (around + self.inner.shape[1] * np.arange(2 * SIDE)[:, None]).astype(np.int16).ravel()   # below 2^15
        order = np.argsort(places, kind="stable")
        ids = places[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        used = ids[first].astype(np.int64)
        each, grad = self.rows("each", back, order % n), self.room("of places", len(first), HIDDEN)
        np.add.reduceat(each.view(np.complex64), first, axis=0, out=grad.view(np.complex64))     # two sums in one
        param, acc = self.rows("param", inner, used), self.rows("acc", sums, used)
        self.step(param, acc, grad)
        inner[used], sums[used] = param, acc

    def step(self, param: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        """AdaGrad in place; ``grad`` is used up."""
        root = np.square(grad, out=self.room("root", *grad.shape))
        seen += root
        np.add(seen, np.float32(1e-8), out=root)
        np.sqrt(root, out=root)
        grad /= root
        grad *= np.float32(RATE)
        param -= grad


def tame(x: np.ndarray) -> None:
    """Shift rows in place to a largest value of 0 where float32 could not hold the exponentials."""
    if x.size and (x.max() > 40 or x.min() < -40):
        x -= x.max(1, keepdims=True)


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    tame(x)
    np.exp(x, out=x)
    x *= (1 / row_sums(x))[:, None]
    return x


def pick(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each row at one place; ``x`` is used up."""
    tame(x)
    got = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return got - np.log(row_sums(x))


def share(count: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Positions of round ``r`` in texts of ``count`` words laid end to end: within a text, every ``rounds``-th."""
    begin = np.cumsum(count) - count
    return np.flatnonzero((np.arange(count.sum()) - np.repeat(begin, count)) % rounds == r)


def fit(texts: DataFrame, vocab: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters after ``rounds`` rounds of training on the only column in all tasks, and averaging."""
    sc = texts.sparkSession.sparkContext
    coder = sc.broadcast(Coder(vocab))
    flat = Network().flat
    for r in range(rounds):
        start = sc.broadcast(flat)

        def run(batches, start=start, r=r):
            net, seen = Network(start.value.copy()), Network(np.zeros_like(start.value))
            n, around, target = 0, [], []

            def learn(all_: bool):
                a, t = np.concatenate(around, 1), np.concatenate(target)
                done = 0
                while len(t) - done >= BATCH or (all_ and done < len(t)):
                    net.train(a[:, done:done + BATCH], t[done:done + BATCH], seen)
                    done += BATCH
                return [a[:, done:]], [t[done:]]

            for batch in batches:
                for _, _, data, offsets in S.text_pieces(batch.column(0)):
                    w, count = S.words(data, offsets, plain=True)
                    if not len(w):
                        continue
                    ids = coder.value(w)
                    mine = share(count, r, rounds)
                    around.append(windows(ids, count)[:, mine])
                    target.append(ids[mine])
                    n += len(mine)
                    if sum(map(len, target)) >= 8 * BATCH:
                        around, target = learn(False)
            if n:
                learn(True)
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([net.flat.tobytes()], pa.binary())], ["n", "net"])

        def add(frames):
            total, n = None, 0
            for f in frames:
                for k, b in zip(f["n"], f["net"], strict=True):
                    x = np.frombuffer(b, np.float32).astype(np.float64) * k
                    total, n = (x if total is None else total + x), n + k
            if n:
                yield pd.DataFrame({"n": [n], "net": [(total / n).astype(np.float32).tobytes()]})

        nets = texts.mapInArrow(run, "n long, net binary")
        for parts in MERGE:
            nets = nets.repartition(parts).mapInPandas(add, "n long, net binary")
        got = nets.collect()
        if not got:
            break
        flat = (sum(np.frombuffer(x["net"], np.float32).astype(np.float64) * x["n"] for x in got)
                / sum(x["n"] for x in got)).astype(np.float32)
    return flat


def score(df: DataFrame, id_col: str, text_col: str, vocab: np.ndarray, flat: np.ndarray,
          counts: DataFrame | None = None) -> DataFrame:
    """``id_col, n_words, log_prob, mean_log_prob`` for every row; ``counts`` (``word_counts``) cover the words of ``df``."""
    sc = df.sparkSession.sparkContext
    coder, params = sc.broadcast(Coder(vocab)), sc.broadcast(flat)

    def run(batches):
        net, row = Network(params.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi, data, offsets in S.text_pieces(batch.column(1)):
                w, count = S.words(data, offsets, plain=True)
                ids = coder.value(w)
                around = windows(ids, count)
                lp = np.empty(len(ids), np.float64)
                for at in range(0, len(ids), SCORED):
                    lp[at:at + SCORED] = net.log_prob(around[:, at:at + SCORED], ids[at:at + SCORED])
                cut = np.concatenate([[0], np.cumsum(count)])
                total = np.concatenate([[0.0], np.cumsum(lp)])
                other = ids >= WORDS
                rare = np.concatenate([[0], np.cumsum(other)])[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo),
                     pa.array(count.astype(np.int64)), pa.array(total[cut[1:]] - total[cut[:-1]]),
                     pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(w[other].view(np.int64)))],
                    ["row", "key", "n_words", "net", "rare"])
                row += hi - lo
        give_back()

    key = df.schema[id_col].dataType.simpleString()
    scored = shared_table(df.select(id_col, text_col).mapInArrow(
        run, f"row long, key {key}, n_words long, net double, rare array<long>"), "word-scores")
    share = shares(word_counts(df.select(text_col)) if counts is None else counts, vocab)
    within = (scored.select("row", F.explode("rare").alias("w")).join(share, "w", "left")
              .groupBy("row").agg(F.sum("share").alias("within")))
    total = F.col("net") + F.coalesce("within", F.lit(0.0))
    return scored.drop("rare").join(within, "row", "left").select(
        F.col("key").alias(id_col), "n_words", total.alias("log_prob"),
        F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_prob"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = word_counts(docs.select("text"))
    vocab = vocabulary(docs.select("text"), counts)
    return score(docs, "doc_id", "text", vocab, fit(docs.select("text"), vocab), counts)
