"""Language ID of code-switched text by a linear-chain conditional random field.

Every word of a text is one position.  A word's score for a language is the
sum of learned weights of its features: affixes, character n-grams and
membership in the languages' lexicons.  Transitions between languages are
learned too, from training sequences that switch language.  Forward-backward
gives each word its probabilities; a text's language is the largest mean
probability over its words.

Training reads text and language of a bounded sample of the training rows:
``PER_LABEL`` rows of each language in hash order, all languages, and of these
rows up to ``TRAIN_WORDS`` words a language; the lexicons hold up to ``LEXICON``
words a language.  The fit runs in one task.
Held-out rows (CRC-32 of the id's text modulo 3 is 1) are never among them.
Prediction reads only the text, whole texts of all rows.

Defined cases: null text, or text without a letter, is ``und`` with score 0;
so is every text when there is nothing to learn from.  Equal probabilities go
to the alphabetically first language.  Repeated rows are predicted each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.llm.common import CHUNK, give_back, map_rows, table

UND = "und"
PER_LABEL = 500           # training rows of each language
SNIPPET = (4, 40)         # words of one language in a row in training sequences
TRAIN_WORDS = 150_000     # words taken from each language's sample
LEXICON = 2000            # words of each language's lexicon
BITS = 17                 # feature space
BLOCK = 64                # positions that the scans treat in one step
BATCH = 32_768            # words of a training step
PAIRS = 1 << 23           # label pairs of positions held at a time in training
EPOCHS = 3
WORD = re.compile(r"[^\W\d_]+")
MEMORY = 100_000          # words a task remembers
MIX = 0x9E3779B97F4A7C15  # odd multiplier of the feature hash
SALT = {"gram": 1, "prefix": 2, "suffix": 3}


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; none if the text has no letter."""
    got = WORD.findall((text or "").lower())
    return got if any(any(map(str.isalpha, w)) for w in got) else []


class Features:
    """Feature numbers of words: hashed affixes and character n-grams, lexicon membership."""

    def __init__(self, lexicon: dict[str, list[int]], labels: int):
        self.lexicon, self.labels, self.size = lexicon, labels, 2 ** BITS + labels + 1

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(features of all words laid end to end, features per word)."""
        letters = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(words)), size)          # word of each letter
        left = np.arange(len(letters)) - begin[of]
        right = size[of] - left                              # letters from here to the word's end
        ids, owner = [], []
        h = np.zeros(len(letters), np.uint64)
        rolled = letters.astype(np.uint64)
        for k in range(1, 6):
            h = h * np.uint64(MIX) + rolled + np.uint64(k)   # hash of the k letters from here
            rolled = np.append(rolled[1:], np.uint64(0))
            for kind, fits in (("gram", right >= k), ("prefix", (left == 0) & (right >= k)), ("suffix", right == k)):
                if (kind == "gram") == (k <= 3):
                    at = np.flatnonzero(fits)
                    x = (h[at] + np.uint64(SALT[kind])) * np.uint64(MIX)
                    ids.append((x >> np.uint64(64 - BITS)).astype(np.int64))
                    owner.append(of[at])
        listed = [(i, f) for i, w in enumerate(words) for f in self.lexicon.get(w, (self.labels,))]
        owner.append(np.array([i for i, _ in listed], np.int64))
        ids.append(np.array([f for _, f in listed], np.int64) + 2 ** BITS)
        owner_all, ids_all = np.concatenate(owner), np.concatenate(ids)
        order = np.argsort(owner_all, kind="stable")
        return ids_all[order], np.bincount(owner_all, minlength=len(words))


def scan(e: np.ndarray, start: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors (each scaled to sum 1) of texts laid end to end.

    ``e`` (words, labels) are positive word scores, ``first`` marks first words.
    The row is cut into blocks; block products are formed for all blocks at
    once, chained, and the vectors then filled in for all blocks at once.
    """
    n, m = e.shape
    nb = -(-n // BLOCK)
    pad = nb * BLOCK - n
    e = np.concatenate([e, np.ones((pad, m))]).reshape(nb, BLOCK, m).transpose(1, 0, 2).copy()
    first = np.concatenate([first, np.ones(pad, bool)]).reshape(nb, BLOCK)
    fresh = [np.flatnonzero(first[:, t]) for t in range(BLOCK)]
    prod = np.broadcast_to(np.eye(m), (nb, m, m)).copy()
    for t in range(BLOCK):
        step = (prod.reshape(-1, m) @ trans).reshape(nb, m, m)
        step[fresh[t]] = prod[fresh[t]].sum(2, keepdims=True) * start
        step *= e[t][:, None]
        if t % 4 == 3:
            step /= step.sum((1, 2))[:, None, None]
        prod = step
    alpha0, beta1 = np.empty((nb, m)), np.empty((nb, m))
    a = start.copy()
    for i in range(nb):
        alpha0[i] = a
        a = a @ prod[i]
        a /= a.sum()
    b = np.full(m, 1 / m)
    for i in range(nb - 1, -1, -1):
        beta1[i] = b
        b = prod[i] @ b
        b /= b.sum()
    alpha, beta = np.empty((BLOCK, nb, m)), np.empty((BLOCK, nb, m))
    a = alpha0
    for t in range(BLOCK):
        step = a @ trans
        step[fresh[t]] = start
        step *= e[t]
        a = np.divide(step, step.sum(1)[:, None], out=alpha[t])
    b = beta1
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = b
        c = e[t] * b
        b = c @ trans.T
        b[fresh[t]] = (c[fresh[t]] @ start)[:, None]
        b /= b.sum(1)[:, None]
    flat = lambda x: x.transpose(1, 0, 2).reshape(-1, m)[:n]
    return flat(alpha), flat(beta)


def potentials(x: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(x - x.max(1, keepdims=True), -30.0))


class Model:
    def __init__(self, labels: list[str], features: Features):
        self.labels, self.features = labels, features
        m = len(labels)
        self.w = np.zeros((features.size, m), np.float32)
        self.trans = np.zeros((m, m))
        self.start = np.zeros(m)

    def scores(self, words: list[str]) -> np.ndarray:
        """Word scores (words, labels)."""
        flat, size = self.features(words)
        return np.add.reduceat(self.w[flat], np.cumsum(size) - size, axis=0).astype(np.float64)

    def chain(self) -> tuple[np.ndarray, np.ndarray]:
        norm = lambda x: np.exp(x - x.max())
        return norm(self.start), norm(self.trans)

    def probabilities(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        start, trans = self.chain()
        alpha, beta = scan(potentials(e), start, trans, first)
        p = alpha * beta
        return p / p.sum(1, keepdims=True)


def lexicons(by_label: list[list[str]]) -> dict[str, list[int]]:
    """word -> languages in whose lexicon it is: the words most frequent there against elsewhere."""
    counts = [Counter(x) for x in by_label]
    total = [max(1, len(x)) for x in by_label]
    top: dict[str, tuple[float, int, float]] = {}        # highest rate, its language, next highest rate
    for i, c in enumerate(counts):
        for w, n in c.items():
            first, at, second = top.get(w, (0.0, -1, 0.0))
            rate = n / total[i]
            top[w] = (rate, i, first) if rate > first else (first, at, max(second, rate))
    out: dict[str, list[int]] = {}
    for i, c in enumerate(counts):
        rate = lambda w: top[w][2] if top[w][1] == i else top[w][0]
        gain = {w: n / total[i] * np.log((n / total[i] + 1e-6) / (rate(w) + 1e-6)) for w, n in c.items() if n > 1}
        for w in sorted((w for w in gain if gain[w] > 0), key=lambda w: (-gain[w], w))[:LEXICON]:
            out.setdefault(w, []).append(i)
    return out


def switched(by_label: list[list[str]], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Training sequences: snippets of the languages in random turns; every word of the sample once."""
    at, words, tags, first, left = [0] * len(by_label), [], [], [], 0
    live = [i for i, x in enumerate(by_label) if x]
    while live:
        i = int(rng.choice(live))
        n = int(rng.integers(SNIPPET[0], SNIPPET[1] + 1))
        part = by_label[i][at[i]:at[i] + n]
        at[i] += n
        if at[i] >= len(by_label[i]):
            live.remove(i)
        new = left == 0
        left = int(rng.integers(1, 8)) if new else left - 1
        words += part
        tags += [i] * len(part)
        first += [new] + [False] * (len(part) - 1)
    if first:
        first[0] = True
    return words, np.array(tags, np.int64), np.array(first, bool)


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """The field that maximises the conditional likelihood of the training sequences (AdaGrad)."""
    labels = sorted({lang for _, lang in rows})
    by_label: list[list[str]] = [[] for _ in labels]
    for text, lang in rows:
        mine = by_label[labels.index(lang)]
        if len(mine) < TRAIN_WORDS:
            mine += words_of(text)
    if not any(by_label):
        return None
    model = Model(labels, Features(lexicons(by_label), len(labels)))
    rng = np.random.default_rng(seed)
    words, tags, first = switched(by_label, rng)
    m = len(labels)
    types = {w: i for i, w in enumerate(dict.fromkeys(words))}
    all_ids, all_size = model.features(list(types))
    all_begin = np.cumsum(all_size) - all_size
    seq = np.array([types[w] for w in words])
    gw, gt, gs = np.full(model.w.shape, 1e-3), np.full((m, m), 1e-3), np.full(m, 1e-3)
    for _ in range(EPOCHS):
        for lo in range(0, len(seq), BATCH):
            part, tag, new = seq[lo:lo + BATCH], tags[lo:lo + BATCH], first[lo:lo + BATCH].copy()
            new[0] = True
            used, inverse = np.unique(part, return_inverse=True)
            size = all_size[used]
            here = np.cumsum(size) - size
            flat = all_ids[np.repeat(all_begin[used] - here, size) + np.arange(size.sum())]
            score = np.add.reduceat(model.w[flat], here, axis=0).astype(float)[inverse]
            start, trans = model.chain()
            e = potentials(score)
            alpha, beta = scan(e, start, trans, new)
            p = alpha * beta
            p /= p.sum(1, keepdims=True)
            truth = np.eye(m)[tag]
            inner = np.flatnonzero(~new)
            pairs = np.zeros((m, m))
            for at in range(0, len(inner), max(1, PAIRS // (m * m))):
                some = inner[at:at + max(1, PAIRS // (m * m))]
                pair = alpha[some - 1][:, :, None] * trans * (e[some] * beta[some])[:, None, :]
                pairs += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            seen = np.zeros((m, m))
            np.add.at(seen, (tag[inner - 1], tag[inner]), 1)
            grad = np.empty(model.w.shape)
            for i in range(m):
                per_type = np.bincount(inverse, (p - truth)[:, i], len(used))
                grad[:, i] = np.bincount(flat, np.repeat(per_type, size), len(grad))
            grad = grad / len(part) + 1e-6 * model.w
            for g, acc, param in ((grad, gw, model.w),
                                  ((pairs - seen) / len(part) + 1e-4 * model.trans, gt, model.trans),
                                  ((p - truth)[new].sum(0) / len(part) + 1e-4 * model.start, gs, model.start)):
                acc += g * g * (1e4 if param is model.w else 1.0)
                param -= (0.5 * g * (1e2 if param is model.w else 1.0) / np.sqrt(acc)).astype(param.dtype)
    return model


def training_rows(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The bounded sample ``text, lang``: ``PER_LABEL`` ids in hash order of each language.

    Ids are chosen first; only the chosen texts travel.  Of several texts of
    one id and language the smallest counts.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (known.select("id", "lang").distinct().withColumn("n", F.row_number().over(order))
              .filter(F.col("n") <= PER_LABEL).drop("n"))
    return known.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).select("text", "lang")


def fit_rows(rows: DataFrame, seed: int = 5) -> Model | None:
    """``fit`` on a bounded sample ``text, lang`` in one task; only the model comes to the driver."""

    def run(batches):
        got = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        got.sort(key=lambda x: (zlib.crc32(x[0].encode("utf-8", "surrogatepass")), x))
        model = fit(got, seed)
        del got
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        give_back()

    # One partition even for no rows at all: the task runs and gives no model.
    found = rows.select("text", "lang").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def held_out(key) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Predictor:
    """Language of texts by a model; the words of a task are scored once."""

    def __init__(self, model: Model | None):
        self.model, self.number = model, {}
        self.store = np.zeros((1024, len(model.labels) if model else 1))

    def numbers(self, texts: list[list[str]]) -> dict[str, int]:
        number = self.number
        if len(number) > MEMORY:
            number.clear()
        new = list({w for x in texts for w in x if w not in number})
        while len(number) + len(new) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        for lo in range(0, len(new), 20_000):
            part, at = new[lo:lo + 20_000], len(number)
            number.update((w, at + i) for i, w in enumerate(part))
            self.store[at:at + len(part)] = self.model.scores(part)
        return number

    def predict(self, raw: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, words) of every text."""
        texts = [words_of(t) if self.model else [] for t in raw]
        full = [i for i, x in enumerate(texts) if x]
        out = [(UND, 0.0, 0)] * len(raw)
        if full:
            number = self.numbers(texts)
            size = np.array([len(texts[i]) for i in full])
            begin = np.cumsum(size) - size
            first = np.zeros(size.sum(), bool)
            first[begin] = True
            e = self.store[np.fromiter((number[w] for i in full for w in texts[i]), np.int64, size.sum())]
            mean = np.add.reduceat(self.model.probabilities(e, first), begin, axis=0) / size[:, None]
            for i, m in zip(full, mean, strict=True):
                top = int(np.argmax(m))
                out[i] = self.model.labels[top], float(min(1.0, m[top])), len(texts[i])
        return out


def identify(df: DataFrame, id_col: str, text_col: str, model: Model | None) -> DataFrame:
    """``id_col, lang_pred, score, n_words`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)      # 2^BITS weights a language

    def make():
        predictor = Predictor(shared.value)

        def run(rows):
            got = predictor.predict([t for _, t in rows])
            return [(key, *x) for (key, _), x in zip(rows, got, strict=True)]
        return run

    key = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make,
                    f"`{id_col}` {key}, lang_pred string, score double, n_words bigint")


def recognised(df: DataFrame, text_col: str, model: Model | None, min_score: float) -> DataFrame:
    """The rows whose text has a language with at least ``min_score``, unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches):
        predictor = Predictor(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                got = predictor.predict(part.column(place).to_pylist())
                yield part.filter(pa.array([lang != UND and score >= min_score for lang, score, _ in got], pa.bool_()))
        del predictor
        give_back()

    return df.mapInArrow(run, df.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_rows(training_rows(docs, "doc_id", "text", "lang"))
    return identify(docs, "doc_id", "text", model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words")
