"""Jaccard join, decontamination, pseudo-likelihood, neighbours, language ID, pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from trialframe.llm import op3_jaccard as jac
from trialframe.llm import op4_decontaminate as dec
from trialframe.llm import op7_pseudo_likelihood as lm
from trialframe.llm import op8_ann as ann
from trialframe.llm import op9_language as lang
from trialframe.llm import shingles
from trialframe.llm.components import components


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return frozenset({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)})


def brute_components(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(rows)]


def corpus(seed, n=160):
    """Texts with exact and near copies in chains, shared passages and short texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows, base = [], [rng.choice(vocab) for _ in range(90)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.45:
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.1:
                base = w
        elif kind < 0.7:
            w = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))] + passage
        else:
            w = [rng.choice(vocab[:3]) for _ in range(rng.randrange(0, 7))]
        rows.append((rng.randrange(10_000), " ".join(w) if rng.random() < 0.98 else None))
    return [*rows, rows[0], (rows[1][0], rows[2][1]), (10_001, "A B  c\x1cd \t e"), (10_002, "a b c\x1cd e")]


@pytest.mark.parametrize("leaf, block", [(48, 1500), (3, 12)])
def test_jaccard_equals_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jac, "LEAF", leaf)
    monkeypatch.setattr(jac, "BLOCK", block)
    rows = corpus(leaf)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS sig", "3 AS row").repartition(3)
    got = [tuple(r) for r in jac.near_duplicates(df, "doc_id", "text").drop("component").collect()]
    # Two rows may share an id; those without words keep it as their component.
    assert Counter(got) == Counter(brute_components(rows))


def test_jaccard_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (3, None), (4, ""), (5, " \n")], "doc_id long, text string")
    got = Counter(tuple(r) for r in jac.near_duplicates(df, "doc_id", "text").drop("component").collect())
    assert got == Counter([(None, 2, 7), (7, 2, 7), (3, 0, 3), (4, 0, 4), (5, 0, 5)])
    assert jac.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_join_block_recursion_equals_brute_force(monkeypatch):
    monkeypatch.setattr(jac, "LEAF", 4)
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2 ** 63, 40).astype(np.uint64) for _ in range(6)]
    sets = []
    for i in range(90):
        x = base[i % 6].copy()
        x[:rng.integers(0, 12)] = rng.integers(0, 2 ** 63, 1)
        sets.append(np.unique(x))
    side, comp = rng.integers(1, 4, 90), rng.integers(0, 70, 90)
    want = [(i, j) for i in range(90) for j in range(i) if ((side[i] & 1 and side[j] & 2) or (side[i] & 2 and side[j] & 1))
            and jac.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75)]
    got = jac.join_block(sets, side, comp, 75)

    def groups(edges):
        root = {c: c for c in comp}
        for i, j in edges:
            x, y = root[comp[i]], root[comp[j]]
            root = {c: y if r == x else r for c, r in root.items()}
        return {frozenset(c for c in root if root[c] == r) for r in root.values()}

    assert groups(got) == groups(want) and len(got) < len(set(comp)) and set(map(tuple, map(sorted, got))) <= {
        tuple(sorted(x)) for x in want}


def test_shingles_equal_python():
    texts = [None, "", " ", "a", "a b c", "A B  c\x1c", "x " * 9, "é É ß", "a b c d e f", "z" * 10_000]
    for _, _, _, size in shingles.column_sets(pa.array(texts)):
        assert size.tolist() == [len(shingle_set(t)) for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[200] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination

def test_tables_of_known_size_have_few_files(spark, monkeypatch):
    """The files of a small table follow its rows, not the shuffle partitions."""
    from trialframe.llm import common
    from trialframe.llm import components as comp
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    written = {}

    def spy(df, name, *args):
        out = common.shared_table(df, name, *args)
        written.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(comp, "shared_table", spy)
    monkeypatch.setattr(jac, "shared_table", spy)
    texts = [(i, " ".join(f"w{i // 4}x{j}" for j in range(30)) + (f" y{i}" if i % 2 else "")) for i in range(80)]
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 50], "a long, b long")
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        assert got == {i: max(1, (i - 1) // 50 * 50 + 1) for i in range(1, 301)}
        assert written["edges"][0] > 12 and max(written["edges"][1:]) == 1
        written.clear()
        df = spark.createDataFrame(texts, "doc_id long, text string")
        found = {r["doc_id"]: r["component_id"] for r in jac.near_duplicates(df, "doc_id", "text").collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert found == {i: i // 4 * 4 for i in range(80)}
    for name in ("seed-pairs", "seed-sets", "known", "fine-pairs", "components"):
        assert max(written[name]) == 1
    assert len(written["classes"]) == 1 and written["edges"][0] == 1
    few = common.shared_table(spark.range(50).repartition(10), "few", 50, 20)       # every row, whatever the bound
    assert len(few.inputFiles()) == 3 and few.count() == 50
    assert common.shared_table(spark.range(50).repartition(10), "few", 0).count() == 50


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(600)] + ["the", "of", "a"] * 30
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rng.randrange(8, 70)).capitalize()}? {say(rng.randrange(1, 12))}.") for i in range(40)] + [(90, None), (91, "")]
    rows, want = [], set()
    for d in range(150):
        t = say(rng.randrange(0, 300))
        if d % 3 == 0:
            i = rng.randrange(40)
            t = f"{t} {items[i][1]} {say(rng.randrange(0, 200))}"
            want.add((d, i))
        rows.append((d, t))
    rows += [(500, None), (501, ""), (502, items[0][1]), (503, items[0][1].split("?")[0])]
    want.add((502, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS unit")
    got = [(r[0], r[1]) for r in dec.find_leaks(df, "doc_id", "text", bench, "item_id", "text").collect()]
    assert sorted(got) == sorted(want)
    clean = dec.without_leaks(df, "text", bench, "item_id", "text")
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert dec.find_leaks(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert dec.find_leaks(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_groups_of_an_index_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(25)) + ". yes it is.") for i in range(30)]
    df = spark.createDataFrame([(i, f"zz yy {t} xx") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dec, "GROUP", 7)
    got = {(r[0], r[1]) for r in dec.find_leaks(df, "doc_id", "text", bench, "item_id", "text").collect()}
    assert got >= {(i, i) for i, _ in items}


@pytest.mark.parametrize("blocks", [256, 3])
def test_wand_equals_exhaustive(monkeypatch, blocks):
    monkeypatch.setattr(dec, "BLOCKS", blocks)
    rng = np.random.default_rng(2)
    post = []
    for row in range(40):
        t, tf = np.unique(rng.integers(0, 60, 12), return_counts=True)
        post += [{"item_row": row, "unit": 0, "item_id": row, "size": 12, "question": 6, "term": int(a), "tf": int(b), "df": 0,
                  "words": list(range(12)) if i == 0 else None} for i, (a, b) in enumerate(zip(t, tf, strict=True))]
    df = Counter(p["term"] for p in post)
    for p in post:
        p["df"] = df[p["term"]]
    index = dec.Index(post, 40, 12.0)
    for _ in range(300):
        terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 40)))
        score = Counter()
        for t in terms:
            for unit, w in index.lists[t]:
                score[unit] += w
        for threshold in (0.1, 0.3, 0.5):
            want = {u for u, s in score.items() if s >= threshold}
            assert {u for u, _ in index.search(terms, threshold)} == want
            bound = index.bounds(terms, np.zeros(len(terms), np.int64), 1)[0] + index.rest
            assert all(bound[u // index.block] >= threshold - 1e-9 for u in want)


# --- pseudo-likelihood

def test_network_learns_and_is_normalised():
    rng = np.random.default_rng(0)
    net = lm.Network()
    around, target = rng.integers(0, 4096, (2 * lm.SIDE, 1)), np.arange(lm.WORDS + lm.BUCKETS)
    p = np.exp(net.log_prob(np.repeat(around, len(target), 1), target).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-3)
    seen = lm.Network(np.zeros_like(net.flat))
    a, t = rng.integers(0, 30, (2 * lm.SIDE, 500)), rng.integers(0, 30, 500)
    before = net.log_prob(a, t).sum()
    for _ in range(30):
        net.train(a, t, seen)
    assert net.log_prob(a, t).sum() > before


@pytest.mark.parametrize("scale", [1, 60])      # 60: exponents that float32 cannot hold
def test_network_equals_plain_softmax(scale):
    rng = np.random.default_rng(5)
    net = lm.Network()
    net.klass *= scale
    net.word *= scale
    around, target = rng.integers(0, lm.WORDS + lm.BUCKETS + 1, (2 * lm.SIDE, 300)), rng.integers(0, lm.WORDS + lm.BUCKETS, 300)
    got = net.log_prob(around, target)

    def log_softmax(x):
        return x - x.max() - np.log(np.exp(x - x.max()).sum())

    for a, t, lp in zip(around.T, target, got, strict=True):
        h = np.append(np.tanh(sum(net.inner[o, w].astype(float) for o, w in enumerate(a)) + net.bias), 1)
        c, i = divmod(t, lm.CLASS)
        want = log_softmax(h @ net.klass)[c] + log_softmax(h @ net.word[c])[i]
        assert lp == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_step_follows_the_gradient():
    rng = np.random.default_rng(6)
    around, target = rng.integers(0, 6, (2 * lm.SIDE, 50)), rng.integers(0, 200, 50)
    net, seen = lm.Network(), lm.Network(np.zeros_like(lm.Network().flat))
    start = net.flat.copy()
    net.train(around, target, seen)
    moved = np.flatnonzero(seen.flat > 1e-8)
    assert len(moved) > 100
    for at in rng.choice(moved, 40, replace=False):
        up, down = start.copy(), start.copy()
        up[at] += 0.02
        down[at] -= 0.02
        loss = [-lm.Network(x).log_prob(around, target).astype(float).mean() for x in (up, down)]
        slope = (loss[0] - loss[1]) / (up[at] - down[at])
        assert np.sqrt(seen.flat[at]) == pytest.approx(abs(slope), rel=0.05, abs=5e-5)
        assert np.sign(start[at] - net.flat[at]) == np.sign(slope)


def test_windows_stay_inside_texts():
    pad = lm.WORDS + lm.BUCKETS
    w = lm.windows(np.array([1, 2, 3, 4], np.int32), np.array([3, 0, 1]))
    assert w.T.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad, pad, pad, pad]]


def test_score_learns_order(spark):
    good = [(i, "red green blue red green blue red green blue " * 8) for i in range(60)]
    odd = [(1000, "blue blue red red green green zz yy xx ww " * 3), (1001, None), (1002, ""), (1003, "...")]
    df = spark.createDataFrame(good + odd, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS n")
    vocab = lm.vocabulary(df.select("text"))
    got = {r["doc_id"]: r for r in lm.score(df, "doc_id", "text", vocab, lm.fit(df.select("text"), vocab)).collect()}
    assert len(got) == 64 and got[0]["mean_log_prob"] > got[1000]["mean_log_prob"] and got[0]["n_words"] == 72
    assert all(got[i]["n_words"] == 0 and got[i]["log_prob"] == 0 and got[i]["mean_log_prob"] is None for i in (1001, 1002, 1003))
    none = df.limit(0)
    assert lm.score(none, "doc_id", "text", lm.vocabulary(none.select("text")), lm.fit(none.select("text"), vocab)).count() == 0


def test_words_of_a_bucket_have_their_own_probability(spark):
    names = [f"v{i}" for i in range(lm.WORDS)]
    bucket = lambda x: int(shingles.words(*arrow(x), plain=True)[0][0] >> np.uint64(40)) % lm.BUCKETS
    rare, other = next((f"r{i}", f"r{j}") for j in range(9999) for i in range(j) if bucket(f"r{i}") == bucket(f"r{j}"))
    rows = [(0, " ".join(names * 5)), (1, f"v1 {rare} v2"), (2, f"v1 {other} v2"), (3, f"{other} {other}"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = lm.vocabulary(df.select("text"))
    got = {r["doc_id"]: r for r in lm.score(df, "doc_id", "text", vocab, lm.Network().flat).collect()}
    assert len(vocab) == lm.WORDS and len(got) == 5
    assert got[2]["log_prob"] - got[1]["log_prob"] == pytest.approx(np.log(3), abs=1e-5)     # 3 of 4 against 1 of 4
    share = {r["w"]: r["share"] for r in lm.shares(lm.word_counts(df.select("text")), vocab).collect()}
    assert len(share) == 2 and sum(np.exp(x) for x in share.values()) == pytest.approx(1)
    assert got[4]["log_prob"] == 0 and got[4]["mean_log_prob"] is None


def test_rounds_train_on_every_position(spark, monkeypatch):
    count = np.array([3, 0, 1, 7, 2])
    for rounds in (1, 2, 3):
        assert sorted(np.concatenate([lm.share(count, r, rounds) for r in range(rounds)]).tolist()) == list(range(13))
    df = spark.createDataFrame([(i, "one two three four five six seven"[:n]) for i, n in enumerate([3, 7, 13, 33, 33])],
                               "doc_id long, text string")
    words = sum(len(r["text"].split()) for r in df.collect())
    trained = spark.sparkContext.accumulator(0)
    train = lm.Network.train
    batches = []

    def counted(self, around, target, seen):
        batches.append(len(target))
        train(self, around, target, seen)

    monkeypatch.setattr(lm.Network, "train", counted)

    class Here:                          # the tasks of fit run in this process
        def __init__(self, df):
            self.df, self.sparkSession = df, df.sparkSession

        def mapInArrow(self, run, schema):
            out = list(run(self.df.toArrow().to_batches()))
            trained.add(sum(b.column(0)[0].as_py() for b in out))
            return self.df.sparkSession.createDataFrame([(b.column(0)[0].as_py(), b.column(1)[0].as_py()) for b in out], schema)

    lm.fit(Here(df.select("text")), lm.vocabulary(df.select("text")))
    assert trained.value == sum(batches) == words


def arrow(text):
    (_, _, data, offsets), = shingles.text_pieces(pa.array([text]))
    return data, offsets


# --- neighbours

def test_neighbours_recall_and_cases(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 60)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 16))
    x[100:300] = x[100]                                    # a vector that many rows share
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (2060, [None] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([*rows, rows[20]], "vec_id long, embedding array<float>").selectExpr("*", "1 AS cid", "2 AS vec")
    got = ann.nearest(df, "vec_id", "embedding").toPandas()
    assert set(got["query_id"]) == set(range(0, 900, 20))
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, f in got.groupby("query_id"):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -s.round(9))) if i != q][:20]
        f = f.sort_values("rank")
        assert list(f["rank"]) == list(range(1, 21)) and q not in set(f["vec_id"])
        assert np.allclose(f["score"], s[f["vec_id"]]) and (np.diff(f["score"]) <= 1e-9).all()
        hits += len(set(order) & set(f["vec_id"]))
    assert hits / (20 * 45) >= 0.9
    assert ann.nearest(df.limit(0), "vec_id", "embedding").count() == 0


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df, "vec_id", "embedding").collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 0, 1.0), (20, 3, 3, 1.0)]


# --- language ID

def test_scan_equals_plain_forward_backward():
    rng = np.random.default_rng(1)
    n, m = 300, 3
    e, trans, start = rng.random((n, m)) + 0.01, rng.random((m, m)) + 0.1, rng.random(m) + 0.1
    first = rng.random(n) < 0.05
    first[0] = True
    alpha, beta = lang.scan(e, start, trans, first)
    got = alpha * beta
    got /= got.sum(1, keepdims=True)
    cut = [*np.flatnonzero(first), n]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        a, b = np.zeros((hi - lo, m)), np.ones((hi - lo, m))
        for t in range(hi - lo):
            a[t] = (start if t == 0 else a[t - 1] @ trans) * e[lo + t]
            a[t] /= a[t].sum()
        for t in range(hi - lo - 2, -1, -1):
            b[t] = trans @ (e[lo + t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = a * b
        assert np.allclose(got[lo:hi], p / p.sum(1, keepdims=True))


def test_language_held_out_and_cases(spark):
    rng = random.Random(2)
    part = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ver", "ung", "ein"], "cc": ["ción", "ado", "ñe", "que"]}
    say = lambda k, n: " ".join("".join(rng.choice(part[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i, k in enumerate(rng.choice([*part]) for _ in range(300))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ²³ ?!", "aa"), (1003, say("bb", 9000), None), (rows[0][0], rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS score")
    train = lang.training_rows(df, "doc_id", "text", "lang")
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    texts = {r["text"] for r in train.collect()}
    assert texts and not held & texts
    got = lang.identify(df, "doc_id", "text", lang.fit_rows(train)).collect()
    pred = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert np.mean([pred[i]["lang_pred"] == k for i, _, k in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97
    assert all(pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert pred[1003]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    none = lang.fit_rows(lang.training_rows(df.limit(0), "doc_id", "text", "lang"))
    assert none is None and {r["lang_pred"] for r in lang.identify(df, "doc_id", "text", none).collect()} == {"und"}


def test_every_language_is_learned(spark):
    names = [f"l{i:03d}" for i in range(100)]
    rows = [(3 * i + j, f"text {k}", k) for i, k in enumerate(names) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    free = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(free) > 64 and {r["lang"] for r in lang.training_rows(df, "doc_id", "text", "lang").collect()} == free
    twice = spark.createDataFrame([(7, "b", "x"), (7, "a", "x"), (None, "c", "x")], df.schema)      # repeated and null ids
    assert [tuple(r) for r in lang.training_rows(twice, "doc_id", "text", "lang").collect()] == [("a", "x")]


def test_words_of_switched_text():
    rng = random.Random(1)
    de = ["eins", "zwei", "drei", "vier", "und", "der", "schön", "gegen"]
    en = ["one", "two", "three", "four", "and", "the", "nice", "which"]
    rows = [(" ".join(rng.choice(w) for _ in range(200)), k) for k, w in (("de", de), ("en", en)) for _ in range(20)]
    model = lang.fit(rows)
    w = lang.words_of("Eins zwei drei vier, one two three four")
    p = model.probabilities(model.scores(w), np.array([True] + [False] * 7))
    assert [model.labels[i] for i in p.argmax(1)] == ["de"] * 4 + ["en"] * 4


# --- pipeline

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["the", "of", "thing", "water", "stone", "river"]) + rng.choice("abcde") for _ in range(n))
    item = "Which river is longest of them all? The nile it is said."
    docs = [(i, say(60), "en", f"s{i % 5}", 0) for i in range(40)]
    docs += [(100, docs[0][1], "en", "s1", 0), (101, docs[0][1] + " end", "en", "s2", 0), (101, docs[0][1] + " end", "en", "s2", 0),
             (102, say(20) + " " + item, "en", "s0", 0), (103, "1234 !!", "en", "s0", 0), (104, None, None, None, None),
             (105, say(20) + " token = '9f86d081884c7d659a2feaa0c55ad015'", "en", "s0", 0), (None, say(30), "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        kept.append(frame.collect())
        if len(kept) < 5:
            assert frame.columns == list(corpus_pipeline.COLUMNS)
            frame = spark.createDataFrame(kept[-1], schema)
    ids = [sorted(r["doc_id"] for r in k if r["doc_id"] is not None) for k in kept]
    assert set(ids[0]) == {*range(40), 100, 101, 102, 105}
    assert ids[1] == [*range(40), 102, 105] and ids[2] == [*range(40), 105] and ids[3] == ids[2] == ids[4]
    assert all(any(r["doc_id"] is None for r in k) for k in kept)
    text = next(r for r in kept[3] if r["doc_id"] == 105)
    assert "[SECRET]" in text["text"] and "9f86" not in text["text"] and text["n_chars"] == len(text["text"])
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(kept[4])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
