"""Suffix-array dedup, Merkle manifest, filter audit: brute force and defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialframe.llm import op11_suffix_dedup as dup
from trialframe.llm import op12_manifest as man
from trialframe.llm import op13_filter_audit as aud

SHA = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


# --- repeated strings

def brute_removed(texts, n=dup.LENGTH):
    count = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = set()
        for i in range(len(t) - n + 1):
            if count[t[i:i + n]] > 1:
                gone.update(range(i, i + n))
        out.append((gone, bytes(b for i, b in enumerate(t) if i not in gone)))
    return out


def repeat_texts(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(300)
    texts = [prose(150) for _ in range(6)]
    texts += [prose(rng.randrange(40)) + " " + passage + " " + prose(rng.randrange(40)) for _ in range(25)]
    texts += [base] * 5 + [base[:400] + "X" + base[401:], base[200:900], base[:dup.LENGTH], base[:dup.LENGTH - 1]]
    return [*texts, "a" * 1000, "ab" * 300 + prose(20) + "ab" * 300, "", None, "short", "lone " + "z" * 250 + prose(30)]


@pytest.mark.parametrize("hot, batches", [(dup.HOT_BYTES, 4), (0, 4), (dup.HOT_BYTES, 1), (dup.HOT_BYTES, 7)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, batches):
    monkeypatch.setattr(dup, "HOT_BYTES", hot)          # 0: every key by spread windows
    texts = repeat_texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int")
    got = {r["doc_id"]: r for r in dup.without_repeats(df, "doc_id", "text", batches).collect()}
    want = brute_removed([(t or "").encode() for t in texts])
    assert len(got) == len(texts)
    for i, (gone, kept) in enumerate(want):
        assert bytes(got[i]["kept"]) == kept, i
        assert sum(s["to"] - s["from"] for s in got[i]["spans"]) == len(gone)
        assert got[i]["n_bytes"] == len((texts[i] or "").encode())


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(str(i * i) for i in range(200))
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(1, text), (1, text), (None, text + " end"), (None, None)], schema)
    got = sorted((r["doc_id"] or -1, bytes(r["kept"])) for r in dup.without_repeats(df, "doc_id", "text").collect())
    assert got == [(-1, b""), (-1, b" end"), (1, b""), (1, b"")]
    assert dup.without_repeats(spark.createDataFrame([], schema), "doc_id", "text").collect() == []


def test_runs_hold_every_window_once_and_pieces_do_not_matter(monkeypatch):
    texts = [(t or "").encode() for t in repeat_texts(8)]

    def keys(piece):
        monkeypatch.setattr(dup, "PIECE", piece)
        out, at = {}, Counter()
        for data, number, begin, end, offset in dup.pieces(texts):
            start, windows, key, _, _ = dup.runs(data, begin, end)
            part = np.searchsorted(begin, start, "right") - 1
            for p, s, n, k in zip(part, start, windows, key, strict=True):
                for x in range(s - begin[p] + offset[p], s - begin[p] + offset[p] + n):
                    at[number[p], x] += 1
                    window = texts[number[p]][x:x + dup.LENGTH]
                    assert len(window) == dup.LENGTH and out.setdefault(window, k) == k
        assert set(at.values()) == {1} and len(at) == sum(max(0, len(t) - dup.LENGTH + 1) for t in texts)
        return out

    assert keys(1 << 20) == keys(777)


def test_suffix_ranks_order_prefixes():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(600)) + b"ab" * 300
    rank = dup.suffix_ranks(np.frombuffer(data, np.uint8), 40)
    prefix = [data[i:i + 40] for i in range(len(data) - 40)]
    for i in range(0, len(prefix), 7):
        for j in range(0, len(prefix), 11):
            assert (prefix[i] < prefix[j]) == (rank[i] < rank[j]) and (prefix[i] == prefix[j]) == (rank[i] == rank[j])


def test_family_keeps_one_level_for_each_binary_digit(spark):
    family, levels = dup.IndexFamily(), []
    for i in range(5):
        rows = [(i, 0, 0, 10, 5, 5, False), (i, 0, 9, 10, 100 + i, 1, False)]
        met = family.add(spark.createDataFrame(rows, "d1 long, d2 long, start long, windows long, key long, run long, twice boolean"))
        assert [r["key"] for r in met.collect()] == ([5] if i else [])
        levels.append(sorted(family.levels))
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]
    assert [(r["key"], r["n"]) for r in family.shared().collect()] == [(5, 5)]
    family.drop()


# --- manifest

def brute_tree(nodes):
    """(root, siblings of every node) of a list of digests."""
    place, paths, level = list(range(len(nodes))), [""] * len(nodes), nodes
    while len(level) > 1:
        runs = [level[i:i + 16] for i in range(0, len(level), 16)]
        for i, p in enumerate(place):
            paths[i] += "".join(runs[p // 16][:p % 16] + runs[p // 16][p % 16 + 1:])
        place, level = [p // 16 for p in place], [SHA("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows):
    record = lambda r: "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0], SHA(record(r))))
    names = sorted(groups, key=lambda s: s.encode())
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: brute_tree([h for _, h in groups[g]]) for g in names}
    root, above = brute_tree([trees[g][0] for g in names])
    return sorted((str(i), h, trees[g][0], root, SHA(p + above[k]))
                  for k, g in enumerate(names) for (i, h), p in zip(groups[g], trees[g][1], strict=True))


def manifest_rows():
    rows = [(i, "hot", None if i % 7 else "en", i, f"Text É {i}") for i in range(700)]
    rows += [(i, f"s{i % 37}é", "de", None, None if i % 3 else "x") for i in range(1000, 1100)]
    rows += [(5, "sixteen", "x", 1, str(i)) for i in range(16)] + [(i, "seventeen", "x", 1, "t") for i in range(17)]
    rows += [(1, None, None, None, None), (None, None, "a", 2, ""), (2, "one", "", 0, "A")] + [(9, "same", "a", 1, "A")] * 20
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_manifest_equals_brute_force_and_finds_changes(spark):
    rows = manifest_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("g", F.lit("x")).withColumn("idx", F.lit(0))
    got = man.manifest(df, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"],
                       {"text": F.translate("text", man.UPPER, man.LOWER)}, F.col("doc_id") % 5 == 0)
    got = got.select("*", man.digest(man.proof(F.col("path"))).alias("proof"),
                     man.folded(F.col("candidate"), F.col("path")).alias("folded"),
                     man.folded(F.col("leaf"), F.col("path")).alias("own")).collect()
    assert sorted((str(r["id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == brute_manifest(rows)
    changed = Counter(r["id"] for r in got if r["folded"] != r["root"])
    upper = [r for r in rows if r[0] is not None and r[0] % 5 == 0 and r[4] and r[4] != r[4].translate(
        str.maketrans(man.UPPER, man.LOWER))]
    assert changed == Counter(r[0] for r in upper) and all(r["own"] == r["root"] for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    columns = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    one = man.manifest(spark.createDataFrame([(3, "s", None, 1, "t")], SCHEMA), "doc_id", "source", columns).collect()
    leaf = SHA("1:31:s-1:11:t")
    assert [(r["leaf"], r["subroot"], r["root"], r["path"], r["candidate"]) for r in one] == [(leaf, leaf, leaf, [], leaf)]
    assert man.manifest(spark.createDataFrame([], SCHEMA), "doc_id", "source", columns).collect() == []


def test_crc_rule_of_the_sql():
    assert zlib.crc32(b"123456789") == 0xCBF43926          # the polynomial that the SQL's table is made of


# --- filter audit

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_measures(t):
    t = t or ""
    w = WORDS.findall(t)
    return [len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in "#$%&*|" for c in t)]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_transducer_equals_brute_force(monkeypatch, piece):
    monkeypatch.setattr(aud, "PIECE", piece)
    rng = random.Random(1)
    alphabet = [*" \t\n\x0b\x1f\x00abB#|é漢😀\xa0\x85", "abcdefgh", "abcdefghi", "abcdefghijklmnopq"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(600)]
    texts += [None, "", "x" * 500, "é" * 300, " " * 300, "a " * 300, "long " * 50]
    assert aud.measure(pa.array(texts, pa.string())).tolist() == [brute_measures(t) for t in texts]
    assert aud.measure(pa.array(["zz", None, "a b"], pa.string()).slice(1)).tolist() == [[0] * 5, [2, 2, 0, 3, 0]]


def test_equal_hashes_do_not_merge_words(monkeypatch):
    monkeypatch.setattr(aud.Spans, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert aud.measure(pa.array(["a b a c abcdefghX abcdefghY", "a a b"])).tolist() == [
        brute_measures("a b a c abcdefghX abcdefghY"), brute_measures("a a b")]


def test_audit_equals_simulation(spark):
    rng = random.Random(3)
    long = " ".join(f"w{i}" for i in range(250))
    pool = [long, long + " #", long.upper(), "a " * 300, "short", "", None, long + " x", "A b # " * 3]
    rows = [(rng.randrange(60), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += [(None, long, "en"), (None, None, "de")]
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(40)] + [(1, True, None), (None, True, True), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit(1)).withColumn(
        "salt", F.lit("x")).withColumn("mask", F.lit(0))
    failed = aud.failures(df, "doc_id", "text", "lang")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in aud.audit(
        failed, spark.createDataFrame(labels, "id long, good boolean, toxic boolean")).collect()}
    good = {i for i, g, _ in labels if g and i is not None}
    toxic = {i for i, _, t in labels if t and i is not None}

    def fails(i, t):
        n, d, cap, points, sym = brute_measures(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        return {x for x, f in zip("ABCDE", (n < 200, 100 * d < 50 * n, 100 * cap > 3 * points, sym > 0, copy), strict=True) if f}

    marked = [(lang or "", i, fails(i, t)) for i, t, lang in rows]
    parts = {p for p, _, _ in marked}
    want, removed_by = {}, Counter()
    for part in parts:
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in marked if p == part]
            full = left
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[part, x] += len(gone)
                want[part, "".join(order), step] = (
                    len(left), len(gone), sum(x in f for _, f in full) - len(gone), sum(f == {x} for _, f in full),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    assert {k: tuple(r[c] for c in names) for k, r in got.items()} == want
    assert all(r["shapley"] == removed_by[p, o[s - 1]] for (p, o, s), r in got.items())


def test_audit_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "id long, good boolean, toxic boolean")
    assert aud.audit(aud.failures(empty, "doc_id", "text", "lang"), labels).collect() == []
