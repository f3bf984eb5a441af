"""Rank metrics, matching and splits against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import diagnostics as DG
from trialframe.operators import features as FE
from trialframe.operators import matching as MT
from trialframe.operators.relational import BUCKET_ROWS, pivot_codes, range_buckets


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    s = 0.0
    for a in pos:
        s += (neg < a).sum() + 0.5 * (neg == a).sum()
    return s / (len(pos) * len(neg))


def brute_ap(p, y):
    order = np.argsort(-p, kind="stable")
    thr = np.unique(p)[::-1]
    P = y.sum()
    ap, prev_r = 0.0, 0.0
    for t in thr:
        sel = p >= t
        tp = (y[sel] == 1).sum()
        prec = tp / sel.sum()
        r = tp / P
        ap += (r - prev_r) * prec
        prev_r = r
    return ap


@pytest.mark.parametrize("n_buckets", [1, 3, 16])
def test_auc_and_ap_match_brute_force(spark, n_buckets):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 2)          # many ties
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    r = DG.binary_scores(df, "p", "y", n_buckets=n_buckets).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(p, y))
    assert r["pr_auc"] == pytest.approx(brute_ap(p, y))
    assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 300


@pytest.mark.parametrize("n_buckets", [1, 2, 7, 64])
def test_matching_matches_brute_force(spark, n_buckets):
    rng = np.random.default_rng(1)
    n = 400
    e = np.round(rng.random(n), 3)
    a = (rng.random(n) < e).astype(int)
    y = rng.random(n)
    pdf = pd.DataFrame({"e": e, "a": a, "y": y})
    got = MT.psm_ate(spark.createDataFrame(pdf), "e", n_buckets=n_buckets).first()["ATE"]
    # brute force over distinct scores: nearest opposite score, ties -> lower score
    g = pdf.groupby(["a", "e"]).agg(n=("y", "size"), sy=("y", "sum")).reset_index()
    total = 0.0
    for arm in (0, 1):
        opp = g[g.a == 1 - arm]
        for _, row in g[g.a == arm].iterrows():
            d = (opp.e - row.e).abs()
            cand = opp[d == d.min()].sort_values("e").iloc[0]
            my = cand.sy / cand.n
            total += (row.sy - row.n * my) if arm == 1 else (row.n * my - row.sy)
    assert got == pytest.approx(total / n)


def test_hash_ranks_exact_and_split_proportions(spark):
    df = spark.range(5000).withColumnRenamed("id", "uid").withColumn("s", (F.col("uid") % 3).cast("int"))
    r = FE.hash_ranks(df, "uid", ["s"], seed=3, bucket_bits=4).toPandas()
    for s, g in r.groupby("s"):
        assert sorted(g["_rank"]) == list(range(len(g)))
    sp = FE.stratified_split(df, "uid", ["s"], 0.3, seed=3).groupBy("s", "split").count().toPandas()
    for s, g in sp.groupby("s"):
        n = g["count"].sum()
        assert int(g[g.split == "test"]["count"].iloc[0]) == round(0.3 * n)
    folds = FE.assign_folds(df, "uid", ["s"], 5, seed=1).groupBy("s", "fold").count().toPandas()
    for s, g in folds.groupby("s"):
        assert g["count"].max() - g["count"].min() <= 1


def test_check_binary_treatment(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "a int")
    with pytest.raises(ValueError):
        FE.check_binary_treatment(df)


def test_p_values_textbook():
    from trialframe.functions.stats import chi2_sf, t_two_sided_p
    assert t_two_sided_p(2.0, 10) == pytest.approx(0.07339, abs=1e-5)
    assert t_two_sided_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(0.5, 3) == pytest.approx(0.91889, abs=1e-5)


def test_baseline_tests_and_p_values(spark):
    from trialframe.operators import reports as RP
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"arm": np.r_[np.zeros(200), np.ones(200)].astype(int),
                        "x": np.r_[rng.normal(0, 1, 200), rng.normal(0.5, 2, 200)],
                        "c": rng.choice(["a", "b", "c"], 400)})
    pdf.loc[(pdf.arm == 1) & (pdf.c == "c"), "c"] = "b"          # a level seen in one arm only
    out = RP.with_p_values(RP.baseline_tests(spark.createDataFrame(pdf), "arm", ["x"], ["c"])).toPandas()
    x1, x0 = pdf.x[pdf.arm == 1], pdf.x[pdf.arm == 0]
    s1, s0 = x1.var() / len(x1), x0.var() / len(x0)
    t = (x1.mean() - x0.mean()) / np.sqrt(s1 + s0)
    row = out[out.variable == "x"].iloc[0]
    assert row.statistic == pytest.approx(t)
    tab = pd.crosstab(pdf.c, pdf.arm).to_numpy().astype(float)
    exp = tab.sum(1, keepdims=True) * tab.sum(0, keepdims=True) / tab.sum()
    chi = ((tab - exp) ** 2 / exp).sum()
    crow = out[out.variable == "c"].iloc[0]
    assert crow.statistic == pytest.approx(chi) and crow.dof == 2
    assert 0 <= crow.p_value <= 1 and 0 <= row.p_value <= 1


def test_grouped_scores_match_each_group(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 600), "seed": rng.integers(0, 2, 600), "p": np.round(rng.random(600), 2)})
    pdf["y"] = (rng.random(600) < pdf.p).astype(int)
    pdf.loc[(pdf.g == "b") & (pdf.seed == 1), "y"] = 1            # a group without negatives
    df = spark.createDataFrame(pdf)
    for n in (1, 5):
        got = DG.binary_scores(df, "p", "y", n_buckets=n, by=["g", "seed"]).toPandas()
        assert len(got) == 6
        for r in got.itertuples():
            part = pdf[(pdf.g.isna() if r.g is None or r.g != r.g else pdf.g == r.g) & (pdf.seed == r.seed)]
            assert r.n_samples == len(part) and r.brier == pytest.approx(((part.p - part.y) ** 2).mean())
            if r.g == "b" and r.seed == 1:
                assert np.isnan(r.roc_auc) and np.isnan(r.pr_auc)
            else:
                assert r.roc_auc == pytest.approx(brute_auc(part.p.to_numpy(), part.y.to_numpy()))
                assert r.pr_auc == pytest.approx(brute_ap(part.p.to_numpy(), part.y.to_numpy()))


def test_scores_of_no_units(spark):
    r = DG.binary_scores(spark.createDataFrame([], "p double, y int")).first()
    assert r["roc_auc"] is None and r["prevalence"] is None
    assert DG.binary_scores(spark.createDataFrame([], "g string, p double, y int"), by=["g"]).count() == 0


def test_two_million_scores_stay_in_bounded_buckets(spark):
    """Half the distinct scores lie in a millionth of the range."""
    n = 2_000_000
    s = F.when(F.col("id") % 2 == 0, F.col("id") / (1e6 * n)).otherwise(F.col("id") / n)
    d = spark.range(n).select(s.alias("score"))
    sizes = range_buckets(d, ["score"]).groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("_bucket").toPandas()
    assert sizes.n.sum() == n and len(sizes) > 90 and sizes.n.max() < 4 * BUCKET_ROWS
    assert (sizes.lo[1:].to_numpy() > sizes.hi[:-1].to_numpy()).all()


def test_medians_of_groups_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"u": rng.choice([1, 2, 3], 900, p=[0.8, 0.1, 0.1]), "code": rng.choice(list("xyz"), 900),
                        "value": np.round(rng.normal(size=900), 1), "t": np.arange(900)})
    df = spark.createDataFrame(pdf).withColumn("u", F.when(F.col("u") != 3, F.col("u")))   # null units form a group
    df = df.unionByName(spark.createDataFrame([(9, "x", None, 1000)], df.schema))         # a unit without values
    got = pivot_codes(df, ["u"], ["x", "y"], ["median", "max"]).toPandas()
    typed = FE.typed_aggregation(df, "u", {"median": ["x", "y"], "max": ["z"]}, order=["t"]).toPandas()
    assert len(got) == len(typed) == 4
    for k, g in pdf.groupby("u"):
        row, other = (f[f.u.isna() if k == 3 else f.u == k].iloc[0] for f in (got, typed))
        for c in "xy":
            want = g[g.code == c].value
            assert row[f"median_code_{c}"] == pytest.approx(want.median()) == pytest.approx(other[c])
            assert row[f"max_code_{c}"] == want.max()
    assert np.isnan(got[got.u == 9].iloc[0]["median_code_x"])
