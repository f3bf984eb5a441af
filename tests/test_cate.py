"""Effect models on unseen units against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.operators import cate as CT
from trialframe.operators import effects as K
from trialframe.operators import nuisance as NU
from trialframe.operators import stacked


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(4)
    n = 400
    x1, x2 = rng.integers(0, 2, n).astype(float), rng.normal(size=n)
    s = rng.integers(0, 4, n)
    a = (rng.random(n) < 0.3 + 0.1 * s).astype(int)
    y = 0.5 * x2 + a * (1 + x1 - 0.5 * x2) + rng.normal(size=n)
    return pd.DataFrame({"unit_id": np.arange(n), "x1": x1, "x2": x2, "s": s, "a": a, "y": y, "fold": np.arange(n) % 3})


def plain(z, t, penalty=0.0):
    g = np.linalg.inv(z.T @ z + penalty * np.diag([0] + [1] * (z.shape[1] - 1)))
    b = g @ z.T @ t
    r = t - z @ b
    return b, g @ (z.T * r ** 2) @ z @ g


@pytest.mark.parametrize("penalty", [0.0, 25.0])
def test_final_model_on_unseen_units(spark, pdf, penalty):
    ar, yr = pdf.a - 0.4, pdf.y - pdf.y.mean()
    df = spark.createDataFrame(pdf.assign(_ar=ar, _yr=yr)).withColumn("x2", F.when(F.col("unit_id") != 7, F.col("x2")))
    train = np.array((pdf.unit_id < 300) & (pdf.unit_id != 7))
    m = CT.fit_r_final(df.filter("unit_id < 300"), ["x1", "x2"], penalty=penalty)
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    b, cov = plain((x * np.array(ar)[:, None])[train], np.array(yr)[train], penalty)
    assert m.coefs == pytest.approx(b) and m.cov == pytest.approx(cov)
    got = m.apply(df.filter("unit_id >= 300"), 0.1).orderBy("unit_id").toPandas()
    xt = x[300:]
    half = 1.6448536269514722 * np.sqrt(np.einsum("ij,jk,ik->i", xt, cov, xt))
    assert got["cate"].to_numpy() == pytest.approx(xt @ b)
    assert got["cate_ub"].to_numpy() == pytest.approx(xt @ b + half)
    assert m.apply(df.filter("unit_id = 7")).first()["cate"] is None


def test_repeated_covariate_and_no_units(spark, pdf):
    df = spark.createDataFrame(pdf.assign(x3=pdf.x2, psi=pdf.y))
    one = CT.fit_dr_final(df, F.col("psi"), ["x2"])
    two = CT.fit_dr_final(df, F.col("psi"), ["x2", "x3"])
    assert two.coefs[1] + two.coefs[2] == pytest.approx(one.coefs[1])
    with pytest.raises(ValueError):
        CT.fit_dr_final(df.limit(0), F.col("psi"), ["x2"])


def test_dr_final_replicates_match_a_loop(spark, pdf):
    df = spark.createDataFrame(pdf)
    got = CT.dr_final_cells(df, ["s"], ["x1", "x2"], "unit_id", "fold", n_boot=6, seed=2)
    w = stacked.replicates(df.select(F.col("unit_id").alias("id")), 6, 2).toPandas()
    for b in range(7):
        ws = w[w.b == b].set_index("id").w.reindex(pdf.unit_id).fillna(0).to_numpy()
        psi = np.zeros(len(pdf))
        for k in range(3):
            tr, te = (pdf.fold != k).to_numpy(), (pdf.fold == k).to_numpy()
            for s in range(4):
                c = te & (pdf.s == s).to_numpy()
                o = tr & (pdf.s == s).to_numpy()
                av, yv = pdf.a.to_numpy(), pdf.y.to_numpy()
                e = np.clip((ws * av)[o].sum() / ws[o].sum(), *K.CLIP)
                m1 = (ws * av * yv)[o].sum() / (ws * av)[o].sum()
                m0 = (ws * (1 - av) * yv)[o].sum() / (ws * (1 - av))[o].sum()
                psi[c] = (m1 - m0 + av * (yv - m1) / e - (1 - av) * (yv - m0) / (1 - e))[c]
        z = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
        beta = np.linalg.solve((z.T * ws) @ z, (z.T * ws) @ psi)
        assert (got.coefs if b == 0 else got.replicates[b - 1]) == pytest.approx(beta)
    t = got.table(spark).toPandas().set_index("term")
    assert t.loc["x1", "lower"] == pytest.approx(np.quantile(got.replicates[:, 1], 0.025))
    row = got.apply(df.filter("unit_id = 3"), 0.2).first()
    effects = got.replicates @ np.array([1, row["x1"], row["x2"]])
    assert [row["cate_lb"], row["cate_ub"]] == pytest.approx(np.quantile(effects, [0.1, 0.9]))


def test_average_of_cell_models(spark, pdf):
    df = spark.createDataFrame(pdf)
    new = spark.createDataFrame([(1, 2), (2, 99), (3, None)], "unit_id long, s long")
    rows = CT.average_cell_models(new, CT.fold_cell_models(df, ["s"], 3), ["s"]).orderBy("unit_id").collect()
    others = [pdf[pdf.fold != k] for k in range(3)]
    assert rows[0]["m1"] == pytest.approx(np.mean([o[(o.s == 2) & (o.a == 1)].y.mean() for o in others]))
    assert rows[1]["e"] == pytest.approx(np.mean([o.a.mean() for o in others])) == pytest.approx(rows[2]["e"])


def test_average_of_fitted_models(spark, pdf):
    df = NU.assemble(spark.createDataFrame(pdf), ["x1", "x2"])
    ens = CT.fit_folds(df, "fold", 3, "linear", "regressor", "y", {"alpha": 1e-6})
    got = ens.predict(df.limit(20), "p").select("unit_id", "p").toPandas().set_index("unit_id").p
    x = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    want = np.mean([x @ np.linalg.lstsq(x[(pdf.fold != k)], pdf.y[pdf.fold != k], rcond=None)[0] for k in range(3)], axis=0)
    assert got.to_numpy() == pytest.approx(want[got.index], abs=1e-4)


def test_forest_final_on_unseen_units(spark, pdf):
    df = spark.createDataFrame(pdf.assign(_ar=pdf.a - 0.45, _yr=pdf.y - 0.5 * pdf.x2 - 0.45 * (1 + pdf.x1 - 0.5 * pdf.x2)))
    forest = CT.fit_r_forest(df.filter("unit_id < 300"), ["x1", "x2"], "unit_id", n_groups=3, n_trees=10)
    test = df.filter("unit_id >= 300").withColumn("x2", F.when(F.col("unit_id") != 300, F.col("x2")))
    got = forest.apply(test).toPandas().set_index("unit_id")
    assert len(got) == 100 and np.isnan(got.loc[300, "cate"])
    rest = got.drop(300)
    assert (rest.cate_lb <= rest.cate).all() and (rest.cate <= rest.cate_ub).all()
    assert rest[rest.x1 == 1].cate.mean() > rest[rest.x1 == 0].cate.mean()
