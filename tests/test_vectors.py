import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import models
from strandline.operators import vectors as vec


def table(spark, x, extra=None):
    return spark.createDataFrame([(i, row.tolist(), int(i % 2)) for i, row in enumerate(x)], "id long, v array<double>, y int").repartition(3)


def test_moments_match_numpy(spark):
    x = np.random.default_rng(0).normal(5, 2, (200, 6))
    n, mean, cov = vec.moments(table(spark, x).unionByName(spark.createDataFrame([(999, None, 0)], "id long, v array<double>, y int")), "v", 6)
    assert n == 200
    np.testing.assert_allclose(mean, x.mean(0))
    np.testing.assert_allclose(cov, np.cov(x.T))


def test_projection_is_centred(spark):
    x = np.random.default_rng(1).normal(0, 1, (100, 5)) * [5, 3, 1, 1, 1]
    df = table(spark, x)
    mean, axes, share = vec.principal_axes(df, "v", 5, 2)
    got = np.array([r["projected"] for r in vec.projected(df, "v", mean, axes).orderBy("id").collect()])
    np.testing.assert_allclose(got, (x - x.mean(0)) @ axes.T, atol=1e-9)
    assert share.sum() == pytest.approx(1) and share[0] > share[1]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_matches_brute_force(spark, metric):
    x = np.round(np.random.default_rng(2).normal(0, 1, (90, 4)), 1)
    x[7] = x[3]  # a tie
    df = table(spark, x)
    got = {(r["query"], r["rank"]): r["neighbour"] for r in vec.nearest(df.where("id % 10 = 0"), df, "id", "v", 5, metric, block=4).collect()}
    for q in range(0, 90, 10):
        s = np.round(x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])) if metric == "cosine" else -np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        order = [i for i in np.lexsort((np.arange(90), -s)) if i != q][:5]
        assert [got[q, r + 1] for r in range(5)] == order
    assert vec.nearest(df.limit(0), df, "id", "v", 5).count() == 0
    other = vec.nearest(df.where("id % 10 = 0"), df, "id", "v", 5, metric, block=4, apart="y").collect()
    assert len(other) == 45 and all((r["query"] - r["neighbour"]) % 2 for r in other)  # y is the parity of the id


def test_kernel_shares_match_a_plain_loop():
    x = np.sin(np.arange(30.0))
    kernels = vec._kernels()
    assert kernels.shape == (84, 9) and (kernels.sum(1) == 0).all()
    got = vec.convolved(x, 2, kernels)
    for k in (0, 17, 83):
        plain = [sum(kernels[k][j] * (x[i + 2 * (j - 4)] if 0 <= i + 2 * (j - 4) < 30 else 0) for j in range(9)) for i in range(30)]
        np.testing.assert_allclose(got[k], plain)


def test_kernel_features_tell_classes_apart(spark):
    rows = [(k, t, float(np.sin(t * (0.3 if k % 2 else 1.5)))) for k in range(8) for t in range(40)]
    df = spark.createDataFrame(rows, "k long, t long, x double")
    got = {r["k"]: np.array(r["features"]) for r in vec.kernel_features(df, ["k"], "x", 40).collect()}
    assert np.linalg.norm(got[0] - got[2]) < np.linalg.norm(got[0] - got[1])


def test_spectrum(spark):
    x = np.random.default_rng(3).normal(0, 1, (60, 4))
    got = vec.spectrum_stats(table(spark, x).withColumn("g", F.lit("a")), "g", "v").first()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    assert got["effective_rank"] == pytest.approx(np.exp(-(p * np.log(p)).sum()), rel=1e-6)
    assert got["participation_ratio"] == pytest.approx(s.sum() ** 2 / (s**2).sum(), rel=1e-6)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(4)
    rows = [((rng.normal(0, 1, 3) + (2 if i % 2 else -2)).tolist(), int(i % 2), "train" if i % 3 else "val_outside") for i in range(150)]
    df = spark.createDataFrame(rows, "v array<double>, y int, split string")
    p = models.fit_predict(df, "v", "y", "split", models.suite()["logistic_l2"]).where("split <> 'train'")
    assert p.where("y_true = y_pred").count() / p.count() > 0.95


def test_standardised_vectors(spark):
    x = np.random.default_rng(6).normal(3, 4, (80, 3))
    x[:, 2] = 1.0
    df = table(spark, x).unionByName(spark.createDataFrame([(999, None, 0)], "id long, v array<double>, y int"))
    got = {r["id"]: r["v"] for r in vec.standardised(df, "v", 3).collect()}
    assert got.pop(999) is None
    z = np.array([got[i] for i in range(80)])
    np.testing.assert_allclose(z[:, :2], (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0, ddof=1), atol=1e-9)
    assert (z[:, 2] == 0).all()
