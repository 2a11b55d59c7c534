import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import models
from strandline.operators import vectors as vec


@pytest.fixture(scope="module")
def separable(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 300)
    x = r.normal(0, 1, (300, 4)) + y[:, None] * 2.5
    rows = [(i, x[i].tolist(), int(y[i]), "train" if i % 3 else "test") for i in range(300)] + [(900, None, 1, "train"), (901, x[0].tolist(), None, "train")]
    return spark.createDataFrame(rows, "id long, v array<double>, y int, split string").repartition(3)


@pytest.mark.parametrize("name", ["ridge", "calibrated_svm", "multilayer"])
def test_held_out_accuracy(separable, name):
    p = models.fit_predict(separable, "v", "y", "split", models.suite(4)[name]).where("split = 'test'").toPandas()
    assert len(p) == 100 and (p["y_true"] == p["y_pred"]).mean() > 0.93
    assert p["y_score"].between(0, 1).all() and p.loc[p["y_true"] == 1, "y_score"].mean() > p.loc[p["y_true"] == 0, "y_score"].mean() + 0.3


def test_cross_validation_scores_every_fold(separable):
    df = separable.where("v is not null and y is not null").withColumn("fold", F.col("id") % 2)
    got = models.cross_validated(df, "v", "y", "fold", 2, {"ridge": models.ridge}).collect()
    assert sorted(r["fold"] for r in got) == [0, 1] and all(r["auroc"] > 0.95 for r in got)


def bags(spark, n=160, seed=5):
    """Five instances a bag; a positive bag has one or two that lie elsewhere."""
    r, rows = np.random.default_rng(seed), []
    for b in range(n):
        y = b % 2
        x = r.normal(0, 1, (5, 3))
        x[: y * r.integers(1, 3)] += [4, -4, 0]
        rows += [(b, v.tolist(), y) for v in x]
    return spark.createDataFrame(rows, "bag long, v array<double>, y int").repartition(3)


def test_attention_is_accurate_on_held_out_bags(spark):
    df = bags(spark)
    extra = spark.createDataFrame([(None, [9.0, 9.0, 9.0], 1), (0, None, 0), (3, [0.0, 0.0, 0.0], None)], "bag long, v array<double>, y int")
    net = models.train_attention(df.where("bag < 120").unionByName(extra), "bag", "v", "y", 3, steps=30)
    p = models.bag_scores(net, df.where("bag >= 120"), "bag", "v").toPandas()
    assert len(p) == 40 and ((p["logit"] > 0) == (p["bag"] % 2 == 1)).mean() >= 0.9
    assert len(models.bag_scores(models.train_attention(df.limit(0), "bag", "v", "y", 3), df.limit(0), "bag", "v").collect()) == 0


def test_attention_gradient_matches_differences():
    r = np.random.default_rng(0)
    x, bag, y = r.normal(0, 1, (12, 3)), np.repeat([0, 1, 2], 4), np.repeat([0.0, 1.0, 1.0], 4)
    net = models.AttentionNet(3, 5, 4, 1)

    def of_bags():
        e, s = net.forward(x)
        total = np.bincount(bag, e)
        return total, np.bincount(bag, e * s) / total

    def loss():
        z, t = of_bags()[1], y[::4]
        return float((np.logaddexp(0, z) - t * z).sum())

    total, score = of_bags()
    flat, at = net.backward(x, y, total[bag], score[bag]), 0
    for name, w in net.w.items():
        numeric = np.zeros(w.size)
        for i in range(w.size):
            old = w.flat[i]
            w.flat[i] = old + 1e-6
            up = loss()
            w.flat[i] = old - 1e-6
            numeric[i] = (up - loss()) / 2e-6
            w.flat[i] = old
        np.testing.assert_allclose(flat[at : at + w.size], numeric, atol=1e-5, err_msg=name)
        at += w.size


def plain_silhouette(x, c, q):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    if (c == c[q]).sum() == 1 or len(set(c)) == 1:
        return 0.0
    a = d[c == c[q]].sum() / ((c == c[q]).sum() - 1)
    b = min(d[c == k].mean() for k in set(c) if k != c[q])
    return (b - a) / max(a, b)


def test_silhouettes_match_brute_force(spark):
    r = np.random.default_rng(1)
    x, c = r.normal(0, 1, (200, 3)), r.integers(0, 3, 200)
    c[10] = 7  # alone in its cluster
    df = spark.createDataFrame([(i, x[i].tolist(), int(c[i])) for i in range(200)] + [(500, None, 1), (510, x[0].tolist(), None)], "id long, v array<double>, c int").repartition(3)
    got = {r["query"]: r["silhouette"] for r in vec.silhouettes(df.where("id % 10 = 0"), df, "id", "v", "c", block=6).collect()}
    assert got == pytest.approx({q: plain_silhouette(x, c, q) for q in range(0, 200, 10)})
    assert [r["silhouette"] for r in vec.silhouettes(df.where("id = 0"), df.where("c = 0").unionByName(df.where("id = 0")), "id", "v", "c").collect()] == [0.0]
    assert vec.silhouettes(df.limit(0), df, "id", "v", "c").count() == 0


def test_best_cluster_count(spark):
    r = np.random.default_rng(2)
    rows = [(i, (r.normal(0, 0.2, 2) + [(0, 0), (6, 0), (0, 6)][i % 3]).tolist(), i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    got = {r["k"]: r for r in models.best_cluster_count(df, "id", "v", "label", F.col("id") % 10 == 0, range(2, 5)).collect()}
    assert [k for k, r in got.items() if r["best"]] == [3] and got[3]["ari"] == 1.0


@pytest.mark.parametrize("channels", [1, 3])
def test_series_features_are_those_of_the_whole_series(spark, monkeypatch, channels):
    r = np.random.default_rng(4)
    lengths = {1: 700, 2: 64, 3: 65, 4: 3, 5: 130}
    series = {k: r.normal(0, 1, (channels, n)).round(2) for k, n in lengths.items()}
    df = spark.createDataFrame([(k, t, v.tolist()) for k, x in series.items() for t, v in enumerate(x.T)], "k long, t long, x array<double>").repartition(5)
    used, fitted = {}, vec.bias_quantiles

    def kept(outputs, first, quantiles):  # biases no sum comes near, so that sums in another order tip no tie
        used[first // 84] = fitted(outputs, first, quantiles).round(1) + 0.003217
        return used[first // 84]

    monkeypatch.setattr(vec, "bias_quantiles", kept)
    got = {row["k"]: np.array(row["features"]) for row in vec.series_features(df, ["k"], "x", block=64, most=4, sample=4, channels=channels).collect()}
    steps = vec.dilations(700, 4)
    assert set(got) == set(lengths) and steps == [1, 4, 19, 87]
    weights = vec.channel_weights(steps, channels)
    for k, x in series.items():
        np.testing.assert_allclose(got[k], vec.positive_shares(x, {d: used[i] for i, d in enumerate(steps)}, weights), atol=1e-9, err_msg=str(k))
    assert vec.series_features(df.limit(0), ["k"], "x", channels=channels).count() == 0
    holed = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, None, 4.0), (None, -3, 2.0)], "k long, t long, x double")
    assert {len(x["features"]) for x in vec.series_features(holed, ["k"], "x", block=64).collect()} == {84 * 4}


def test_gaussian_machine_learns_a_ring(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (600, 2))
    y = ((x**2).sum(1) > 1.4).astype(int)  # no line parts these
    df = spark.createDataFrame([(x[i].tolist(), int(y[i]), "train" if i % 3 else "test") for i in range(600)], "v array<double>, y int, split string")
    p = models.fit_predict(df, "v", "y", "split", models.gaussian_svm).where("split = 'test'").toPandas()
    assert len(p) == 200 and (p["y_true"] == p["y_pred"]).mean() > 0.9


def test_fourier_features_approach_the_kernel():
    w, phase = models.fourier_axes(3, 20000, 1)
    a, b = np.array([0.3, -1.0, 0.5]), np.array([-0.2, 0.4, 0.1])
    fa, fb = (np.sqrt(2 / 20000) * np.cos(x @ w + phase) for x in (a, b))
    assert abs(fa @ fb - np.exp(-((a - b) ** 2).sum() / 3)) < 0.03


def test_a_failing_model_is_recorded_and_settings_are_tuned(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (240, 3))
    y = (x[:, 0] + 0.3 * rng.normal(0, 1, 240) > 0).astype(int)
    split = np.where(np.arange(240) % 4 == 0, "val_outside", "train")
    df = spark.createDataFrame([(v.tolist(), int(k), s) for v, k, s in zip(x, y, split)], "v array<double>, y int, split string")

    def broken(train, rows):
        raise ValueError("no such model")

    grid = {"ridge": {"a": models.ridge, "b": lambda t, r: models.ridge(t, r, 1e6)}, "broken": {"default": broken}}
    got = {(r["model"], r["split"]): r for r in models.evaluate_suite(df, "v", "y", "split", models=grid).collect()}
    assert set(got) == {("ridge", "train"), ("ridge", "val_outside"), ("broken", None)}
    assert got["broken", None]["error"] == "ValueError: no such model" and got["ridge", "train"]["error"] is None
    assert got["ridge", "val_outside"]["auroc"] > 0.9 and got["ridge", "train"]["chosen"] in ("a", "b")
    assert set(models.settings(100)["logistic_l1"]) == {"C=0.01", "C=0.1", "C=1.0", "C=10.0"}
