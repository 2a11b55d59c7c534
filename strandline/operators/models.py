"""Classifiers on array features, trained with pyspark.ml, and their scores on every split."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import dot
from strandline.operators.metrics import adjusted_rand, classification_summary, ranking_summary
from strandline.operators.sequences import mean_pool
from strandline.operators.vectors import moments, silhouettes
from strandline.runtime import broadcast_if, cut


def ridge(train: DataFrame, rows: DataFrame, strength: float = 0.01) -> DataFrame:
    """Ridge regression on -1 and 1; the sign is the class, the sigmoid of the value its score."""
    fitted = LinearRegression(labelCol="_signed", weightCol="weight", regParam=strength, elasticNetParam=0.0).fit(train.withColumn("_signed", 2 * F.col("label") - 1))
    out = fitted.transform(rows).withColumnRenamed("prediction", "_value")
    return out.withColumn("prediction", (F.col("_value") > 0).cast("double")).withColumn("score", 1 / (1 + F.exp(-F.col("_value"))))


def calibrated_svm(train: DataFrame, rows: DataFrame, folds: int = 3, step: float = 0.001, reach: float = 8.0) -> DataFrame:
    """A linear SVM whose margins an isotonic regression turns into probabilities; it is fitted on out-of-fold margins.

    Folds go by a hash of the features, so equal rows share one. Margins are held to [-reach, reach] and combined
    per `step` first: at most 2 reach / step + 1 points meet in the regression, whatever the rows.
    """
    svm = LinearSVC(weightCol="weight", regParam=0.01, maxIter=15)
    margin = F.greatest(F.least(vector_to_array("rawPrediction")[1], F.lit(reach)), F.lit(-reach))
    spread, held = cut(train.withColumn("_fold", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(folds)))), None
    for i in range(folds):
        part = svm.fit(spread.where(F.col("_fold") != i)).transform(spread.where(F.col("_fold") == i)).select("label", "weight", margin.alias("_margin"))
        held = part if held is None else held.unionByName(part)
    points = held.groupBy((F.round(F.col("_margin") / step) * step).alias("_margin")).agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("label"), F.sum("weight").alias("weight"))
    curve = IsotonicRegression(featuresCol="_margin", weightCol="weight", predictionCol="score").fit(points)
    out = curve.transform(svm.fit(spread).transform(rows).drop("prediction").withColumn("_margin", margin))
    return out.withColumn("prediction", (F.col("score") > 0.5).cast("double"))


def fourier_axes(dims: int, n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of n random Fourier features whose products approach the Gaussian kernel exp(-|x - y|^2 / dims).

    On standardised features this is the kernel whose width goes by the number of features.
    """
    r = np.random.default_rng(seed)
    return r.normal(0, np.sqrt(2 / dims), (dims, n)), r.uniform(0, 2 * np.pi, n)


def gaussian_svm(train: DataFrame, rows: DataFrame, n: int = 256, seed: int = 42) -> DataFrame:
    """A linear SVM on n random Fourier features: a machine with a Gaussian kernel whose size does not grow with the rows.

    A kernel machine proper compares every row with every support vector; the features approach it, closer with larger n.
    """

    def lifted(df: DataFrame, dims: int) -> DataFrame:
        w, phase = fourier_axes(dims, n, seed)

        @F.pandas_udf("array<double>")
        def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                x = np.stack([np.asarray(a) for a in v]) if len(v) else np.zeros((0, dims))
                yield pd.Series(list(np.sqrt(2 / n) * np.cos(x @ w + phase)))

        return df.withColumn("features", array_to_vector(lift(vector_to_array("features"))))

    first = train.select("features").first()
    if first is None:
        raise ValueError("no rows to train on")
    dims = len(first["features"])
    return LinearSVC(weightCol="weight", regParam=0.001, maxIter=50).fit(cut(lifted(train, dims))).transform(lifted(rows, dims))


def suite(dims: int | None = None, seed: int = 42) -> dict:
    """Untrained models by name, or functions (train, rows) that add a prediction and a score. Settings are those that carry over to data of any size.

    The multilayer model is there only where the length of the vectors is given.
    """
    layered = {} if dims is None else {"multilayer": MultilayerPerceptronClassifier(layers=[dims, 100, 50, 2], maxIter=50, tol=1e-4, seed=seed)}
    return layered | {
        "ridge": ridge,
        "calibrated_svm": calibrated_svm,
        "gaussian_svm": gaussian_svm,
        "logistic_l2": LogisticRegression(weightCol="weight", regParam=0.01, elasticNetParam=0.0, maxIter=50),
        "logistic_l1": LogisticRegression(weightCol="weight", regParam=0.01, elasticNetParam=1.0, maxIter=50),
        "linear_svm": LinearSVC(weightCol="weight", regParam=0.01, maxIter=50),
        "random_forest": RandomForestClassifier(weightCol="weight", numTrees=200, maxDepth=6, seed=seed),
        "boosted_trees": GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, seed=seed),
    }


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight of each row so that both classes weigh the same; two counts, kept as a column expression."""
    n = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    total = sum(n.values())
    weight = F.lit(None).cast("double")
    for value, count in n.items():
        weight = F.when(F.col(label) == value, total / (len(n) * count)).otherwise(weight)
    return df.withColumn("weight", weight)


def fit_predict(df: DataFrame, vector: str, label: str, split: str, model, scale: bool = True) -> DataFrame:
    """Predictions of a model trained on the train split only, for all rows: (split, y_true, y_pred, y_score)."""
    rows = df.where(F.col(label).isin(0, 1) & F.col(vector).isNotNull()).withColumn("_x", array_to_vector(vector)).withColumn("label", F.col(label).cast("double"))
    train = balanced(rows.where(F.col(split) == "train"), "label")
    if scale:
        scaler = StandardScaler(withMean=True, inputCol="_x", outputCol="features").fit(train)
        train, rows = scaler.transform(train), scaler.transform(rows)
    else:
        train, rows = train.withColumnRenamed("_x", "features"), rows.withColumnRenamed("_x", "features")
    out = model(train, rows) if isinstance(model, Callable) else model.fit(train).transform(rows)
    score = F.col("score") if "score" in out.columns else vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    return out.select(F.col(split).alias("split"), F.col(label).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), score.alias("y_score"))


def settings(n: int, dims: int | None = None, seed: int = 42) -> dict[str, dict]:
    """Per model its settings by name: a grid of penalties where there is one, over n training rows, else the one of `suite`.

    Strengths C are those of losses that are summed up over rows; Spark's are means, so they become 1 / (C n).
    """
    grids = {name: {"default": model} for name, model in suite(dims, seed).items()}
    for name, mixing in (("logistic_l2", 0.0), ("logistic_l1", 1.0)):
        grids[name] = {f"C={c}": LogisticRegression(weightCol="weight", regParam=1 / (c * max(n, 1)), elasticNetParam=mixing, maxIter=50) for c in (0.01, 0.1, 1.0, 10.0)}
    grids["ridge"] = {f"alpha={a}": partial(ridge, strength=a / max(n, 1)) for a in (0.1, 1.0, 10.0)}
    return grids


def evaluate_suite(df: DataFrame, vector: str, label: str, split: str, dims: int | None = None, tune_on: str = "val_outside", models: dict[str, dict] | None = None) -> DataFrame:
    """Metrics of every model on every split, in one aggregation over all predictions, with the setting chosen and an error if there was one.

    Every setting is fitted on train; the one with the highest AUROC on `tune_on` is chosen (the first of equals, and the first where
    there is none), and scored on all splits. A model that fails gives one row with its error and no split, and the others go on.
    """
    data, every, notes = cut(df), None, []
    for name, grid in (models or settings(data.where(F.col(split) == "train").count(), dims)).items():
        try:
            fitted = {setting: fit_predict(data, vector, label, split, model) for setting, model in grid.items()}
            chosen = next(iter(fitted))
            if len(fitted) > 1:
                tried = None
                for setting, p in fitted.items():
                    held = p.where(F.col("split") == tune_on).withColumn("setting", F.lit(setting))
                    tried = held if tried is None else tried.unionByName(held)
                scores = {r["setting"]: r["auroc"] for r in ranking_summary(tried, ["setting"]).collect() if r["auroc"] is not None}  # a row a setting
                chosen = max(fitted, key=lambda x: scores.get(x, -1.0))
            p = cut(fitted[chosen].withColumn("model", F.lit(name)).withColumn("chosen", F.lit(chosen)))
            every = p if every is None else every.unionByName(p)
        except Exception as e:  # whatever a model's training raises is its result
            notes.append((name, f"{type(e).__name__}: {e}"[:200]))
    errors = df.sparkSession.createDataFrame(notes, "model string, error string")
    if every is None:
        return errors
    by = ["model", "chosen", "split"]
    return classification_summary(every, by).join(ranking_summary(every, by), by).withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def cross_validated(df: DataFrame, vector: str, label: str, fold: str, folds: int, models: dict) -> DataFrame:
    """(model, fold, auroc, auprc) of models trained on all other folds and scored on the fold that was held out."""
    data, every = cut(df), None
    for i in range(folds):
        parts = data.withColumn("_part", F.when(F.col(fold) == i, "held").otherwise("train"))
        for name, model in models.items():
            p = fit_predict(parts, vector, label, "_part", model).where("split = 'held'").select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "y_true", "y_score")
            every = p if every is None else every.unionByName(p)
    return ranking_summary(every, ["model", "fold"])


def nearest_centroid(df: DataFrame, key: str, vector: str, label: str, dims: int) -> DataFrame:
    """Class of the nearest mean vector of the train split for all rows; of equals the smaller class."""
    centres = {r[label]: r["pooled"] for r in mean_pool(df.where("split = 'train'"), [label], vector, dims).orderBy(label).collect()}  # one row a class
    distances = []
    for c, centre in centres.items():
        gap = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in centre]), lambda a, b: a - b)
        distances.append(F.struct(F.round(F.sqrt(dot(gap, gap)), 9).alias("d"), F.lit(c).alias("c")))
    return df.select(key, F.array_min(F.array(*distances))["c"].alias("y_pred"))


def best_cluster_count(df: DataFrame, key: str, vector: str, label: str, stated: Column, counts: range, seed: int = 42) -> DataFrame:
    """(k, silhouette, ari, best) of k-means with each number of clusters.

    silhouette is the mean over the stated rows, each against all rows; ari compares clusters with a label; best marks
    the first k with the highest silhouette.
    """
    points = cut(df.where(F.col(vector).isNotNull()).select(key, vector, label, stated.alias("_stated"), array_to_vector(vector).alias("features")))
    every = None
    for k in counts:
        rows = cut(KMeans(k=k, seed=seed, maxIter=20, predictionCol="_cluster").fit(points).transform(points).drop("features"))
        mean = silhouettes(rows.where("_stated"), rows, key, vector, "_cluster").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))
        one = mean.crossJoin(adjusted_rand(rows, "_cluster", label)).select(F.lit(k).alias("k"), "silhouette", "ari")  # one row each
        every = one if every is None else every.unionByName(one)
    every = cut(every)
    top = every.agg(F.max_by("k", F.struct("silhouette", -F.col("k")))).scalar()
    return every.withColumn("best", F.coalesce(F.col("k") == top, F.lit(False)))


class AttentionNet:
    """A layer of rectified units, tanh attention over the instances of a bag, and a linear score: a probability a bag.

    Weights are numpy arrays of fixed size. `forward` gives an instance's attention exponent and score; `backward` the
    gradient of the bags' cross entropy.
    """

    def __init__(self, dims: int, units: int = 16, attention: int = 8, seed: int = 42):
        r = np.random.default_rng(seed)
        self.w = {"w": r.normal(0, dims**-0.5, (dims, units)), "b": np.zeros(units), "v": r.normal(0, units**-0.5, (units, attention)), "a": r.normal(0, attention**-0.5, attention), "u": r.normal(0, units**-0.5, units), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(dims), np.ones(dims)

    def _layers(self, x: np.ndarray):
        z = (x - self.mean) / self.scale
        h = np.maximum(z @ self.w["w"] + self.w["b"], 0)
        t = np.tanh(h @ self.w["v"])
        return z, h, t, np.exp(t @ self.w["a"]), h @ self.w["u"] + self.w["c"][0]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._layers(x)[3:]

    def backward(self, x: np.ndarray, y: np.ndarray, total: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Flat gradient of the instances x, given their bags' label, summed exponents and score."""
        z, h, t, e, s = self._layers(x)
        ds = (1 / (1 + np.exp(-score)) - y) * e / total
        da = ds * (s - score)
        dt = da[:, None] * self.w["a"] * (1 - t**2)
        dh = (ds[:, None] * self.w["u"] + dt @ self.w["v"].T) * (h > 0)
        return np.concatenate([(z.T @ dh).ravel(), dh.sum(0), (h.T @ dt).ravel(), da @ t, ds @ h, [ds.sum()]])

    def step(self, gradient: np.ndarray, memory: dict, n: int, rate: float) -> None:
        """One update by Adam."""
        memory["m"] = 0.9 * memory.get("m", 0) + 0.1 * gradient
        memory["s"] = 0.999 * memory.get("s", 0) + 0.001 * gradient**2
        move, at = rate * (memory["m"] / (1 - 0.9**n)) / (np.sqrt(memory["s"] / (1 - 0.999**n)) + 1e-8), 0
        for name, old in self.w.items():
            self.w[name] = old - move[at : at + old.size].reshape(old.shape)
            at += old.size


def bag_scores(net: AttentionNet, df: DataFrame, bag: str, vector: str) -> DataFrame:
    """(bag, total, logit): a bag's summed attention exponents and its score. Tasks sum up their own part of every bag first."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                e, s = net.forward(np.stack([np.asarray(v) for v in pdf["v"]]))
                yield pd.DataFrame({"bag": pdf["bag"], "e": e, "es": e * s}).groupby("bag", as_index=False).sum()

    rows = df.where(F.col(bag).isNotNull() & F.col(vector).isNotNull()).select(F.col(bag).alias("bag"), F.col(vector).cast("array<double>").alias("v"))
    sums = rows.mapInPandas(part, f"bag {dict(df.dtypes)[bag]}, e double, es double")
    return sums.groupBy("bag").agg(F.sum("e").alias("total"), (F.sum("es") / F.sum("e")).alias("logit"))


def train_attention(df: DataFrame, bag: str, vector: str, label: str, dims: int, steps: int = 40, rate: float = 0.05, few: int = 100_000, seed: int = 42) -> AttentionNet:
    """An attention net trained on bags of instances (bag, vector, label of the bag), all bags in every step.

    A step is two passes over the instances. The first sums exponents and scores per bag, three numbers each. The
    second needs only those to form gradients, of which each task keeps one sum; the driver gets one number for each weight.
    So bags may be of any size and number. Rows with a null bag or vector, or a label other than 0 and 1, are left out.
    """
    good = df.where(F.col(bag).isNotNull() & F.col(vector).isNotNull() & F.col(label).isin(0, 1))
    rows = cut(good.select(F.col(bag).alias("bag"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y")))
    net, memory, bags = AttentionNet(dims, seed=seed), {}, rows.select("bag").distinct().count()
    if not bags:
        return net
    _, net.mean, cov = moments(rows, "v", dims)
    net.scale = np.maximum(np.sqrt(np.diag(cov)), 1e-6)

    def gradient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            if len(pdf):
                g = net.backward(np.stack([np.asarray(v) for v in pdf["v"]]), *(pdf[c].to_numpy() for c in ("y", "total", "logit")))
                kept = g if kept is None else kept + g
        if kept is not None:
            yield pd.DataFrame({"i": np.arange(len(kept)), "g": kept})

    for n in range(1, steps + 1):
        known = rows.join(broadcast_if(bag_scores(net, rows, "bag", "v"), bags, few), "bag").select("v", "y", "total", "logit")
        sums = known.mapInPandas(gradient, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()  # one row a weight
        net.step(sums.sort_values("i")["g"].to_numpy() / bags, memory, n, rate)
    return net


def attention_pool(df: DataFrame, by: list[str], logit: str, value: str) -> DataFrame:
    """Softmax-weighted mean of a value per bag; exponents are shifted by the bag's largest, so none overflows."""
    top = df.groupBy(*by).agg(F.max(logit).alias("_top"))
    e = F.exp(F.col(logit) - F.col("_top"))
    return df.join(top, by).groupBy(*by).agg(F.round(F.sum(e * F.col(value)) / F.sum(e), 6).alias("pooled"))
