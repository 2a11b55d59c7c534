"""Exact metrics of binary predictions, grouped, in plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import value_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    return [F.count_if((F.col(y) == a) & (F.col(p) == b)).alias(n) for n, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0))]


def _rates() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    specificity = _ratio(tn, tn + fp)
    balanced = F.when(tp + fn == 0, specificity).when(tn + fp == 0, recall).otherwise((recall + specificity) / 2)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall, "specificity": specificity,
        "f1": _ratio(2 * precision * recall, precision + recall), "balanced_accuracy": balanced,
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def classification_summary(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Counts and rates per group; a rate with a zero denominator is 0. Other labels than 0 and 1 count nowhere."""
    return df.groupBy(*by).agg(*confusion()).select(*by, "tp", "tn", "fp", "fn", *[F.round(c, digits).alias(n) for n, c in _rates().items()])


def score_steps(df: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative true and false positives at each distinct score, descending: the points of ROC and PR curves.

    Scores are added up by `value_totals`, so neither rows nor distinct scores of a group meet in one task. Rows of other labels
    than 0 and 1 and without a score are left out.
    """
    s = value_totals(df.where("y_true in (0, 1) and y_score is not null"), by, "y_score", {"p": F.sum("y_true"), "n": F.sum(1 - F.col("y_true"))})
    down = lambda c: F.col(f"{c}_total") - F.col(f"{c}_before")
    return s.select(*by, "y_score", "p", "n", down("p").alias("tp"), down("n").alias("fp"), F.col("p_total").alias("pos"), F.col("n_total").alias("neg"))


def ranking_summary(df: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """AUROC (ties count half) and average precision (steps, not trapezoids) per group; null where a class is missing."""
    s = score_steps(df, by)
    pairs = F.sum(F.col("n") * (F.col("tp") - F.col("p")) + 0.5 * F.col("n") * F.col("p"))
    auroc = F.try_divide(pairs.cast("double"), (F.max("pos") * F.max("neg")).cast("double"))
    ap = F.try_divide(F.sum(F.col("p") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))), F.max("pos").cast("double"))
    missing = (F.max("pos") == 0) | (F.max("neg") == 0)
    return s.groupBy(*by).agg(F.when(~missing, F.round(auroc, digits)).alias("auroc"), F.when(~missing, F.round(ap, digits)).alias("auprc"))


def best_threshold(df: DataFrame, by: list[str], steps: int = 100) -> DataFrame:
    """The threshold of `steps` evenly spaced ones in [0, 1] with the best MCC, the lowest of equals; scores at it are positive.

    Every score is put into the slot of the last threshold it reaches, so rows are read once and not once a threshold.
    """
    slot = F.greatest(F.least(F.floor(F.col("y_score") * (steps - 1) + 1e-12), F.lit(steps - 1)), F.lit(-1)).cast("int")
    slots = df.groupBy(*by, slot.alias("slot")).agg(F.sum("y_true").alias("p"), F.sum(1 - F.col("y_true")).alias("n"))
    every = slots.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    below = slots.select(*by).distinct().withColumn("slot", F.lit(-1))
    full = every.unionByName(below).join(slots, [*by, "slot"], "left").fillna(0, ["p", "n"])
    up = Window.partitionBy(*by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    counts = full.withColumn("tp", F.sum("p").over(up)).withColumn("fp", F.sum("n").over(up)).withColumn("fn", F.sum("p").over(whole) - F.col("tp")).withColumn("tn", F.sum("n").over(whole) - F.col("fp"))
    scored = counts.where("slot >= 0").withColumn("mcc", F.round(_rates()["mcc"], 9))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mcc"), "slot"))
    return scored.withColumn("_r", best).where("_r = 1").select(*by, F.round(F.col("slot") / F.lit(float(steps - 1)), 6).alias("threshold"), F.round("mcc", 6).alias("mcc"))


def long_results(summary: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row for each group and metric."""
    return summary.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", "value")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table; 1 where it is undefined."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    two = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias("n")).agg(two("n")).scalar() for c in (a, b))
    total = cells.agg(F.sum("n").cast("double").alias("n"), two("n").alias("both")).withColumn("x", rows).withColumn("y", cols)
    expected = F.col("x") * F.col("y") / (F.col("n") * (F.col("n") - 1) / 2)
    return total.select(F.round(F.coalesce(F.try_divide(F.col("both") - expected, (F.col("x") + F.col("y")) / 2 - expected), F.lit(1.0)), 6).alias("ari"))
