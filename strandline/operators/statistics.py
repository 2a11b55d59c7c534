"""Distribution audits and tail statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import value_summary


# Coefficients of a published Chebyshev fit of erfc, good to 1.2e-7 of its value.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def complementary_error(z: Column) -> Column:
    """erfc of values from 0 on."""
    t = 1 / (1 + z / 2)
    fit = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        fit = F.lit(c) + t * fit
    return t * F.exp(-z * z + fit)


def chi_square_yates(df: DataFrame, group: str, label: str) -> DataFrame:
    """Yates-corrected chi-square of a 2 x 2 table, its p-value and whether that is below 0.05: a boolean group against labels 0 and 1; null if a margin is empty."""
    c = {f"{g}{y}": F.count_if((F.col(group) == bool(g)) & (F.col(label) == y)).cast("double") for g in (0, 1) for y in (0, 1)}
    t = df.agg(*[v.alias(f"n{k}") for k, v in c.items()])
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    cells = []
    for g in (0, 1):
        for y in (0, 1):
            e = F.try_divide((F.col(f"n{g}0") + F.col(f"n{g}1")) * (F.col(f"n0{y}") + F.col(f"n1{y}")), n)
            d = F.greatest(F.abs(F.col(f"n{g}{y}") - e) - 0.5, F.lit(0.0))
            cells.append(F.try_divide(d * d, e))
    p = complementary_error(F.sqrt(F.col("_x") / 2))
    both = t.select((cells[0] + cells[1] + cells[2] + cells[3]).alias("_x"), n.cast("long").alias("n"))
    return both.select(F.round("_x", 6).alias("chi2"), "n", F.round(p, 5).alias("p_value"), (p < 0.05).alias("significant"))


def rate_comparison(full: DataFrame, part: DataFrame, by: str, label: str = "phenotype") -> DataFrame:
    """Resistance share of each group in all rows and in a subset, and their difference; 0 where there are none."""

    def rate(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by).agg(F.avg(F.col(label).cast("double")).alias(name))

    both = rate(full, "rate_full").join(rate(part, "rate_part"), by, "left").fillna(0.0, ["rate_full", "rate_part"])
    return both.select(by, F.round("rate_full", 6).alias("rate_full"), F.round("rate_part", 6).alias("rate_part"), F.round(F.col("rate_part") - F.col("rate_full"), 6).alias("difference"))


def coverage_of(full: DataFrame, part: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values per group in all rows and in a subset, and the share covered in percent."""
    a = full.groupBy(by).agg(F.count_distinct(value).alias("n_full"))
    b = part.groupBy(by).agg(F.count_distinct(value).alias("n_part"))
    return a.join(b, by, "left").fillna(0, ["n_part"]).select(by, "n_full", "n_part", F.round(100.0 * F.col("n_part") / F.col("n_full"), 6).alias("coverage_pct"))


def percentiles(df: DataFrame, by: list[str], column: str, points: list[float]) -> DataFrame:
    """Exact interpolated percentiles per group, by ranks among counted values, so no group's values meet in one task."""
    p = value_summary(df, by, F.col(column), points)
    return p.select(*by, *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{str(x).replace('.', '_')}") for i, x in enumerate(points)])


def describe(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per group."""
    v = value_summary(df, by, F.col(column), [0.25, 0.5, 0.75])
    r = lambda x, n: F.round(F.round(x, 12), 6).alias(n)
    return v.select(*by, "n", r("mean", "mean"), r("std_samp", "std"), r("min", "min"), *[r(F.get("p", F.lit(i)), n) for i, n in enumerate(("q25", "q50", "q75"))], r("max", "max"))


def matrix_summary(cells: DataFrame, dim: str, column: str) -> DataFrame:
    """One row on a matrix of cells (dim, column): ranges of the means and population deviations of its columns, extremes, median, share of zeros."""
    c = F.col(column)
    per = cells.groupBy(dim).agg(F.avg(c).alias("_m"), F.stddev_pop(c).alias("_s"), F.min(c).alias("_min"), F.max(c).alias("_max"), F.count_if(c == 0).alias("_zero"), F.count(c).alias("_n"))
    r = lambda x, n: F.round(F.round(x, 12), 6).alias(n)
    median = value_summary(cells, [], c, [0.5]).select(F.round(F.get("p", F.lit(0)), 6)).scalar()
    whole = per.agg(r(F.min("_m"), "mean_low"), r(F.max("_m"), "mean_high"), r(F.min("_s"), "std_low"), r(F.max("_s"), "std_high"), r(F.min("_min"), "min"), r(F.max("_max"), "max"), r(F.try_divide(F.sum("_zero"), F.sum("_n")), "sparsity"))
    return whole.withColumn("median", median)


def kurtosis_of(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """m4 / (m2^2 + 1e-12), biased and not in excess of 3."""
    c = F.col(column).cast("double")
    mean = df.groupBy(*by).agg(F.avg(c).alias("_m"))
    d = c - F.col("_m")
    m2, m4 = F.avg(d * d), F.avg(d * d * d * d)
    return df.join(mean, by).groupBy(*by).agg(F.round(m4 / (m2 * m2 + 1e-12), 6).alias("kurtosis"))


def hill_index(df: DataFrame, by: list[str], column: str, k: int) -> DataFrame:
    """Hill tail index of the k largest magnitudes; 0 where a group has fewer than max(10, k + 1) values above 0."""
    x = df.select(*by, F.abs(F.col(column).cast("double")).alias("x")).where("x > 0")
    n = x.groupBy(*by).agg(F.count("*").alias("n"))
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("x")))).where(F.col("_r") <= k)
    tail = ranked.groupBy(*by).agg(F.sum(F.log("x")).alias("_s"), F.min("x").alias("_min"))
    inverse = F.col("_s") / k - F.log("_min")
    return n.join(tail, by).select(*by, F.when((F.col("n") >= max(10, k + 1)) & (inverse > 0), F.round(1 / inverse, 6)).otherwise(0.0).alias("hill"))


def zscore_extremes(df: DataFrame, by: list[str], column: str, limit: float = 6.0) -> DataFrame:
    """Largest absolute z-score (sample deviation, at least 1e-6) and the share beyond a limit per group."""
    stats = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.greatest(F.stddev_samp(column), F.lit(1e-6)).alias("_s"))
    z = F.abs((F.col(column) - F.col("_m")) / F.col("_s"))
    return df.join(stats, by).groupBy(*by).agg(F.round(F.max(z), 6).alias("max_z"), F.round(F.avg((z > limit).cast("double")), 6).alias("frac_z"))


def token_norms(df: DataFrame, by: list[str], column: str, k: int = 10) -> DataFrame:
    """Mean, sample deviation and maximum of magnitudes, the mean of the k largest, and the position of the largest."""
    x = df.withColumn("_x", F.abs(F.col(column).cast("double")))
    top = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_x"), "t"))).where(F.col("_r") <= k).groupBy(*by).agg(F.round(F.avg("_x"), 6).alias("top_mean"), F.min_by("t", "_r").alias("argmax_t"))
    return x.groupBy(*by).agg(F.round(F.avg("_x"), 6).alias("mean"), F.round(F.stddev_samp("_x"), 6).alias("std"), F.round(F.max("_x"), 6).alias("max")).join(top, by)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Count and density of each bin that holds values; the last bin is closed on the right."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
    total = inside.agg(F.count("*")).scalar()
    return inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("density", F.round(F.col("n") / (total * ((high - low) / bins)), 9))


def representation_score(comparison: DataFrame, shares_full: DataFrame, shares_part: DataFrame, by: str, coverage: Column, groups: int = 5) -> DataFrame:
    """20 points for each of `groups` groups of like resistance, 20 for like group shares, 20 for coverage, as a percentage of all points.

    A group that is empty in all rows or in the part gets none, and its share is not compared; what there is to get stays the same.
    """
    there = comparison.join(shares_full.select(by), by, "left_semi").join(shares_part.select(by), by, "left_semi")
    likeness = there.agg(F.sum(F.greatest(20.0 * (1 - F.abs("difference")), F.lit(0.0))).alias("_likeness"))
    mixed = shares_full.select(by, F.col("share").alias("_f")).join(shares_part.select(by, F.col("share").alias("_p")), by)
    gap = mixed.agg(F.avg(F.abs(F.col("_f") - F.col("_p")))).scalar()
    return likeness.select(F.round(100 * (F.col("_likeness") + 20.0 * (1 - gap) + 20.0 * F.least(coverage, F.lit(1.0))) / (20.0 * groups + 40.0), 6).alias("score"))


def stage_decomposition(df: DataFrame, layer: str, stage: str, value: str, stages: list[str]) -> DataFrame:
    """Mean and largest magnitude and tail ratio of each stage per layer, and the gains of mean and maximum from the first stage to the last.

    The tail ratio is that of `tail_ratio`. Numbers of a stage that a layer lacks, and gains from or to it, are null.
    """
    staged = df.where(F.col(stage).isin(*stages)).select(layer, F.col(stage).alias("_stage"), F.abs(F.col(value).cast("double")).alias("_x"))
    each = _with_tail(staged, [layer, "_stage"], F.col("_x"))
    cells = [F.max(F.when(F.col("_stage") == s, F.col(n))).alias(f"{s}_{n}") for s in stages for n in ("mean", "max", "tail")]
    wide = each.groupBy(layer).agg(*cells)
    gains = [F.round(F.col(f"{stages[-1]}_{n}") / (F.col(f"{stages[0]}_{n}") + 1e-12), 6).alias(f"gain_{n}") for n in ("mean", "max")]
    return wide.select(layer, *[F.round(F.round(f"{s}_{n}", 12), 6).alias(f"{s}_{n}") for s in stages for n in ("mean", "max", "tail")], *gains)


def _with_tail(df: DataFrame, by: list[str], magnitude: Column) -> DataFrame:
    """Summary of magnitudes per group with `tail`: the 99.9th (the 99th below 1,000 values) over the 95th percentile."""
    v = value_summary(df, by, magnitude, [0.95, 0.99, 0.999])
    return v.withColumn("tail", F.try_divide(F.when(F.col("n") < 1000, F.col("p")[1]).otherwise(F.col("p")[2]), F.col("p")[0]))


def tail_ratio(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean and largest magnitude, and the 99.9th (the 99th below 1,000 values) over the 95th percentile of magnitudes."""
    v = _with_tail(df, by, F.abs(F.col(column).cast("double")))
    return v.select(*by, F.round(F.round("mean", 12), 4).alias("mean"), F.round("max", 6).alias("max"), F.round("tail", 6).alias("tail_ratio"))


def mask_leak(df: DataFrame, by: list[str], valid: Column, column: str, limit: float = 1e-6) -> DataFrame:
    """Largest magnitude on places that are padding (not valid; null counts as padding), and whether it is above the limit."""
    top = F.max(F.abs(column))
    return df.where(~F.coalesce(valid, F.lit(False))).groupBy(*by).agg(F.round(top, 6).alias("max_padded"), F.coalesce(top > limit, F.lit(False)).alias("leaks"))


# Magnitudes at which 32-bit floats stop holding every integer, and ten times 2 to the 20th.
MAGIC = [8388608.0, 10485760.0, 16777216.0]


def constant_hits(df: DataFrame, by: list[str], column: str, constants: list[float] = MAGIC) -> DataFrame:
    """How many values of a group have one of the given magnitudes, and whether any has."""
    hit = F.abs(column).isin(constants)
    return df.groupBy(*by).agg(F.count_if(hit).alias("n_hits"), F.bool_or(hit).alias("hit"))


def tail_shape(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Kurtosis and Hill index per group, the latter over the n / 50 largest magnitudes, 10 at least and 200 at most."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("k", F.least(F.greatest(F.floor(F.col("n") / 50), F.lit(10)), F.lit(200)).cast("long"))
    x = df.select(*by, F.abs(F.col(column).cast("double")).alias("_x")).where("_x > 0")
    held = x.groupBy(*by).agg(F.count("*").alias("_held"))
    top = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_x")))).where("_r <= 200").join(sizes, by).where("_r <= k")
    tail = top.groupBy(*by, "k").agg(F.sum(F.log("_x")).alias("_s"), F.min("_x").alias("_min"))
    inverse = F.col("_s") / F.col("k") - F.log("_min")
    hill = tail.join(held, by).select(*by, F.when((F.col("_held") >= F.greatest(F.lit(10), F.col("k") + 1)) & (inverse > 0), F.round(1 / inverse, 6)).alias("hill"))
    return sizes.join(kurtosis_of(df, by, column), by).join(hill, by, "left").fillna(0.0, ["hill"])


def trajectory(df: DataFrame, place: str, layer: str, column: str) -> DataFrame:
    """A value of each chosen place from layer to layer, with its change since the one before; null in the first."""
    w = Window.partitionBy(place).orderBy(layer)
    return df.select(place, layer, F.round(column, 6).alias("x"), F.round(F.col(column) - F.lag(column).over(w), 6).alias("change"))
