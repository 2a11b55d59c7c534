"""Ranks and running totals inside groups of any size, without a group ever filling one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 12


def permutation(seed: int, *keys: str) -> Column:
    """A pseudo-random order of rows that depends only on their keys and the seed."""
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def running_total(df: DataFrame, group: list[str], keys: list[str], value: str | None = None, seed: int = 0, name: str = "before", bits: int = BUCKET_BITS) -> DataFrame:
    """Add the sum of `value` (or the count) over the rows that come before in the group's permuted order.

    The order is by a hash of `keys`, whose top bits cut every group into 2 ** bits buckets of like size. Bucket sums
    are small and are summed up first; only inside a bucket rows are sorted. So a group that holds a third of all
    rows is spread over many tasks. Rows equal in all keys follow each other in any order; `group` and `keys` must
    not be null in ways that matter: nulls form a group of their own.
    """
    amount = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value).cast("long"), F.lit(0).cast("long"))
    by = [*group, "_bucket"]
    rows = df.withColumn("_order", permutation(seed, *keys)).withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits)).withColumn("_amount", amount)
    sums = rows.groupBy(*by).agg(F.sum("_amount").alias("_sum"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by).orderBy("_order", *keys).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(starts, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by], "left")
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .drop("_order", "_bucket", "_amount", "_start", *[f"_s_{c}" for c in by])
    )


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, name: str = "t") -> DataFrame:
    """Add the place (from 0) of every row in its group's order.

    `bucket` has to rise with the first column of `order`, such as its day: rows are numbered inside buckets, and
    the small table of bucket counts gives each its start. So the largest bucket, not the largest group, is what one
    task sorts. Nulls in the order come first; rows equal in all of `order` follow each other in any order.
    """
    by = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    joined = rows.join(starts, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in by])
    return joined.withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_bucket", "_start", *[f"_s_{c}" for c in by])


def _together(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "inner") -> DataFrame:
    """An equal join in which nulls are equal; the columns of the keys are those of the left."""
    other = right.select(*[F.col(c).alias(f"_s_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys], kind).drop(*[f"_s_{c}" for c in keys])


def value_totals(df: DataFrame, group: list[str], value: str, sums: dict[str, Column], parts: int = 256, least: int = 100_000, whole: dict[str, Column] | None = None) -> DataFrame:
    """Distinct values of each group with sums over their rows, over rows of smaller values (<name>_before) and over the group (<name>_total).

    Rows are combined per value first. Approximate quantiles of a group's distinct values cut these into about `parts`
    buckets whose sums are small, and only inside a bucket values are sorted; so neither the rows nor the distinct
    values of a group meet in one task; a group of up to `least` distinct values is one bucket. The cuts decide the buckets
    only, the sums are exact. `whole` are more aggregates of a group over its distinct values, added to each. A null value comes
    first, NaN last; null groups are a group; sums must not be null.
    """
    keys, whole = group or ["_all"], whole or {}
    rows = df if group else df.withColumn("_all", F.lit(0))
    at = rows.groupBy(*keys, value).agg(*[f.alias(n) for n, f in sums.items()])
    cuts = F.when(F.count("*") > least, F.percentile_approx(value, [i / parts for i in range(1, parts)], 16 * parts)).otherwise(F.array())
    of_group = at.groupBy(*keys).agg(cuts.alias("_cuts"), *[F.sum(n).alias(f"{n}_total") for n in sums], *[f.alias(n) for n, f in whole.items()])
    placed = _together(at, of_group, keys).withColumn("_bucket", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_sum_{n}") for n in sums])
    starts = buckets.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_sum_{n}").over(upto), F.lit(0)).alias(f"_start_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _together(placed, starts, [*keys, "_bucket"])
    before = [(F.col(f"_start_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in sums]
    return out.select(*group, value, *sums, *before, *[f"{n}_total" for n in sums], *whole)


def value_summary(df: DataFrame, by: list[str], column: Column, points: list[float], least: int = 100_000) -> DataFrame:
    """(by, n, mean, std_pop, std_samp, min, max, p) of a column per group; p are exact percentiles, interpolated between neighbours.

    Everything comes from counted distinct values, see `value_totals`; df is read once. A group without values has n 0 and nulls;
    without groups there is one row, for an empty table too. Null values are not counted.
    """
    n, x, of = F.col("_n"), F.col("_v"), F.col("_n_total")
    values = df.select(*by, column.cast("double").alias("_v"))
    at = value_totals(values, by, "_v", {"_n": F.count("_v")}, least=least, whole={"_mean": F.try_divide(F.sum(n * x), F.sum(n)), "_min": F.min(x), "_max": F.max(x)})
    first, last = F.col("_n_before"), F.col("_n_before") + n
    picked = []
    for i, q in enumerate(points):
        place = F.lit(float(q)) * (of - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            picked.append(F.max(F.when((first <= rank) & (rank < last), x)).alias(f"_{side}_{i}"))
    squares = F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean")))
    held = at.groupBy(*by).agg(F.coalesce(F.max(of), F.lit(0)).alias("n"), F.max("_mean").alias("mean"), squares.alias("_s"), F.max("_min").alias("min"), F.max("_max").alias("max"), *picked)
    total = F.col("n")

    def between(i: int, q: float) -> Column:
        place = F.lit(float(q)) * (total - 1)
        return F.col(f"_low_{i}") + (F.col(f"_high_{i}") - F.col(f"_low_{i}")) * (place - F.floor(place))

    std = {"std_pop": F.sqrt(F.try_divide(F.col("_s"), total)), "std_samp": F.sqrt(F.try_divide(F.col("_s"), total - 1))}
    return held.select(*by, "n", "mean", *[f.alias(k) for k, f in std.items()], "min", "max", F.array(*[between(i, q) for i, q in enumerate(points)]).alias("p"))
