"""Covariance, projection, convolution features and nearest neighbours on array columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import cut


def moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sample covariance of a vector column, in one pass.

    Every task sums its own (count, sum, cross products) around one common vector, which keeps them exact enough. The sums of tasks
    are added up in Spark, a row of the matrix at a time; the driver gets dims rows of dims numbers. Null vectors are left out.
    """
    given = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    first = given.first()
    if first is None:
        return 0, np.zeros(dims), np.zeros((dims, dims))
    shift = np.asarray(first["v"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, cross = 0, np.zeros(dims), np.zeros((dims, dims))
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(v, float) for v in pdf["v"]]) - shift
                n, total, cross = n + len(x), total + x.sum(0), cross + x.T @ x
        if n:
            yield pd.DataFrame({"i": np.arange(dims), "n": n, "s": total, "c": list(cross)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "n": [pdf["n"].sum()], "s": [pdf["s"].sum()], "c": [np.sum(np.stack(pdf["c"]), 0)]})

    schema = "i int, n long, s double, c array<double>"
    rows = given.mapInPandas(part, schema).groupBy("i").applyInPandas(added, schema).toPandas().sort_values("i")  # dims rows
    n, mean = int(rows["n"].iloc[0]), rows["s"].to_numpy() / rows["n"].iloc[0]
    return n, shift + mean, (np.stack(rows["c"]) - n * np.outer(mean, mean)) / max(n - 1, 1)


def covariance(df: DataFrame, vector: str, dims: int) -> DataFrame:
    """(i, j, cov) of a vector column."""
    _, _, cov = moments(df, vector, dims)
    return df.sparkSession.createDataFrame(pd.DataFrame({"i": np.repeat(np.arange(dims), dims), "j": np.tile(np.arange(dims), dims), "cov": cov.ravel()}), "i int, j int, cov double")


def principal_axes(df: DataFrame, vector: str, dims: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, k axes (rows; the largest component of each is positive) and the share of variance of every axis."""
    _, mean, cov = moments(df, vector, dims)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    axes = axes[:, order].T[:k]
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    values = np.clip(values[order], 0, None)
    return mean, axes, values / max(values.sum(), 1e-300)


def projected(df: DataFrame, vector: str, mean: np.ndarray, axes: np.ndarray, name: str = "projected") -> DataFrame:
    """(v - mean) times the axes, as JVM expressions over array literals."""
    offset = axes @ mean
    v = F.col(vector).cast("array<double>")
    parts = [F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in axis]), lambda a, b: a * b), F.lit(-float(o)), lambda s, x: s + x) for axis, o in zip(axes, offset)]
    return df.withColumn(name, F.array(*parts))


def standardised(df: DataFrame, vector: str, dims: int, fitted_on: DataFrame | None = None) -> DataFrame:
    """The vectors less the mean, over the sample deviation (at least 1e-6), of the rows they are fitted on (all rows unless given); null vectors stay null."""
    _, mean, cov = moments(df if fitted_on is None else fitted_on, vector, dims)
    parts = (F.array(*[F.lit(float(x)) for x in row]) for row in (mean, np.maximum(np.sqrt(np.diag(cov)), 1e-6)))
    offset, scale = parts
    centred = F.zip_with(F.col(vector).cast("array<double>"), offset, lambda a, b: a - b)
    return df.withColumn(vector, F.zip_with(centred, scale, lambda a, b: a / b))


def sparse_axes(dims: int, k: int, seed: int = 42, density: float | None = None) -> np.ndarray:
    """k sparse random axes: entries 0 or +-1 / sqrt(density k), chosen by md5 of (seed, axis, dimension)."""
    density = density or 1 / np.sqrt(dims)
    out = np.zeros((k, dims))
    for i in range(k):
        for j in range(dims):
            u = int(hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()[:6], 16) / (1 << 24)
            out[i, j] = 0 if u >= density else (1 if u < density / 2 else -1) / np.sqrt(density * k)
    return out


def gaussian_axes(dims: int, k: int, seed: int = 42) -> np.ndarray:
    """k dense random axes with entries of N(0, 1 / k), from two md5 digits of (seed, axis, dimension) by the Box-Muller transform."""
    out = np.zeros((k, dims))
    for i in range(k):
        for j in range(dims):
            h = hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()
            u, v = ((int(h[at : at + 6], 16) + 0.5) / (1 << 24) for at in (0, 6))
            out[i, j] = np.sqrt(-2 * np.log(u) / k) * np.cos(2 * np.pi * v)
    return out


def _kernels() -> np.ndarray:
    """The 84 kernels of length 9 with three weights 2 and six weights -1."""
    from itertools import combinations

    out = np.full((84, 9), -1.0)
    for row, at in zip(out, combinations(range(9), 3)):
        row[list(at)] = 2.0
    return out


def dilations(length: int, most: int) -> list[int]:
    """Up to `most` dilations, exponentially spaced, whose kernels fit into the length."""
    top = max(np.log2(max((length - 1) / 8, 1)), 0)
    return sorted({int(2**x) for x in np.linspace(0, top, most)})


def channel_weights(dilations_: list[int], channels: int, seed: int = 42) -> dict[int, np.ndarray]:
    """Per dilation the 84 kernels over all channels, as 84 x (9 channels) weights.

    Each kernel of each dilation sums up some of the channels, drawn by a seeded generator: 2**u of them, with u even between 0 and
    the logarithm of at most nine. With one channel these are the kernels as they stand.
    """
    rng, kernels, out = np.random.default_rng(seed), _kernels(), {}
    for d in dilations_:
        chosen = np.zeros((len(kernels), channels))
        for row in chosen:
            n = int(2 ** rng.uniform(0, np.log2(min(channels, 9) + 1)))
            row[rng.choice(channels, min(n, channels), replace=False)] = 1
        out[d] = (chosen[:, :, None] * kernels[:, None, :]).reshape(len(kernels), -1)
    return out


def convolved(x: np.ndarray, dilation: int, weights: np.ndarray) -> np.ndarray:
    """A series (one row a channel) under each dilated kernel of length 9 (one row a kernel), zeros beyond its ends."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    wide = np.pad(x, ((0, 0), (4 * dilation, 4 * dilation)))
    return weights @ np.stack([wide[:, i * dilation : i * dilation + n] for i in range(9)], 1).reshape(-1, n)


def bias_quantiles(outputs: list[np.ndarray], first: int, quantiles: int) -> np.ndarray:
    """Biases (84 x quantiles) of one dilation: quantiles of the outputs of the sample series, taken in turn; first kernels came before."""
    golden, rows = (np.sqrt(5) + 1) / 2, []
    for k in range(84):
        n = first + k
        q = ((n * quantiles + np.arange(quantiles) + 1) * golden) % 1
        rows.append(np.quantile(outputs[n % len(outputs)][k], q))
    return np.array(rows)


def kernel_biases(series: list[np.ndarray], weights: dict[int, np.ndarray], quantiles: int) -> dict[int, np.ndarray]:
    """Per dilation the biases, from the convolution of the given sample series."""
    return {d: bias_quantiles([convolved(x, d, w) for x in series], 84 * i, quantiles) for i, (d, w) in enumerate(weights.items())}


def positive_shares(x: np.ndarray, biases: dict[int, np.ndarray], weights: dict[int, np.ndarray]) -> np.ndarray:
    """Share of the places where each convolution exceeds each of its biases, by dilation, kernel and bias."""
    return np.concatenate([(convolved(x, d, weights[d])[:, None, :] > b[:, :, None]).mean(2).ravel() for d, b in biases.items()])


def _channel_values(df: DataFrame, column: str, channels: int) -> Column:
    """The column as an array of so many doubles: a number is one channel; nulls, and channels that an array lacks, are 0."""
    x = F.col(column)
    at = [F.get(x, F.lit(i)) if dict(df.dtypes)[column].startswith("array") else x for i in range(channels)]
    return F.array(*[F.coalesce(a.cast("double"), F.lit(0.0)) for a in at])


def _dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session asks for. A grouping by these keys needs no further shuffle, and little data is not
    put into one task, which would do all the arithmetic that follows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def kernel_features(windows: DataFrame, keys: list[str], column: str, length: int, most: int = 6, quantiles: int = 4, sample: int = 32, channels: int = 1) -> DataFrame:
    """Random-convolution features of every window of tokens (keys, t, column), as (keys, features): 84 x dilations x quantiles shares.

    The column is a number, or an array of which `channels` elements are channels. Biases are fitted on `sample` windows, first in
    hash order; that bound is the only data the driver gets. Windows that are shorter than `length` are padded with zeros, nulls are 0.
    Every window is one small group of `length` tokens at most. No tokens give no rows.
    """
    tokens = _dealt(windows.select(*keys, "t", _channel_values(windows, column, channels).alias("_x")), keys)
    series = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "_x"))).alias("_s")).select(*keys, F.flatten("_s._x").alias("x"))

    def fit(flat) -> np.ndarray:
        x = np.asarray(flat, float).reshape(-1, channels)[:length].T
        return np.pad(x, ((0, 0), (0, length - x.shape[1])))

    drawn = series.orderBy(F.xxhash64(*keys), *keys).limit(sample).collect()
    if not drawn:
        return series.select(*keys, F.array().cast("array<double>").alias("features"))
    weights = channel_weights(dilations(length, most), channels)
    biases = kernel_biases([fit(r["x"]) for r in drawn], weights, quantiles)

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        return pd.Series([positive_shares(fit(v), biases, weights) for v in x])

    return series.select(*keys, features("x").alias("features"))


def series_features(tokens: DataFrame, keys: list[str], column: str, block: int = 4096, most: int = 6, quantiles: int = 4, sample: int = 32, channels: int = 1) -> DataFrame:
    """Random-convolution features of whole series of tokens (keys, t, column), however long, as (keys, features).

    Dilations reach over the longest series, one number that the driver gets. Under dilation d every d-th token of a series is a
    series of its own, with dilation 1; so the phases (t mod d) are convolved apart: several short ones in one group, a long one in
    blocks of about `block` places with a halo of four tokens. A feature is a share of places, and counts of places add up: tasks
    hold blocks, never a series, and the result is that of one convolution over the whole.
    The column is a number, or an array of which `channels` elements are channels. Beyond the ends, and at places without a token
    or with a null, values are 0; each t of a series occurs once. Biases are fitted on one block, the first in hash order, of each of `sample`
    hash buckets a dilation. No tokens give no rows.
    """
    rows = tokens.where("t is not null").select(*keys, F.col("t").cast("long").alias("t"), _channel_values(tokens, column, channels).alias("_x"))
    low, high = rows.agg(F.min("t"), F.max("t")).first()
    if low is None:
        return tokens.select(*keys, F.array().cast("array<double>").alias("features")).limit(0)
    weights = channel_weights(dilations(high - low + 1, most), channels)
    shapes = []
    for d in weights:  # width of a block in places of a phase, and phases in a group
        width = min(block, -(-(high - low + 1) // d))
        shapes.append((d, width, max(1, block // (width + 8))))
    shape = F.inline(F.array(*[F.struct(F.lit(d).cast("long").alias("_d"), F.lit(w).cast("long").alias("_w"), F.lit(p).cast("long").alias("_p")) for d, w, p in shapes]))
    at = F.col("t") - low
    spread = rows.select(*keys, "_x", "t", shape).withColumn("_phase", at % F.col("_d")).withColumn("_u", F.floor(at / F.col("_d")))
    around = F.array_distinct(F.array(*[F.floor((F.col("_u") + h) / F.col("_w")) for h in (-4, 0, 4)]))
    placed = spread.withColumn("_block", F.explode(around)).withColumn("_in", F.col("_u") - F.col("_block") * F.col("_w"))
    spot = (F.col("_phase") % F.col("_p")) * (F.col("_w") + 8) + F.col("_in") + 4
    mine = (F.col("_in") >= 0) & (F.col("_in") < F.col("_w"))
    by = [*keys, "_d", "_group", "_block"]
    grouped = _dealt(placed.withColumn("_group", F.floor(F.col("_phase") / F.col("_p"))), by)
    blocks = cut(grouped.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(spot.alias("i"), mine.alias("own"), F.col("_x").alias("x")))).alias("_s"), F.count_if(mine).alias("_n")).where("_n > 0"))
    flat = [F.col("_s.i").alias("_i"), F.col("_s.own").alias("_own"), F.flatten("_s.x").alias("_x")]

    def shown(d: int, i, own, x) -> np.ndarray:
        """The outputs at the places a block owns; phases lie in one row, eight zeros apart."""
        i = np.asarray(i, int)
        wide = np.zeros((channels, i.max() + 5))
        wide[:, i] = np.asarray(x, float).reshape(-1, channels).T
        return convolved(wide, 1, weights[d])[:, i[np.asarray(own, bool)]]

    order = F.xxhash64(*keys, "_group", "_block")
    drawn = blocks.groupBy("_d", F.pmod(order, F.lit(sample)).alias("_bucket")).agg(F.min_by(F.struct(*flat), F.struct(order, *keys, "_group", "_block")).alias("_b")).orderBy("_d", "_bucket").collect()
    biases = {}
    for n, d in enumerate(weights):
        outputs = [shown(d, r["_b"]["_i"], r["_b"]["_own"], r["_b"]["_x"]) for r in drawn if r["_d"] == d]
        biases[d] = bias_quantiles(outputs, 84 * n, quantiles)

    @F.pandas_udf("array<long>")
    def counts(d: pd.Series, i: pd.Series, own: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([(shown(e, a, b, c)[:, None, :] > biases[e][:, :, None]).sum(2).ravel() for e, a, b, c in zip(d, i, own, x)])

    per_block = blocks.select(*keys, "_d", "_n", *flat).select(*keys, "_d", "_n", F.posexplode(counts("_d", "_i", "_own", "_x")).alias("_f", "_c"))
    shares = per_block.groupBy(*keys, "_d", "_f").agg((F.sum("_c") / F.sum("_n")).alias("_share"))
    return shares.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_f", "_share")))["_share"].alias("features"))


def positive_shares_above(tokens: DataFrame, keys: list[str], column: str, steps: list[int], bias: float) -> DataFrame:
    """(keys, dilation, kernel, share): share of the places of a series where each of the 84 kernels, in each dilation, exceeds one bias.

    The same convolution in columns alone: a token goes to the nine places that its value reaches, and a place adds up what comes
    there. A kernel is named by the places of its three weights 2. Places without a token are 0 and not counted; so are nulls, which are counted.
    """
    from itertools import combinations

    step = F.explode(F.array(*[F.lit(d).cast("long") for d in steps])).alias("dilation")
    tap = F.posexplode(F.sequence(F.lit(-4), F.lit(4))).alias("_j", "_o")
    sent = tokens.where("t is not null").select(*keys, F.col("t").cast("long").alias("t"), F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("_x"), step).select("*", tap)
    here = sent.groupBy(*keys, "dilation", (F.col("t") - F.col("_o") * F.col("dilation")).alias("_at")).agg(*[F.coalesce(F.max(F.when(F.col("_j") == j, F.col("_x"))), F.lit(0.0)).alias(f"_{j}") for j in range(9)], F.bool_or(F.col("_o") == 0).alias("_there")).where("_there")
    whole = sum((F.col(f"_{j}") for j in range(1, 9)), F.col("_0"))
    named = list(combinations(range(9), 3))
    above = [F.count_if(3 * (F.col(f"_{a}") + F.col(f"_{b}") + F.col(f"_{c}")) - whole > bias).alias(f"k{a}{b}{c}") for a, b, c in named]
    counts = here.groupBy(*keys, "dilation").agg(F.count("*").alias("_n"), *above)
    each = F.inline(F.array(*[F.struct(F.lit(f"{a}{b}{c}").alias("kernel"), F.col(f"k{a}{b}{c}").alias("_c")) for a, b, c in named]))
    return counts.select(*keys, "dilation", "_n", each).select(*keys, "dilation", "kernel", F.round(F.col("_c") / F.col("_n"), 6).alias("share"))


def in_blocks(queries: DataFrame, base: DataFrame, run, schema: str, query_rows: int, base_rows: int) -> DataFrame:
    """run(queries, rows) for every block of stated queries with every block of base, each a group of its own.

    Both have an `id`, whose hash deals them to blocks of about so many rows: a task holds one block of each, nothing goes through
    the driver, and the work is that of comparing the stated queries with all rows.
    """
    queries, base = cut(queries), cut(base)
    n_q, n_b = (max(1, -(-df.count() // n)) for df, n in ((queries, query_rows), (base, base_rows)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("_q", dealt(n_q)).withColumn("_b", every(n_b))
    right = base.withColumn("_b", dealt(n_b)).withColumn("_q", every(n_q))
    return left.groupBy("_q", "_b").cogroup(right.groupBy("_q", "_b")).applyInPandas(run, schema)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column])


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, a few rows of x at a time."""
    step = max(1, (1 << 22) // max(q.size, 1))
    return np.concatenate([np.sqrt(((q[:, None, :] - x[None, i : i + step, :]) ** 2).sum(2)) for i in range(0, len(x), step)], 1)


def silhouettes(queries: DataFrame, base: DataFrame, key: str, vector: str, label: str, block: int = 1024) -> DataFrame:
    """(query, label, silhouette) of stated queries against all rows of base, with Euclidean distance.

    A block of queries with a block of base sums the distances from each query to the block's rows of each cluster; only these
    sums are shuffled. A query that is alone in its cluster, or in the only cluster, has 0. Rows with a null vector or label are left out.
    """
    held = (F.col(vector).isNotNull()) & F.col(label).isNotNull()
    rows = lambda df: df.where(held).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("c"))
    stated = cut(rows(queries))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "c": [], "total": [], "n": []})]
        if len(q) and len(x):
            v = _stacked(q["v"])
            out = [pd.DataFrame({"query": q["id"], "c": name, "total": _distances(v, _stacked(g["v"])).sum(1), "n": len(g)}) for name, g in x.groupby("c")]
        return pd.concat(out)

    found = in_blocks(stated, rows(base), run, f"query {dict(base.dtypes)[key]}, c {dict(base.dtypes)[label]}, total double, n long", block, 8 * block)
    own = stated.select(F.col("id").alias("query"), F.col("c").alias("label"))
    met = found.groupBy("query", "c").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(own, "query")
    inner = F.col("c") == F.col("label")
    a = F.max(F.when(inner & (F.col("n") > 1), F.col("total") / (F.col("n") - 1)))
    b = F.min(F.when(~inner, F.col("total") / F.col("n")))
    return met.groupBy("query", "label").agg(a.alias("_a"), b.alias("_b")).select("query", "label", F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)).alias("silhouette"))


def nearest(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, metric: str = "cosine", block: int = 1024, apart: str | None = None) -> DataFrame:
    """(query, neighbour, score, rank): the k rows of base nearest to each query, itself left out, and so are rows with its value of `apart`, if given.

    A block of queries with a block of base keeps its own k best a query, and only those are shuffled. cosine: highest first;
    euclidean: lowest first; scores are rounded to 9 digits, ties go to the smaller id. Null vectors are left out; a zero
    vector has cosine 0.
    """
    group = F.xxhash64(apart) if apart else F.lit(None).cast("long")
    rows = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), group.alias("g"))
    kind = dict(base.dtypes)[key]

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbour": [], "score": []})
        if not len(q) or not len(x):
            return empty
        x = x.sort_values("id", ignore_index=True)  # a stable sort by score leaves ties to the smaller id
        a, b, names, own = _stacked(q["v"]), _stacked(x["v"]), q["id"].to_numpy(), x["id"].to_numpy()
        if metric == "cosine":
            lengths = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            far = -np.divide(a @ b.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
        else:
            far = _distances(a, b)
        far = np.round(far, 9)
        far[names[:, None] == own[None, :]] = np.inf
        if apart:
            far[q["g"].to_numpy()[:, None] == x["g"].to_numpy()[None, :]] = np.inf
        best = np.argsort(far, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(far, best, 1)
        out = pd.DataFrame({"query": np.repeat(names, best.shape[1]), "neighbour": own[best].ravel(), "score": score.ravel()})
        out = out[np.isfinite(out["score"])]
        return out.assign(score=-out["score"]) if metric == "cosine" else out

    found = in_blocks(rows(queries), rows(base), run, f"query {kind}, neighbour {kind}, score double", block, 8 * block)
    order = F.desc("score") if metric == "cosine" else F.asc("score")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order, "neighbour"))).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Per query the votes of its neighbours and the majority; a tie is 0."""
    lab = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_l"))
    v = neighbours.join(lab, "neighbour").groupBy("query").agg(F.count_if(F.col("_l") == 1).alias("n_one"), F.count_if(F.col("_l") == 0).alias("n_zero"))
    own = labels.select(F.col(key).alias("query"), F.col(label).alias("y_true"))
    return v.join(own, "query").withColumn("y_pred", (F.col("n_one") > F.col("n_zero")).cast("int"))


def match_flags(neighbours: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Neighbours with same_<column> for each of the columns: whether query and neighbour have the same value; null where one has none."""
    mine = rows.select(F.col(key).alias("query"), *[F.col(c).alias(f"_q_{c}") for c in columns])
    theirs = rows.select(F.col(key).alias("neighbour"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = neighbours.join(mine, "query").join(theirs, "neighbour")
    return both.select(*neighbours.columns, *[(F.col(f"_q_{c}") == F.col(f"_n_{c}")).alias(f"same_{c}") for c in columns])


def usage_summary(neighbours: DataFrame) -> DataFrame:
    """How many rows are used as neighbours, how often in all, and their mean, largest and smallest use."""
    used = neighbours.groupBy("neighbour").agg(F.count("*").alias("n"))
    return used.agg(F.count("*").alias("n_used"), F.sum("n").alias("n_links"), F.round(F.avg("n"), 6).alias("mean_usage"), F.max("n").alias("max_usage"), F.min("n").alias("min_usage"))


def purity_by_k(flagged: DataFrame, same: str, counts: list[int]) -> DataFrame:
    """(k, purity, same_distance, other_distance): over the first k neighbours of all queries, in one pass."""
    up_to = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in counts]), lambda k: F.col("rank") <= k))
    rows = flagged.select(up_to.alias("k"), F.col(same).alias("_same"), "score")
    return rows.groupBy("k").agg(
        F.round(F.avg(F.col("_same").cast("double")), 6).alias("purity"), F.round(F.avg(F.when(F.col("_same"), F.col("score"))), 6).alias("same_distance"),
        F.round(F.avg(F.when(~F.col("_same"), F.col("score"))), 6).alias("other_distance"),
    )


def vote_grid(neighbours: DataFrame, labels: DataFrame, key: str, label: str, split: str, counts: list[int]) -> DataFrame:
    """(k, weighting, split, n, accuracy): votes of the first k neighbours, each worth 1 (uniform) or one over its distance (distance).

    All settings come from one neighbour table in one pass. A tie is 0; a distance counts as 1e-12 at least. Neighbours without a label do not vote.
    """
    theirs = labels.select(F.col(key).alias("neighbour"), F.col(label).alias("_y"))
    mine = labels.select(F.col(key).alias("query"), F.col(label).alias("_own"), F.col(split).alias("split"))
    up_to = F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in counts]), lambda k: F.col("rank") <= k))
    inverse = 1 / F.greatest(F.col("score"), F.lit(1e-12))
    votes = neighbours.join(theirs, "neighbour").where("_y is not null").select("query", "_y", "score", up_to.alias("k"))
    both = F.inline(F.array(F.struct(F.lit("uniform").alias("weighting"), F.lit(1.0).alias("_w")), F.struct(F.lit("distance").alias("weighting"), inverse.alias("_w"))))
    share = F.round(F.sum(F.col("_w") * F.col("_y")) / F.sum("_w"), 9)
    called = votes.select("query", "_y", "k", both).groupBy("query", "k", "weighting").agg((share > 0.5).cast("int").alias("_p")).join(mine, "query")
    return called.groupBy("k", "weighting", "split").agg(F.count("*").alias("n"), F.round(F.avg((F.col("_p") == F.col("_own")).cast("double")), 6).alias("accuracy"))


def spectrum_stats(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Effective rank and participation ratio of each group's centred matrix, from its Gram matrix of dims x dims.

    Groups are summed to moments before they meet, so a group of any size costs dims x dims numbers.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for name, g in pdf.groupby("key", dropna=False):
                x = np.stack([np.asarray(v, float) for v in g["v"]])
                n, s, c = held.get(name, (0, 0.0, 0.0))
                held[name] = (n + len(x), s + x.sum(0), c + x.T @ x)
            if len(held) >= 256:
                yield pd.DataFrame([(a, n, s, np.ravel(c)) for a, (n, s, c) in held.items()], columns=["key", "n", "s", "c"])
                held = {}
        if held:
            yield pd.DataFrame([(a, n, s, np.ravel(c)) for a, (n, s, c) in held.items()], columns=["key", "n", "s", "c"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = pdf["n"].sum(), np.sum(np.stack(pdf["s"]), 0)
        c = np.sum(np.stack(pdf["c"]), 0).reshape(len(s), len(s)) - np.outer(s, s) / n
        sv = np.sqrt(np.clip(np.linalg.eigvalsh(c), 0, None))
        p = sv / max(sv.sum(), 1e-300)
        p = p[p > 1e-12]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [n], "effective_rank": [float(np.exp(-(p * np.log(p)).sum()))], "participation_ratio": [float(sv.sum() ** 2 / max((sv**2).sum(), 1e-300))]})

    kind = dict(df.dtypes)[key]
    sums = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(part, f"key {kind}, n long, s array<double>, c array<double>")
    return sums.groupBy("key").applyInPandas(whole, f"key {kind}, n long, effective_rank double, participation_ratio double").withColumnRenamed("key", key)
