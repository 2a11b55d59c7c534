"""Windows over long sequences and statistics of vectors."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.ordering import value_summary


def spans(length: Column, win: int, stride: int, cover_tail: bool = True) -> Column:
    """Windows (start, end) over a length, as an array: every `stride`, and one flush with the end if any is left over.

    No length gives none; a length below `win` gives one short window.
    """
    length = length.cast("long")
    regular = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((length - win) / stride).cast("long")), lambda i: F.struct((i * stride).alias("start"), (i * stride + win).alias("end")))
    tail = F.array(F.struct((length - win).alias("start"), length.alias("end")))
    covered = F.when((length - win) % stride == 0, regular).otherwise(F.concat(regular, tail)) if cover_tail else regular
    short = F.array(F.struct(F.lit(0).cast("long").alias("start"), length.alias("end")))
    return F.when(length <= 0, F.array().cast("array<struct<start:bigint,end:bigint>>")).when(length < win, short).otherwise(covered)


def windows_of(tokens: DataFrame, key: str, win: int, stride: int) -> DataFrame:
    """Tokens (key, t, ...) with each window that holds them: (key, window_idx, start, end, t, ...).

    A token computes its own windows from its place and the sequence's length, so nothing is range-joined.
    """
    lengths = tokens.groupBy(key).agg((F.max("t") + 1).alias("_n"))
    n, t = F.col("_n"), F.col("t").cast("long")
    full = F.when(n >= win, F.floor((n - win) / stride).cast("long") + 1).otherwise(1)
    low = F.greatest(F.ceil((t - win + 1) / stride).cast("long"), F.lit(0).cast("long"))
    high = F.least(F.floor(t / stride).cast("long"), full - 1)
    mine = F.when(high >= low, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<bigint>"))
    tail = F.when((n > win) & ((n - win) % stride != 0) & (t >= n - win), F.array(full)).otherwise(F.array().cast("array<bigint>"))
    start = F.when(F.col("window_idx") < full, F.col("window_idx") * stride).otherwise(n - win)
    out = tokens.join(lengths, key).withColumn("window_idx", F.explode(F.concat(mine, tail)))
    return out.withColumn("start", start).withColumn("end", F.least(F.col("start") + win, n)).drop("_n")


def chunks(df: DataFrame, key: str, text: str, size: int, least: int = 1) -> DataFrame:
    """Pieces of fixed length of a text, numbered; pieces below `least` characters are dropped."""
    n = F.length(text)
    at = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = df.select(key, F.col(text), F.explode(at).alias("window_idx"))
    return cut.select(key, F.col("window_idx").cast("long").alias("window_idx"), F.substr(F.col(text), F.col("window_idx") * size + 1, F.lit(size)).alias("chunk")).where(F.length("chunk") >= least)


def six_stats(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, population deviation, maximum, minimum and exact quartiles per group."""
    return selected_stats(values, by, column, ["mean", "std", "max", "min", "q25", "q75"])


def mean_pool(vectors: DataFrame, by: list[str], vector: str, dims: int) -> DataFrame:
    """Element-wise mean of the vectors of a group, as an array: one aggregate a dimension, combined before the shuffle.

    Vectors of another length are refused.
    """
    checked = F.when(F.size(vector) == dims, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector has not {dims} elements")))
    v = vectors.withColumn("_v", checked)
    return v.groupBy(*by).agg(F.array(*[F.avg(F.get("_v", F.lit(i)).cast("double")) for i in range(dims)]).alias("pooled"))


def top_k_mean(values: DataFrame, by: list[str], column: str, k: int) -> DataFrame:
    """Mean of the k largest values of a group; groups of fewer than k give none."""
    w = Window.partitionBy(*by).orderBy(F.desc(column))
    ranked = values.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.count("*").alias("_n"), F.round(F.avg(F.col(column).cast("double")), 6).alias("top_k_mean")).where(F.col("_n") == k).drop("_n")


def zscored(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Values less their group's mean over its population deviation plus 1e-8."""
    s = values.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return values.join(s, by).withColumn("z", (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).drop("_m", "_s")


def position_bins(values: DataFrame, key: str, column: str, bins: int, by: list[str] = ()) -> DataFrame:
    """Mean per bin of relative position, and per class if `by` names columns of a sequence: its ends fall into the first and the last bin."""
    n = values.groupBy(key).agg((F.max("t") + 1).alias("_n"))
    b = F.when(F.col("_n") <= 1, 0).otherwise(F.floor(F.col("t") / (F.col("_n") - 1).cast("double") * (1 - 1e-9) * bins)).cast("int")
    per = values.join(n, key).groupBy(*by, key, b.alias("bin")).agg(F.avg(column).alias("_m"))
    return per.groupBy(*by, "bin").agg(F.round(F.avg("_m"), 6).alias("mean"), F.count("*").alias("n_sequences"))


def even_rows(tokens: DataFrame, key: str, n: int) -> DataFrame:
    """n rows of each sequence at even distances, its ends among them; a sequence of fewer rows gives each row once."""
    lengths = tokens.groupBy(key).agg((F.max("t") + 1).alias("_n"))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / float(max(n - 1, 1))).cast("long")))
    return tokens.join(lengths.select(key, F.explode(at).alias("t")), [key, "t"])


def rotated(c: Column, by: int) -> Column:
    """A text whose first characters are moved to its end."""
    return F.concat(F.substr(c, F.lit(by + 1)), F.substr(c, F.lit(1), F.lit(by)))


def sequence_errors(df: DataFrame, key: str, text: str, least: int, most: int, alphabet: str = "ATCGN") -> DataFrame:
    """Sequences that are empty, have letters outside the alphabet, or are too short or too long; the first of these counts."""
    n = F.length(text)
    error = F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(~F.col(text).rlike(f"^[{alphabet}]+$"), "alphabet").when(n < least, "short").when(n > most, "long")
    return df.select(key, error.alias("error")).where("error is not null")


def random_windows(df: DataFrame, key: str, text: str, n: int, length: int, seed: int = 42) -> DataFrame:
    """(key, window_idx, start, window): n windows of each text at places that md5 of (key, number, seed) gives.

    Texts shorter than a window give none; windows of one text may overlap.
    """
    at = df.where(F.length(text) >= length).select(key, F.col(text), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("window_idx"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, "window_idx", F.lit(seed))), 1, 12), 16, 10).cast("long")
    return at.withColumn("start", draw % (F.length(text) - length + 1)).select(key, "window_idx", "start", F.substr(F.col(text), (F.col("start") + 1).cast("int"), F.lit(length)).alias("window"))


def padded_windows(tokens: DataFrame, key: str, column: str, win: int) -> DataFrame:
    """(key, window_idx, series): neighbouring windows of `win` tokens as arrays, the last filled with zeros."""
    at = F.floor(F.col("t") / win).cast("long")
    held = tokens.groupBy(key, at.alias("window_idx")).agg(F.array_sort(F.collect_list(F.struct("t", F.col(column).cast("double").alias("x"))))["x"].alias("_x"))
    return held.select(key, "window_idx", F.concat("_x", F.array_repeat(F.lit(0.0), F.lit(win) - F.size("_x"))).alias("series"))


def selected_stats(values: DataFrame, by: list[str], column: str, names: list[str]) -> DataFrame:
    """The named statistics per group, in the fixed order mean, max, std, min, median, q25, q75, whatever the order of names."""
    c = F.col(column).cast("double")
    plain = {"mean": F.avg(c), "max": F.max(c), "std": F.stddev_pop(c), "min": F.min(c)}
    ranked = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    if unknown := sorted(set(names) - set(plain) - set(ranked)):
        raise ValueError(f"no statistic {', '.join(unknown)}")
    r = lambda x, n: F.round(F.round(x, 12), 6).alias(n)  # the order in which Spark adds up must not tip a tie
    if not set(names) & set(ranked):
        return values.groupBy(*by).agg(*[r(f, n) for n, f in plain.items() if n in names])
    points = {n: q for n, q in ranked.items() if n in names}
    v = value_summary(values, by, c, list(points.values())).withColumnRenamed("std_pop", "std")
    return v.select(*by, *[r(n, n) for n in plain if n in names], *[r(F.get("p", F.lit(i)), n) for i, n in enumerate(points)])


ALPHABETS = {"dna": "ATCGN", "rna": "AUCGN", "protein": "ACDEFGHIKLMNPQRSTVWY"}  # fixed values: letters of each kind of sequence


def permuted(c: Column, seed: int = 9) -> Column:
    """The letters of a text in an order that looks random and depends on their places only."""
    mixed = lambda i: (i.cast("long") * 2654435761 + seed) % (1 << 32)  # odd factors and shifted xor keep 32 bits one to one
    place = lambda h: (h.bitwiseXOR(F.shiftright(h, 15)) * 1540483477) % (1 << 32)
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    drawn = F.transform(letters, lambda x, i: F.struct(place(mixed(i)), x.alias("_x")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda t: t["_x"]), "")


def kmer_counts(df: DataFrame, key: str, text: str, longest: int = 3, block: int = 1 << 16) -> DataFrame:
    """(key, kmer, n): how often every word of 1 to `longest` letters stands in the texts of a key, overlaps included.

    Only words of the letters A, C, G and T count, in either case. A text is cut into blocks that reach `longest` - 1
    letters into the next, so a task never holds a long text's words; counts of blocks are summed before and after the
    shuffle. Null texts and texts without such words give no rows; a null key is a key, repeated rows count each time.
    """
    digit = np.full(256, 4, np.int64)
    for i, letter in enumerate(b"ACGT"):
        digit[letter] = digit[letter | 32] = i
    words = ["".join(w) for k in range(1, longest + 1) for w in product("ACGT", repeat=k)]

    @F.pandas_udf("array<long>")
    def count(parts: pd.Series) -> pd.Series:
        out = []
        for part in parts:
            d = digit[np.frombuffer(bytes(part), np.uint8)]
            size, code, good, counts = min(len(d), block), np.zeros(len(d), np.int64), np.ones(len(d), bool), []
            for k in range(1, longest + 1):
                n = len(d) - k + 1
                if n <= 0:
                    counts.append(np.zeros(4**k, np.int64))
                    continue
                code, good = code[:n] * 4 + d[k - 1 :], good[:n] & (d[k - 1 :] < 4)
                counts.append(np.bincount(code[:size][good[:size]], minlength=4**k))
            out.append(np.concatenate(counts))
        return pd.Series(out)

    data = df.where(F.col(text) != "").select(key, F.col(text).cast("binary").alias("_b"))
    starts = F.explode(F.sequence(F.lit(1), F.length("_b"), F.lit(block)))
    parts = data.select(key, "_b", starts.alias("_at")).select(key, F.substring("_b", F.col("_at"), F.lit(block + longest - 1)).alias("_part"))
    named = parts.select(key, F.posexplode(count("_part")).alias("_w", "_n")).where("_n > 0")
    sums = named.groupBy(key, "_w").agg(F.sum("_n").alias("n"))
    return sums.select(key, F.get(F.array(*[F.lit(w) for w in words]), F.col("_w")).alias("kmer"), "n")
