"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import key_form, valid_phenotype
from strandline.runtime import table


@dataclass(frozen=True)
class HeavyKeys:
    """share: a key with more of all rows than this is heavy. salts: parts that all rows would be cut into; a heavy key is cut into
    its share of them, two at least.
    """

    share: float = 0.01
    salts: int = 1024

    @property
    def most(self) -> int:
        """Heavy keys there can be, with the slack of the sketch: the bound of what is broadcast."""
        return int(2 / self.share)


def heavy_keys(df: DataFrame, keys: list[str], how: HeavyKeys = HeavyKeys()) -> DataFrame:
    """(_heavy, _salts): hashes of the keys that hold more than about `share` of the rows, at most 2 / share of them, and the parts to cut each into.

    A frequent-items sketch finds them in one pass that shuffles one small sketch per task. Its error is below
    a twentieth of the share, so keys at half the share and above are taken; lighter keys are never needed here,
    as the sketch only decides the way a key is processed, not its result.
    """
    sketch = df.select(F.xxhash64(*keys).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {how.most}, {max(1024, int(100 / how.share))})").alias("_top"), F.count("*").alias("_n")
    )
    return sketch.select(F.explode("_top").alias("_t"), "_n").where(F.col("_t.count") > F.col("_n") * (how.share / 2)).select(
        F.col("_t.item").alias("_heavy"), F.greatest(F.ceil(F.col("_t.count") / F.col("_n") * how.salts), F.lit(2)).alias("_salts")
    )


def skewed_aggregate(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    distinct: str | None = None,
    how: HeavyKeys = HeavyKeys(),
) -> DataFrame:
    """Per key: `n_rows`, one sum for each of `sums` and, if asked, `n_distinct` of a column; `heavy` tells the way taken.

    Rows of heavy keys are found by a broadcast join with the sketch's few keys and aggregated in two steps:
    per (key, salt) and then per key. The salt comes from the counted column, so equal values meet in one salt and
    distinct counts add up; values are counted, not their hashes. All other keys take the ordinary shuffle, and both parts are put together.
    Null keys are keys like others; nulls in sums add nothing; nulls in the counted column are not counted;
    repeated rows count each time; an empty table gives no rows.
    """
    names = [*sums]
    counted = F.col(distinct) if distinct else F.lit(None).cast("long")
    rows = df.select(
        *keys, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()], counted.alias("_value"), F.xxhash64(*keys).alias("_key"),
    )
    heavy = heavy_keys(df, keys, how)
    tagged = rows.join(F.broadcast(heavy), F.col("_key") == F.col("_heavy"), "left")
    salt = F.when(F.col("_heavy").isNotNull(), F.pmod(F.xxhash64("_value") if distinct else F.monotonically_increasing_id(), F.col("_salts")))
    tagged = tagged.withColumn("_salt", salt)

    def result(part: DataFrame, by: list[str]) -> DataFrame:
        once = part.groupBy(*by, "_value").agg(F.count("*").alias("n_rows"), *[F.sum(n).alias(n) for n in names])
        seen = [F.count("_value").alias("n_distinct")] if distinct else []
        return once.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in names], *seen)

    light = result(tagged.where("_heavy is null"), keys).withColumn("heavy", F.lit(False))
    parts = result(tagged.where("_heavy is not null"), [*keys, "_salt"])
    seen = [F.sum("n_distinct").alias("n_distinct")] if distinct else []
    joined = parts.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(n).alias(n) for n in names], *seen).withColumn("heavy", F.lit(True))
    return light.unionByName(joined)


def looked_up(rows: DataFrame, key: str, values: DataFrame, kind: str = "inner", how: HeavyKeys = HeavyKeys(), n_rows: int | None = None, least: int = 1_000_000) -> DataFrame:
    """Rows joined with a table of unique keys, where a few keys may hold most of the rows.

    A sketch of the rows finds at most 2 / share heavy keys; their values are broadcast, so their rows stay where they are.
    All other rows take the ordinary shuffle. `kind` is inner or left; null keys match nothing. `rows` is read several times and
    should be a table. Both sides have `key`; no other column name may be common to them. Up to `least` rows no key can
    fill a task, so these are joined right away; n_rows, a bound on the rows where the caller knows one, saves counting them.
    """
    if (rows.count() if n_rows is None else n_rows) <= least:
        return rows.join(values, key, kind)
    heavy = rows.sparkSession.createDataFrame([(r["_heavy"],) for r in heavy_keys(rows.where(F.col(key).isNotNull()), [key], how).collect()], "_heavy long")  # at most `most` keys
    hashed = rows.withColumn("_key", F.xxhash64(key))
    here = F.broadcast(values.join(F.broadcast(heavy), F.xxhash64(key) == F.col("_heavy"), "left_semi"))
    there = values.join(F.broadcast(heavy), F.xxhash64(key) == F.col("_heavy"), "left_anti")
    apart = F.col("_key") == F.col("_heavy")
    few = hashed.join(F.broadcast(heavy), apart, "left_semi").join(here, key, kind)
    rest = hashed.join(F.broadcast(heavy), apart, "left_anti").join(there, key, kind)
    return few.unionByName(rest).drop("_key")


def blocked_join(left: DataFrame, right: DataFrame, key: str, size: int = 512) -> DataFrame:
    """Inner join on a key that may hold many rows on both sides: no task gets more than about size x size pairs of a key.

    Where a key's rows of both sides would make more pairs, its left rows are dealt to blocks of about `size` and so are its right rows;
    every left row is repeated for each right block and the other way round, and blocks meet by (key, block, block). All
    other keys join as usual. Pairs come out as often as a plain join gives them; null keys match nothing.
    Both sides have `key`, and should be tables, as they are read twice; no other column name may be common to them.
    """
    n_left, n_right = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)) for df, n in ((left, "_nl"), (right, "_nr")))
    crowded = n_left.join(n_right, key).where(F.col("_nl") * F.col("_nr") > size * size).select(key, F.ceil(F.col("_nl") / size).alias("_bl"), F.ceil(F.col("_nr") / size).alias("_br"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(own), F.lit(1)))
        tagged = df.join(crowded, key, "left").withColumn(f"_i{own}", place)
        blocks = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(other), F.lit(1).cast("long")) - 1)
        return tagged.withColumn(f"_i{other}", F.explode(blocks)).drop("_bl", "_br")

    return dealt(left, "_bl", "_br").join(dealt(right, "_br", "_bl"), [key, "_i_bl", "_i_br"]).drop("_i_bl", "_i_br")


def resistance_by_key(manifest: DataFrame) -> DataFrame:
    """Rows, genomes and resistance rate of every (species, antibiotic), both in key form and not blank.

    The rate is resistant rows over rows with a valid phenotype, and null where there are none.
    """
    keyed = manifest.select(
        key_form("species").alias("species"), key_form("antibiotic").alias("antibiotic"), valid_phenotype("phenotype").alias("phenotype"), "genome_id"
    ).where("species is not null and antibiotic is not null")
    counts = skewed_aggregate(
        keyed, ["species", "antibiotic"], {"n_resistant": (F.col("phenotype") == 1).cast("long"), "n_susceptible": (F.col("phenotype") == 0).cast("long")}, "genome_id"
    )
    return counts.withColumnRenamed("n_distinct", "n_genomes").withColumn(
        "resistance_rate", F.round(F.try_divide(F.col("n_resistant").cast("double"), F.col("n_resistant") + F.col("n_susceptible")), 6)
    )


def keys_over_share(counts: DataFrame, keys: list[str], share: str = "0.012") -> DataFrame:
    """Keys with more than an exact decimal share of all rows, from per-key counts."""
    total = counts.agg(F.sum("n_rows")).scalar()
    return counts.where(F.col("n_rows") > F.lit(share).cast("decimal(10,6)") * total).select(*keys)


def _p2_rates(spark, folder):
    rates = resistance_by_key(table(spark, folder, "tiny_manifest", ["species", "antibiotic", "phenotype", "genome_id"]))
    return rates.select("species", "antibiotic", "n_rows", "n_genomes", "n_resistant", "n_susceptible", "resistance_rate")


def _p2_found(spark, folder):
    return keys_over_share(resistance_by_key(table(spark, folder, "tiny_manifest", ["species", "antibiotic", "phenotype", "genome_id"])), ["species", "antibiotic"])


QUERIES = {"p2_found": _p2_found, "p2_rates": _p2_rates}

_KEYED = r"""select nullif(trim(regexp_replace(lower(species), '[^a-z0-9]+', '_', 'g'), '_'), '') as species,
  nullif(trim(regexp_replace(lower(antibiotic), '[^a-z0-9]+', '_', 'g'), '_'), '') as antibiotic,
  case when phenotype in (0, 1) then phenotype end as phenotype, genome_id from tiny_manifest"""

ORACLE = {
    "p2_found": f"""with k as (select * from ({_KEYED}) where species is not null and antibiotic is not null)
select species, antibiotic from k group by species, antibiotic having count(*) * 1000 > 12 * (select count(*) from k)""",
    "p2_rates": f"""with k as (select * from ({_KEYED}) where species is not null and antibiotic is not null)
select species, antibiotic, count(*) as n_rows, count(distinct genome_id) as n_genomes,
  cast(count(*) filter (where phenotype = 1) as bigint) as n_resistant, cast(count(*) filter (where phenotype = 0) as bigint) as n_susceptible,
  round(case when count(phenotype) > 0 then (count(*) filter (where phenotype = 1))::double / count(phenotype) end, 6) as resistance_rate
from k group by species, antibiotic""",
}
