"""Filters, joins, counts, cross tables and set operations over manifests and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import OUTSIDE_SPLITS, key_form, known_split, valid_phenotype
from strandline.functions.scalars import comparable_id, hash_order, taxon_of
from strandline.operators.ordering import numbered, running_total, value_totals

# Columns of a manifest.
REQUIRED = ("genome_id", "species", "antibiotic", "phenotype", "partition_label")
OPTIONAL = ("sequence_path", "embedding_path", "source_dataset", "split_design")


def schema_status(columns: list[str]) -> dict[str, list[str]]:
    """Required and optional manifest columns that are there or missing, sorted."""
    have = set(columns)
    return {
        f"{kind}_{state}": sorted(c for c in names if (c in have) == (state == "present"))
        for kind, names in (("required", REQUIRED), ("optional", OPTIONAL)) for state in ("present", "missing")
    }


def row_errors(manifest: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first rule broken: phenotype 0 or 1, genome_id and species not blank."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = F.when(~F.coalesce(F.col("phenotype").isin(0, 1), F.lit(False)), "phenotype").when(blank("genome_id"), "genome_id").when(blank("species"), "species")
    return manifest.withColumn("error", error).where("error is not null")


def tidy_manifest(manifest: DataFrame) -> DataFrame:
    """Usable rows in canonical form: split, species and antibiotic in key form, phenotype 0 or 1, extra columns kept."""
    kept = manifest.withColumn("split", known_split("partition_label")).withColumn("species", key_form("species")).withColumn("antibiotic", key_form("antibiotic")).withColumn("phenotype", valid_phenotype("phenotype"))
    return kept.dropna(subset=["genome_id", "split", "species", "antibiotic", "phenotype"])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in the order; a max over structs, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def valid_positions(tokens: DataFrame, keys: list[str], order: str, mask: str, block: int = 4096) -> DataFrame:
    """Rows whose mask is above 0.5 (null counts as valid), numbered anew from 0 in every sequence; a task sorts `block` places of one."""
    kept = tokens.where(F.coalesce(F.col(mask), F.lit(1.0)) > 0.5).withColumnRenamed(order, "_place")
    return numbered(kept, keys, ["_place"], F.floor(F.col("_place") / block), "t").drop("_place")


def summary_by(df: DataFrame, by: list[str], distinct: str) -> DataFrame:
    """Rows and distinct values of a column per group."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct(distinct).alias(f"n_{distinct}"))


def rates_by(df: DataFrame, by: list[str], label: str = "phenotype") -> DataFrame:
    """Resistant and susceptible rows and resistance in percent per group; null where there are none."""
    r, s = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(*by).agg(r.alias("n_resistant"), s.alias("n_susceptible"), F.round(F.try_divide(100.0 * r, r + s), 6).alias("resistant_pct"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; nulls are a value."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counts.withColumn("share", F.round(F.col("n").cast("double") / total, 6))


def outside_leakage(df: DataFrame) -> DataFrame:
    """(split, species): species of the outside splits that stand in train too."""
    train = df.where("split = 'train'").select("species").distinct()
    return df.where(F.col("split").isin(*OUTSIDE_SPLITS)).select("split", "species").distinct().join(train, "species", "left_semi")


def crosstab(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    """Counts of rows x column with margins `All`; the values of the column are given, so no extra pass finds them."""
    cells = [F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values]
    within = df.where(F.col(column).isin(*values))
    return within.rollup(rows).agg(*cells, F.count("*").alias("All"), F.grouping(rows).alias("_g")).withColumn(rows, F.when(F.col("_g") == 1, "All").otherwise(F.col(rows))).drop("_g")


def top_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group; Spark prunes each task to n rows a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def top_per_group_counted(df: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group, ties by value."""
    return top_per_group(df.groupBy(*by, value).agg(F.count("*").alias("n")), by, [F.desc("n"), F.col(value)], n)


def joined_names(df: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Per group the `most` most frequent values as `name (n)`, joined by '; ', with the number of the others."""
    top = top_per_group_counted(df, by, value, most)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", value, "n"))), lambda x: F.format_string("%s (%d)", x[value], x["n"])), "; ")
    kinds = df.groupBy(*by).agg(F.count_distinct(value).alias("_kinds"))
    return top.groupBy(*by).agg(text.alias("names")).join(kinds, by).select(*by, "names", F.greatest(F.col("_kinds") - most, F.lit(0)).alias("n_more"))


def purity(df: DataFrame, by: str, label: str = "phenotype") -> DataFrame:
    """Share of the more frequent label in groups of more than one row; a tie is S."""
    r, s = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.groupBy(by).agg(r.alias("r"), s.alias("s")).where("r + s > 1").select(by, (F.col("r") + F.col("s")).alias("n"), F.round(F.greatest("r", "s").cast("double") / (F.col("r") + F.col("s")), 6).alias("purity"), F.when(F.col("r") > F.col("s"), "R").otherwise("S").alias("dominant"))


def zero_filled(df: DataFrame, group: str, values: list[str], column: str) -> DataFrame:
    """Count per group for each of the given values, 0 where there are none."""
    return df.groupBy(group).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, and rows beyond the first of rows equal in all columns."""
    every = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.count("*") - F.count_distinct(every)).alias("n_duplicated"))


def alike_ids(df: DataFrame, key: str) -> DataFrame:
    """(norm, n_ids, ids): comparable forms that several different ids of one table share, with these ids in order."""
    forms = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), comparable_id(F.col(key)).alias("norm")).distinct()
    return forms.groupBy("norm").agg(F.count("*").alias("n_ids"), F.array_join(F.array_sort(F.collect_list("_id")), "; ").alias("ids")).where("n_ids > 1")


def two_tier_lookup(ids: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """Value by exact id, else by comparable id; where several rows fit, the smallest value."""
    exact = labels.groupBy(key).agg(F.min(value).alias("_exact"))
    loose = labels.groupBy(comparable_id(F.col(key)).alias("_norm")).agg(F.min(value).alias("_loose"))
    return ids.join(exact, key, "left").withColumn("_norm", comparable_id(F.col(key))).join(loose, "_norm", "left").select(key, F.coalesce("_exact", "_loose").alias(value))


def ambiguous_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of different ids of a and b that are equal in comparable form."""
    x = a.select(F.col(key).alias("id_a"), comparable_id(F.col(key)).alias("norm")).distinct()
    y = b.select(F.col(key).alias("id_b"), comparable_id(F.col(key)).alias("norm")).distinct()
    return x.join(y, "norm").where("id_a <> id_b").select("id_a", "id_b")


def species_by_prefix(ids: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Species of a genome by the part of its id before the dot, then by the id, else Unknown_<id>."""
    full = names.where(F.col(name).isNotNull()).groupBy(key).agg(F.min(name).alias("_full"))
    prefix = names.where(F.col(name).isNotNull()).groupBy(taxon_of(F.col(key)).alias("_taxon")).agg(F.min(name).alias("_by_prefix"))
    return ids.withColumn("_taxon", taxon_of(F.col(key))).join(prefix, "_taxon", "left").join(full, key, "left").select(key, F.coalesce("_by_prefix", "_full", F.concat(F.lit("Unknown_"), F.col(key))).alias(name))


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group without replacement in hash order, the same in every run; top-n per group prunes early."""
    return top_per_group(df.withColumn("_h", hash_order(F.col(key), seed)), by, [F.col("_h"), F.col(key)], n).drop("_h", "rank")


def sample_each_group_first(df: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: first one of each group, groups in order, then any others in hash order; the first of a group is its first in hash order.

    Only n rows of a group can matter, so groups are pruned to these before the rest meet; the final sort keeps n rows a task.
    """
    h = hash_order(F.col(key), seed)
    ranked = top_per_group(df.withColumn("_h", h), [by], [F.col("_h"), F.col(key)], n)
    first = F.col("rank") == 1
    return ranked.orderBy(~first, F.when(first, F.col(by)), "_h", key, by).limit(n).drop("_h", "rank")


def sample_balanced(df: DataFrame, label: str, key: str, target: int, share_of_zero: float, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """`target` rows (of each group, if `by` is given) of which a given share has label 0; what label 0 lacks is filled with label 1 and not the reverse.

    Each label of a group is first cut to `target` rows in hash order, so what a task sorts after that is bounded. Other labels are left out.
    """
    by = by or []
    ranked = top_per_group(df.where(F.col(label).isin(0, 1)).withColumn("_h", hash_order(F.col(key), seed)), [*by, label], [F.col("_h"), F.col(key)], target)
    zeros = F.least(F.count_if(F.col(label) == 0).over(Window.partitionBy(*by)), F.lit(int(target * share_of_zero)))
    return ranked.withColumn("_zeros", zeros).where(F.col("rank") <= F.when(F.col(label) == 0, F.col("_zeros")).otherwise(target - F.col("_zeros"))).drop("_h", "rank", "_zeros")


def quota_plan(df: DataFrame, by: str | list[str], label: str, targets: DataFrame) -> DataFrame:
    """Rows to draw from each group of `targets` (by, target, share_of_zero), as far as they are there.

    n_zero is floor(target x share_of_zero), or all rows of label 0 where there are fewer; label 1 fills up to the target.
    Groups without rows get 0; rows of groups that are no target, or of other labels, are left out. Null shares count as 0.
    """
    by = [by] if isinstance(by, str) else by
    there = df.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("there_zero"), F.count_if(F.col(label) == 1).alias("there_one"))
    t = targets.join(there, by, "left").fillna(0, ["there_zero", "there_one"])
    share = F.coalesce(F.col("share_of_zero").cast("decimal(12,6)"), F.lit(0))
    t = t.withColumn("n_zero", F.least("there_zero", F.floor(F.col("target") * share).cast("long")))
    return t.select(*by, "there_zero", "there_one", "n_zero", F.least("there_one", F.col("target") - F.col("n_zero")).cast("long").alias("n_one"))


def sample_planned(df: DataFrame, by: str | list[str], label: str, key: str, plan: DataFrame, seed: int = 42) -> DataFrame:
    """The rows that a plan (by, n_zero, n_one) asks for, in hash order within each group and label.

    Rows are numbered within buckets of their order, so no group or label is sorted in one task. Ties of key keep any order.
    """
    by = [by] if isinstance(by, str) else by
    ranked = running_total(df.where(F.col(label).isin(0, 1)), [*by, label], [key], seed=seed, name="_rank")
    return ranked.join(plan.select(*by, "n_zero", "n_one"), by).where(F.col("_rank") < F.when(F.col(label) == 0, F.col("n_zero")).otherwise(F.col("n_one"))).drop("_rank", "n_zero", "n_one")


def sample_proportional(df: DataFrame, by: list[str], label: str, key: str, target: int, seed: int = 42) -> DataFrame:
    """`target` rows of each group with its own shares of labels 1 and 0; what one label lacks the other fills.

    Groups of at most `target` rows are taken whole. Rows of other labels are left out.
    """
    counts = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_r"), F.count_if(F.col(label) == 0).alias("_z"))
    n, want = F.col("_r") + F.col("_z"), F.floor(F.lit(target) * F.col("_r") / (F.col("_r") + F.col("_z")))
    first = counts.where("_r + _z > 0").withColumn("_1", F.when(n <= target, F.col("_r")).otherwise(F.least(want, "_r"))).withColumn("_0", F.when(n <= target, F.col("_z")).otherwise(F.least(target - want, "_z")))
    lack = F.greatest(target - F.col("_1") - F.col("_0"), F.lit(0))
    quota = first.select(*by, (F.col("_1") + F.least(F.col("_r") - F.col("_1"), lack)).alias("_q1"), (F.col("_0") + F.least(F.col("_z") - F.col("_0"), lack)).alias("_q0"))
    # no label's quota is above the target, so each group is cut to that many before its quota is looked up
    ranked = top_per_group(df.where(F.col(label).isin(0, 1)).withColumn("_h", hash_order(F.col(key), seed)), [*by, label], [F.col("_h"), F.col(key)], target)
    return ranked.join(quota, by).where(F.col("rank") <= F.when(F.col(label) == 1, F.col("_q1")).otherwise(F.col("_q0"))).drop("_h", "rank", "_q1", "_q0")


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Rows to splits by a hash of their key: no shuffle, and a row keeps its split when others come. The rest is train."""
    if any(s < 0 for s in shares.values()) or sum(shares.values()) >= 1:
        raise ValueError("shares must not be negative and must add up to less than 1")
    bucket = F.conv(F.substr(hash_order(F.col(key), seed), F.lit(1), F.lit(6)), 16, 10).cast("long")
    choice, edge = F.lit("train"), sum(shares.values())
    for name, share in reversed(shares.items()):
        choice = F.when(bucket < int(edge * (1 << 24)), F.lit(name)).otherwise(choice)
        edge -= share
    return df.withColumn("assigned", choice)


# Levels of clusters, and the shares of validation and test of the named designs.
CLUSTER_LEVELS = ("genus", "species", "taxa", "genome_id", "kma_cluster", "phylogeny")
DESIGN_SHARES = {"genus": (0.2, 0.15), "taxa": (0.17, 0.13), "genome_id": (0.1, 0.1)}
OTHER_SHARES = (0.2, 0.15)


def clustered_split(df: DataFrame, cluster: str, shares: dict[str, float], least: int = 2, most: int | None = None, seed: int = 42) -> DataFrame:
    """(cluster, n, assigned): whole clusters, in hash order, to each split of `shares` until it holds its share of the rows; the rest is train.

    Clusters of fewer than `least` rows or more than `most` stay in train. The last cluster dealt to a split may carry it over
    its share by that cluster's size. Rows without a cluster are left out. Sizes are added up by `value_totals`, so clusters
    may be as many as rows.
    """
    if any(s < 0 for s in shares.values()) or sum(shares.values()) >= 1:
        raise ValueError("shares must not be negative and must add up to less than 1")
    if least < 1 or (most is not None and most < least):
        raise ValueError("least must be positive and at most `most`")
    sizes = df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    fits = (F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most)
    place = F.conv(F.substr(hash_order(F.col(cluster), seed), F.lit(1), F.lit(12)), 16, 10).cast("long")
    dealt = sizes.withColumn("_place", place).withColumn("_fits", fits)
    before = value_totals(dealt.where("_fits"), [], "_place", {"_n": F.sum("n")}).select("_place", "_n_before")
    choice, edge = F.lit("train"), sum(shares.values())
    for name, share in reversed(shares.items()):
        choice = F.when(F.col("_n_before") < F.lit(round(edge, 9)).cast("decimal(12,9)") * total, F.lit(name)).otherwise(choice)
        edge -= share
    return dealt.join(before, "_place", "left").select(cluster, "n", F.when(F.col("_fits"), choice).otherwise("train").alias("assigned"))


def designed_split(df: DataFrame, level: str, least: int = 2, most: int | None = None, seed: int = 0) -> DataFrame:
    """(cluster, n, assigned) of the named clustered design of a level: genus is the first word of the species, taxa what stands before an id's dot.

    The other levels are columns. Each level has its own default shares of validation and test.
    """
    if level not in CLUSTER_LEVELS:
        raise ValueError(f"no cluster level {level}")
    column = {"genus": F.regexp_extract("species", "^([^_ ]+)", 1), "taxa": taxon_of(F.col("genome_id"))}.get(level, F.col(level) if level in df.columns else None)
    if column is None:
        raise ValueError(f"no column {level}")
    val, test = DESIGN_SHARES.get(level, OTHER_SHARES)
    return clustered_split(df.select(column.alias("cluster")), "cluster", {"validation": val, "test": test}, least, most, seed)


def species_holdout(df: DataFrame, test: list[str], validation: list[str] = (), species: str = "species") -> DataFrame:
    """Rows with `assigned`: whole species held out for test and validation, all others (and null ones) train. No test species, or one in both, is refused."""
    if not test:
        raise ValueError("no species to hold out")
    if both := sorted(set(test) & set(validation)):
        raise ValueError(f"held out twice: {', '.join(both)}")
    return df.withColumn("assigned", F.when(F.col(species).isin(*validation), "validation").when(F.col(species).isin(*test), "test").otherwise("train"))


def natural_extraction(df: DataFrame, used: DataFrame, target: int = 100, most_species: int = 20, overlap: int = 2, cap: int = 75, seed: int = 42) -> DataFrame:
    """(split, species, genome_id) drawn without regard to labels from (genome_id, species, split), used genomes left out.

    train: max(1, target // min(species of train, most_species)) genomes a species. Overlapped splits: up to `overlap` a species
    of those drawn for train, `cap` in all. Outside splits: `cap` genomes of species that train has not. Draws follow the hash
    order; every rank is pruned to its quota in each task before rows meet.
    """
    rows = df.select("split", "species", "genome_id").dropna().distinct()
    held = rows.where("split = 'train'").select("species").distinct()
    fresh = rows.join(used.select("genome_id").where("genome_id is not null").distinct(), "genome_id", "left_anti").withColumn("_h", hash_order(F.col("genome_id"), seed))
    order = [F.col("_h"), F.col("genome_id"), F.col("species")]
    kinds = held.agg(F.greatest(F.least(F.count("*"), F.lit(most_species)), F.lit(1)).alias("_k")).scalar()
    train = top_per_group(fresh.where("split = 'train'"), ["species"], order, max(target, 1)).where(F.col("rank") <= F.greatest(F.floor(F.lit(target) / kinds), F.lit(1)))
    near = fresh.where(F.col("split").isin("val_overlapped", "test_overlapped")).join(train.select("species").distinct(), "species", "left_semi")
    near = top_per_group(top_per_group(near, ["split", "species"], order, overlap).drop("rank"), ["split"], order, cap)
    far = top_per_group(fresh.where(F.col("split").isin(*OUTSIDE_SPLITS)).join(held, "species", "left_anti"), ["split"], order, cap)
    names = ["split", "species", "genome_id"]
    return train.select(*names).unionByName(near.select(*names)).unionByName(far.select(*names))


def in_plan_order(df: DataFrame, column: str, plan: list[str]) -> DataFrame:
    """Rows with `priority`, the place (from 1) of their value in a plan, in that order; values that are not in it come last, with null."""
    place = F.nullif(F.array_position(F.array(*[F.lit(x) for x in plan]), F.col(column)), F.lit(0))
    return df.withColumn("priority", place).orderBy(F.asc_nulls_last("priority"), column)


def join_losses(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row on an inner join: rows of the left, those whose key the right has, and those that are lost; null keys are lost."""
    known = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    kept = F.count("_known")
    return left.select(key).join(known, key, "left").agg(F.count("*").alias("n_rows"), kept.alias("n_kept"), (F.count("*") - kept).alias("n_lost"))


def species_report(df: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Per group its genomes, species, resistant and susceptible rows, the rate as text with one decimal, and the most frequent species by name."""
    r, s = F.count_if(F.col("phenotype") == 1), F.count_if(F.col("phenotype") == 0)
    counts = df.groupBy(*by).agg(F.count_distinct("genome_id").alias("n_genomes"), F.count_distinct("species").alias("n_species"), r.alias("n_resistant"), s.alias("n_susceptible"))
    rate = F.round(F.try_divide(100.0 * F.col("n_resistant"), F.col("n_resistant") + F.col("n_susceptible")), 1)
    return counts.join(joined_names(df, by, "species", most), by).withColumn("rate", F.concat(rate.cast("decimal(5,1)").cast("string"), F.lit("%")))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Fold 0 to k-1 of each row, dealt in hash order within a label; buckets keep a large label off one task."""
    hashed = df.withColumn("_h", hash_order(F.col(key), seed))
    return numbered(hashed, [label], ["_h", key], F.substr(F.col("_h"), F.lit(1), F.lit(3)), "_rank").withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_h", "_rank")


def repeated_folds(df: DataFrame, label: str, key: str, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """Rows with `repeat` and `fold`: stratified folds dealt anew for each repeat, all repeats in one pass."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    hashed = each.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), (F.col("repeat") + seed).cast("string"))))
    return numbered(hashed, ["repeat", label], ["_h", key], F.substr(F.col("_h"), F.lit(1), F.lit(3)), "_rank").withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int")).drop("_h", "_rank")


def registry_rounds(candidates: DataFrame, registry: DataFrame, key: str, name: str) -> DataFrame:
    """Rows for the registry: candidates it does not hold yet, with the next round."""
    nxt = registry.agg(F.coalesce(F.max("extraction_round"), F.lit(0)) + 1).scalar()
    return candidates.select(key).distinct().join(registry, key, "left_anti").select(key, F.lit(name).alias("subset_name"), nxt.alias("extraction_round"))


def inverse_weights(df: DataFrame, group: str) -> DataFrame:
    """Weight 1 / (groups x rows of the group) of a group's rows; all weights add up to 1."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    groups = counts.agg(F.count("*")).scalar()
    return counts.select(group, "n", F.round(1.0 / (groups * F.col("n")), 9).alias("weight"))


