"""Samples that match target shares of categories (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.keys import key_form, known_split, valid_phenotype
from strandline.operators.ordering import running_total
from strandline.runtime import cut, table

LEAF = ["partition_label", "species", "phenotype"]


def _decimal(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("decimal(12,6)")


def manifest_records(manifest: DataFrame) -> DataFrame:
    """Distinct (partition_label, species, phenotype, genome_id, antibiotic) of usable manifest rows, in key form.

    Rows with an unknown split, a blank species or antibiotic, a phenotype other than 0 and 1 or a null genome_id
    are no records; repeated rows count once.
    """
    return (
        manifest.select(
            known_split("partition_label").alias("partition_label"), key_form("species").alias("species"), valid_phenotype("phenotype").alias("phenotype"),
            "genome_id", key_form("antibiotic").alias("antibiotic"),
        )
        .dropna()
        .distinct()
    )


def tidy_targets(targets: DataFrame) -> DataFrame:
    """Targets per category in key form; spellings of one category are added up, the larger minimum holds."""
    return (
        targets.select(key_form("partition_label").alias("partition_label"), key_form("species").alias("species"), F.col("phenotype").cast("int").alias("phenotype"), _decimal("target_share").alias("target_share"), F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"))
        .dropna(subset=LEAF)
        .groupBy(*LEAF)
        .agg(F.sum(F.coalesce("target_share", F.lit(0))).cast("decimal(12,6)").alias("target_share"), F.max("min_rows").alias("min_rows"))
    )


def allocate(records: DataFrame, targets: DataFrame, fraction: str = "0.2") -> DataFrame:
    """Quota of every target category, handed down the tree partition -> species -> phenotype.

    A partition's sample has floor(fraction x distinct (genome_id, antibiotic)) rows. Every leaf requests `required`, the
    greater of ceil(share x sample) and min_rows, and gives what it can draw. What it cannot give is passed to its
    siblings (same species), what these cannot give to its cousins (same partition), in the order of the categories, up to
    what they have to spare; the rest is `unmet`. So each leaf's request is accounted for:
    required = own + from_siblings + from_cousins + unmet.
    The rows that rounding up and minima take beyond the sample then come back, rounding first, the rest from the leaves
    above their minimum in proportion. `quota` is what the leaf draws in the end.
    Further columns: available (distinct records of the category), drawable (records counted in one category only),
    elsewhere = rows the leaf has but that are drawn in a record's other category, shortfall = what it passed on less `elsewhere`.
    Only categories of the targets appear; partitions without targets are not sampled.
    """
    # a record with both phenotypes counts in both categories but is drawn from one, which its hash chooses
    record = ["partition_label", "genome_id", "antibiotic"]
    per_record = records.groupBy(*record).agg(F.array_sort(F.collect_set(F.struct("species", "phenotype"))).alias("_leaves"))
    places = per_record.withColumn("_drawn", F.expr("_leaves[pmod(xxhash64(genome_id, antibiotic), size(_leaves))]"))
    exploded = places.select("partition_label", F.explode("_leaves").alias("_leaf"), "_drawn", (F.col("_leaf") == F.element_at("_leaves", 1)).alias("_first"))
    # one pass gives a category's records and, as every record is counted once by its first category, the partition's
    counts = exploded.groupBy("partition_label", F.col("_leaf.species").alias("species"), F.col("_leaf.phenotype").alias("phenotype")).agg(
        F.count("*").alias("available"), F.count_if(F.col("_leaf") == F.col("_drawn")).alias("drawable"), F.count_if("_first").alias("_records")
    )
    counts = counts.withColumn("_size", F.sum("_records").over(Window.partitionBy("partition_label")))  # a row for each category
    sizes = counts.groupBy("partition_label").agg(F.floor(_decimal(F.lit(fraction)) * F.max("_size")).cast("long").alias("sample_size"))
    tree = tidy_targets(targets).join(sizes, "partition_label", "left").join(counts.drop("_size", "_records"), LEAF, "left").fillna(0, ["sample_size", "available", "drawable"])

    # windows below hold the target categories of one partition or species, never records
    whole = Window.partitionBy("partition_label")
    ordered = whole.orderBy("species", "phenotype")
    species = Window.partitionBy("partition_label", "species")
    t = tree.withColumn("required", F.greatest(F.ceil(F.col("target_share") * F.col("sample_size")).cast("long"), F.col("min_rows")))
    t = t.withColumn("own", F.least("required", "drawable")).withColumn("elsewhere", F.least("required", "available") - F.col("own"))
    t = t.withColumn("_lack", F.col("required") - F.col("own")).withColumn("_spare", F.col("drawable") - F.col("own")).withColumn("_given", F.lit(0).cast("long"))
    for level, name in ((species, "from_siblings"), (whole, "from_cousins")):
        before = lambda c: F.coalesce(F.sum(c).over(level.orderBy("species", "phenotype").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # noqa: B023, E731
        t = t.withColumn("_lacking", F.sum("_lack").over(level)).withColumn("_sparing", F.sum("_spare").over(level)).withColumn("_gives", before("_spare")).withColumn("_gets", before("_lack"))
        t = t.withColumn("_more", F.greatest(F.least(F.col("_spare"), F.col("_lacking") - F.col("_gives")), F.lit(0)))
        t = t.withColumn(name, F.greatest(F.least(F.col("_lack"), F.col("_sparing") - F.col("_gets")), F.lit(0)))
        t = t.withColumn("_lack", F.col("_lack") - F.col(name)).withColumn("_spare", F.col("_spare") - F.col("_more")).withColumn("_given", F.col("_given") + F.col("_more"))
    passed = F.col("from_siblings") + F.col("from_cousins") + F.col("unmet")
    t = t.withColumnRenamed("_lack", "unmet").withColumn("shortfall", passed - F.col("elsewhere"))
    # rounding: what a leaf's own rows exceed its part of the running sum of shares
    upto = F.sum("target_share").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    exact = F.floor(upto * F.col("sample_size")) - F.floor((upto - F.col("target_share")) * F.col("sample_size"))
    t = t.withColumn("_over", F.greatest(F.sum(F.col("own") + F.col("_given")).over(whole) - F.col("sample_size"), F.lit(0)))
    t = t.withColumn("_rounded", F.greatest(F.col("own") - F.greatest(exact.cast("long"), "min_rows"), F.lit(0)))
    earlier = F.coalesce(F.sum("_rounded").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_back", F.greatest(F.least(F.col("_rounded"), F.col("_over") - earlier), F.lit(0)))
    t = t.withColumn("quota", F.col("own") + F.col("_given") - F.col("_back")).withColumn("_over", F.col("_over") - F.sum("_back").over(whole)).withColumn("_room", F.greatest(F.col("quota") - F.col("min_rows"), F.lit(0)))
    room_upto, room = F.sum("_room").over(ordered.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_room").over(whole)
    back = F.least(F.col("_over"), room)
    share = lambda c: F.floor(F.try_divide((back * c).cast("decimal(38,0)"), room))
    t = t.withColumn("quota", F.col("quota") - F.coalesce(share(room_upto) - share(room_upto - F.col("_room")), F.lit(0)).cast("long"))
    return t.select(*LEAF, "target_share", "min_rows", "sample_size", "available", "drawable", "required", "own", "from_siblings", "from_cousins", "unmet", "elsewhere", "shortfall", "quota")


def draw(records: DataFrame, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The records whose permuted dense rank within their category is at most the category's quota.

    Every record stands in the one category it is drawn from, so none is drawn twice.
    """
    record = ["partition_label", "genome_id", "antibiotic"]
    leaves = records.groupBy(*record).agg(F.array_sort(F.collect_set(F.struct("species", "phenotype"))).alias("_leaves"))
    placed = leaves.withColumn("_leaf", F.expr("_leaves[pmod(xxhash64(genome_id, antibiotic), size(_leaves))]")).select(*record, "_leaf.species", "_leaf.phenotype")
    ranked = running_total(placed, LEAF, ["genome_id", "antibiotic"], seed=seed, name="_rank")
    return ranked.join(quotas.select(*LEAF, "quota"), LEAF).where("_rank < quota").drop("_rank", "quota")


def _records(spark, folder):
    return manifest_records(table(spark, folder, "tiny_manifest", ["partition_label", "species", "phenotype", "genome_id", "antibiotic"]))


def p1_found(spark, folder):
    """Categories whose request had to be passed on to siblings and cousins, or stayed unmet."""
    return allocate(_records(spark, folder), table(spark, folder, "sample_targets")).where("from_siblings + from_cousins + unmet > elsewhere").select(*LEAF)


def p1_sample(spark, folder):
    """The sample itself."""
    records = cut(_records(spark, folder))
    return draw(records, allocate(records, table(spark, folder, "sample_targets")))


def p1_report(spark, folder):
    """Of every category its need and supply, who filled the gap, what stays unmet, and the rows and share the sample really has."""
    records = cut(_records(spark, folder))
    quotas = cut(allocate(records, table(spark, folder, "sample_targets")))
    drawn = draw(records, quotas).groupBy(*LEAF).agg(F.count("*").alias("n_drawn"))
    share = F.round(F.coalesce(F.try_divide(F.col("n_drawn").cast("double"), F.col("sample_size")), F.lit(0.0)), 6)
    columns = [*LEAF, "sample_size", "available", "required", "own", "from_siblings", "from_cousins", "unmet", "shortfall", "quota"]
    return quotas.select(*columns, "target_share").join(drawn, LEAF, "left").fillna(0, ["n_drawn"]).select(*columns, "n_drawn", F.col("target_share").cast("double").alias("target_share"), share.alias("actual_share"))
