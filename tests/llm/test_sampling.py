import pytest

from strandline.llm import sampling as sam

MANIFEST = "genome_id string, species string, antibiotic string, phenotype int, partition_label string, quota int"
TARGETS = "partition_label string, species string, phenotype int, target_share double, min_rows int"


def rows(n, species, phenotype, split="train", start=0):
    return [(f"g{species}{i}", species, "amp", phenotype, split, 5) for i in range(start, start + n)]


def quotas(df):
    return {(r["species"], r["phenotype"]): r for r in df.collect()}


def test_shares_are_met_and_sample_is_exact(spark):
    m = spark.createDataFrame(rows(300, "A", 0) + rows(300, "A", 1, start=300) + rows(400, "B", 0), MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 0.25, 5), ("train", "A ", 1, 0.25, 5), ("Train", "b", 0, 0.5, 5)], TARGETS)
    records = sam.manifest_records(m)
    got = quotas(sam.allocate(records, t))
    assert {k: r["quota"] for k, r in got.items()} == {("a", 0): 50, ("a", 1): 50, ("b", 0): 100}
    assert all(r["shortfall"] == 0 and r["unmet"] == 0 for r in got.values())
    drawn = sam.draw(records, sam.allocate(records, t)).collect()
    assert len(drawn) == len({(r["genome_id"], r["antibiotic"]) for r in drawn}) == 200


def test_unmet_goes_to_siblings_then_cousins(spark):
    m = spark.createDataFrame(rows(2, "A", 0) + rows(30, "A", 1, start=2) + rows(468, "B", 0), MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 0.4, 1), ("train", "a", 1, 0.1, 1), ("train", "b", 0, 0.5, 1)], TARGETS)
    got = quotas(sam.allocate(sam.manifest_records(m), t))
    # 100 rows: 40 + 10 + 50 asked; a0 has 2, its sibling has 20 to spare, the cousin takes the other 18
    assert {k: r["quota"] for k, r in got.items()} == {("a", 0): 2, ("a", 1): 30, ("b", 0): 68}
    assert got["a", 0]["shortfall"] == 38 and got["a", 1]["shortfall"] == 0


def test_minimum_of_a_small_category_is_kept(spark):
    m = spark.createDataFrame(rows(50, "A", 0) + rows(450, "B", 0), MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 0.01, 10), ("train", "b", 0, 0.99, 10)], TARGETS)
    got = quotas(sam.allocate(sam.manifest_records(m), t))
    assert (got["a", 0]["quota"], got["b", 0]["quota"], got["a", 0]["required"]) == (10, 90, 10)


def test_a_record_with_both_phenotypes_is_drawn_once(spark):
    m = spark.createDataFrame(rows(40, "A", 0) + rows(40, "A", 1), MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 0.5, 1), ("train", "a", 1, 0.5, 1)], TARGETS)
    records = sam.manifest_records(m)
    plan = sam.allocate(records, t)
    assert {(r["available"], r["sample_size"]) for r in plan.collect()} == {(40, 8)}
    drawn = sam.draw(records, plan).collect()
    assert len(drawn) == len({r["genome_id"] for r in drawn}) == 8


def test_exact_decimals_nulls_repeats_and_empty(spark):
    bad = [(None, "A", "amp", 1, "train", 1), ("x", " ", "amp", 1, "train", 1), ("x", "A", None, 1, "train", 1), ("x", "A", "amp", None, "train", 1), ("x", "A", "amp", 2, "train", 1), ("x", "A", "amp", 1, "holdout", 1), ("x", "A", "amp", 1, None, 1)]
    m = spark.createDataFrame(rows(500, "A", 0) * 2 + bad, MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 0.07, None), ("train", "a", 1, 0.93, None), (None, "a", 1, 0.1, 1)], TARGETS)
    got = quotas(sam.allocate(sam.manifest_records(m), t))
    assert got["a", 0]["required"] == 7 and got["a", 0]["sample_size"] == 100  # 0.07 x 100 is 7 and not 8
    assert got["a", 1]["shortfall"] == 93
    none = quotas(sam.allocate(sam.manifest_records(m.limit(0)), spark.createDataFrame([("train", "a", 0, 0.5, 3)], TARGETS)))
    assert none["a", 0]["shortfall"] == 3 and none["a", 0]["quota"] == 0
    assert sam.allocate(sam.manifest_records(m), t.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 3])
def test_partition_without_target_gives_nothing(spark, n):
    m = spark.createDataFrame(rows(10, "A", 0, "val_outside") + rows(n, "A", 0), MANIFEST)
    t = spark.createDataFrame([("train", "a", 0, 1.0, 1)], TARGETS)
    records = sam.manifest_records(m)
    assert {r["partition_label"] for r in sam.draw(records, sam.allocate(records, t)).collect()} <= {"train"}
