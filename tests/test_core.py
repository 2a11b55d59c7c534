import importlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as sc
from strandline.functions.keys import key_form, known_split
from strandline.operators import metrics as met
from strandline.operators import relational as rel
from strandline.operators import sequences as seq
from strandline.operators import statistics as sta
from strandline.operators.ordering import numbered, running_total
from strandline.operators.skew import HeavyKeys, blocked_join, heavy_keys, keys_over_share, looked_up, resistance_by_key, skewed_aggregate

MANIFEST = "row_id long, genome_id string, species string, antibiotic string, phenotype int, partition_label string"


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_key_form(spark):
    df = spark.createDataFrame([(" Val--Outside\t",), ("__",), ("",), (None,), ("Ä b",)], "x string")
    assert [r[0] for r in df.select(key_form("x")).collect()] == ["val_outside", None, None, None, "b"]
    assert [r[0] for r in df.select(known_split("x")).collect()] == ["val_outside", None, None, None, None]


def test_phenotype_and_ids(spark):
    df = spark.createDataFrame([("Resistant", "23.20"), (" S ", "007.50"), ("intermediate", "abc"), (None, None), ("1", "5.00")], "p string, i string")
    got = df.select(sc.phenotype_of_text(F.col("p")).alias("p"), sc.numeric_id(F.col("i")).alias("i"), sc.taxon_of(F.col("i")).alias("t")).collect()
    assert [r["p"] for r in got] == [1, 0, None, None, 1]
    assert [r["i"] for r in got] == ["23.2", "7.5", "abc", None, "5.0"]
    assert [r["t"] for r in got] == ["23", "007", "abc", None, "5"]


def test_tokens_and_padding(spark):
    df = spark.createDataFrame([("ACGTN",), ("é",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(sc.byte_tokens(F.col("s"))).collect()]
    assert got == [[65, 67, 71, 84, 78], [195, 169], [], None]
    assert df.limit(1).select(sc.padded(sc.byte_tokens(F.col("s")), 7, 1)).first()[0] == [65, 67, 71, 84, 78, 1, 1]


def test_vector_normalisation(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert df.select(sc.l2_normalised(F.col("v"))).first()[0] == pytest.approx([0.6, 0.8])
    assert df.select(sc.layer_normalised(F.col("v"))).first()[0] == pytest.approx([-1, 1], abs=1e-4)


def test_running_total_against_brute_force(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("n"))
    rows = running_total(df, ["g"], ["id"], "n", name="before").collect()
    assert len(rows) == 5000
    for g in range(3):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: (r["before"], r["n"] == 0 and -1))
        assert sorted(r["before"] + r["n"] for r in mine)[-1] == sum(r["n"] for r in mine)
    ranks = running_total(df, ["g"], ["id"], name="rank").where("g = 1").select("rank").collect()
    assert sorted(r[0] for r in ranks) == list(range(len(ranks)))


def test_running_total_of_null_group_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id long")
    assert values(running_total(df, ["g"], ["id"], name="r"), "g", "r") == sorted([(None, 0), (None, 1), ("a", 0)], key=str)
    assert running_total(df.limit(0), ["g"], ["id"]).count() == 0


def skewed(spark):
    return spark.range(6000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 400).cast("string"))).alias("k"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 97).alias("v"), F.lit("x").alias("_heavy"), F.lit(1).alias("n_rows"),
    )


def test_skewed_aggregate_against_plain(spark):
    df = skewed(spark)
    got = skewed_aggregate(df, ["k"], {"total": F.col("v")}, "v", HeavyKeys(0.05, 8))
    plain = df.groupBy("k").agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.count_distinct("v").alias("n_distinct"))
    assert values(got, "k", "n_rows", "total", "n_distinct") == values(plain, "k", "n_rows", "total", "n_distinct")
    assert {r["k"] for r in got.where("heavy").collect()} == {"hot", None}


def test_heavy_keys_are_bounded(spark):
    how = HeavyKeys(0.1)
    assert heavy_keys(skewed(spark), ["k"], how).count() <= how.most
    assert heavy_keys(skewed(spark).limit(0), ["k"], how).count() == 0


def test_resistance_by_key_edges(spark):
    rows = [(1, "g1", "A b", "X", 1, "train"), (1, "g1", "A b", "X", 1, "train"), (2, "g2", "a_B", "x ", 0, None), (3, None, "a b", "x", 9, "train"), (4, "g4", " ", "x", 1, "train"), (5, "g5", "c", None, 1, "train"), (6, "g6", "d", "y", None, "train")]
    df = spark.createDataFrame(rows, MANIFEST)
    got = values(resistance_by_key(df), "species", "antibiotic", "n_rows", "n_genomes", "n_resistant", "n_susceptible", "resistance_rate")
    assert got == [("a_b", "x", 4, 2, 2, 1, 0.666667), ("d", "y", 1, 1, 0, 0, None)]
    assert resistance_by_key(df.limit(0)).count() == 0
    assert values(keys_over_share(resistance_by_key(df), ["species"], "0.2"), "species") == [("a_b",)]


def test_manifest_rules(spark):
    assert rel.schema_status(["genome_id", "species", "phenotype"])["required_missing"] == ["antibiotic", "partition_label"]
    rows = [(1, "g", "s", "a", 1, "train"), (2, "g", "s", "a", 7, "train"), (3, " ", "s", "a", 0, "train"), (4, "g", None, "a", 0, "train"), (5, "g", "s", "a", None, "train")]
    assert values(rel.row_errors(spark.createDataFrame(rows, MANIFEST)), "row_id", "error") == [(2, "phenotype"), (3, "genome_id"), (4, "species"), (5, "phenotype")]


def test_leakage_weights_purity(spark):
    df = spark.createDataFrame([("train", "A", 1), ("train", "A", 0), ("val_outside", "A", 1), ("val_outside", "B", 1), ("train", "C", 1)], "split string, species string, phenotype int")
    assert values(rel.outside_leakage(df), "split", "species") == [("val_outside", "A")]
    w = rel.inverse_weights(spark.createDataFrame([("A",), ("A",), ("B",)], "g string"), "g")
    assert values(w, "g", "weight") == [("A", 0.25), ("B", 0.5)]
    assert values(rel.purity(df, "species"), "species", "dominant") == [("A", "R")]


def test_two_tier_lookup_prefers_exact(spark):
    labels = spark.createDataFrame([("1.10", 0), ("1.1", 1)], "id string, y int")
    ids = spark.createDataFrame([("1.1",), ("1.100",), ("2",)], "id string")
    assert values(rel.two_tier_lookup(ids, labels, "id", "y"), "id", "y") == [("1.1", 1), ("1.100", 0), ("2", None)]


def test_samples_and_splits(spark):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    got = rel.sample_balanced(df, "y", "k", 100, 0.35)
    assert (got.where("y = 0").count(), got.where("y = 1").count()) == (35, 65)
    few = rel.sample_balanced(df.where("y = 1 or k < 10"), "y", "k", 60, 0.5)
    assert (few.where("y = 0").count(), few.where("y = 1").count()) == (7, 53)
    groups = df.withColumn("g", F.when(F.col("k") < 200, "a")).withColumn("y", F.when(F.col("k") % 50 != 1, F.col("y")))  # a null group, null labels
    sizes = {(r["g"], r["y"]): r["count"] for r in rel.sample_balanced(groups, "y", "k", 20, 0.35, by=["g"]).groupBy("g", "y").count().collect()}
    assert sizes == {("a", 0): 7, ("a", 1): 13, (None, 0): 7, (None, 1): 13}
    assert rel.sample_balanced(groups.limit(0), "y", "k", 20, 0.35, by=["g"]).count() == 0
    assert values(rel.sample_per_group(df, ["y"], "k", 5), "k") == values(rel.sample_per_group(df, ["y"], "k", 5), "k")
    folds = rel.stratified_folds(df, "y", "k", 5).groupBy("y", "fold").count().collect()
    assert {(r["y"], r["count"]) for r in folds} == {(0, 60), (1, 20)}
    assert rel.hash_split(df, "k", {"val": 0.2, "test": 0.1}).where("assigned = 'val'").count() == pytest.approx(80, abs=25)
    with pytest.raises(ValueError):
        rel.hash_split(df, "k", {"val": 0.9, "test": 0.1})


def test_metrics_on_known_rows(spark):
    df = spark.createDataFrame([("A", 1, 1, 0.9), ("A", 0, 1, 0.8), ("B", 0, 0, 0.1), ("B", 0, 0, 0.1)], "g string, y_true int, y_pred int, y_score double")
    got = {r["g"]: r for r in met.classification_summary(df, ["g"]).collect()}
    assert (got["A"]["accuracy"], got["B"]["accuracy"], got["A"]["recall"], got["B"]["mcc"]) == (0.5, 1.0, 1.0, 0.0)
    rank = {r["g"]: r for r in met.ranking_summary(df, ["g"]).collect()}
    assert rank["A"]["auroc"] == 1.0 and rank["B"]["auroc"] is None and rank["A"]["auprc"] == 1.0
    assert met.classification_summary(df.limit(0), ["g"]).count() == 0


def test_auroc_counts_ties_half(spark):
    df = spark.createDataFrame([("g", 1, 0.5), ("g", 0, 0.5), ("g", 1, 0.7), ("g", 0, 0.9)], "g string, y_true int, y_score double")
    assert met.ranking_summary(df, ["g"]).first()["auroc"] == pytest.approx((0.5 + 0 + 1 + 0) / 4)


@pytest.mark.parametrize(
    "length, expected",
    [(0, []), (100, [(0, 100)]), (2048, [(0, 2048)]), (3072, [(0, 2048), (1024, 3072)]), (5000, [(0, 2048), (1024, 3072), (2048, 4096), (2952, 5000)])],
)
def test_spans(spark, length, expected):
    got = spark.range(1).select(seq.spans(F.lit(length), 2048, 1024)).first()[0]
    assert [tuple(x) for x in got] == expected


@pytest.mark.parametrize("n", [1, 5, 16, 17, 24, 40, 43])
def test_windows_of_matches_spans(spark, n):
    tokens = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    got = values(seq.windows_of(tokens, "k", 16, 8), "start", "end", "t")
    spans = spark.range(1).select(seq.spans(F.lit(n), 16, 8)).first()[0]
    assert got == sorted(((s, e, t) for s, e in spans for t in range(s, e)), key=str)


def test_mean_pool_refuses_ragged(spark):
    df = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0])], "k string, v array<double>")
    assert seq.mean_pool(df, ["k"], "v", 2).first()["pooled"] == [2.0, 4.0]
    with pytest.raises(Exception, match="elements"):
        seq.mean_pool(df.unionByName(spark.createDataFrame([("a", [1.0])], df.schema)), ["k"], "v", 2).collect()


def test_chi_square(spark):
    df = spark.createDataFrame([(True, 1)] * 12 + [(True, 0)] * 5 + [(False, 1)] * 7 + [(False, 0)] * 9, "g boolean, y int")
    assert sta.chi_square_yates(df, "g", "y").first()["chi2"] == pytest.approx(33 * (abs(12 * 9 - 5 * 7) - 33 / 2) ** 2 / (17 * 16 * 19 * 14), abs=1e-6)


def test_all_queries_run_without_llm_imports():
    """Nothing outside strandline.llm imports it."""
    import pathlib

    root = pathlib.Path(rel.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "strandline.llm" not in p.read_text(), p
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_numbered_matches_a_plain_sort(spark):
    r = random.Random(1)
    rows = [(g, r.randrange(40), i) for i, g in enumerate([None] * 50 + ["hot"] * 400 + ["a", "b"])] + [("a", None, 999)]
    df = spark.createDataFrame(rows, "g string, at int, id int").repartition(5)
    got = {(x["g"], x["id"]): x["t"] for x in numbered(df, ["g"], ["at", "id"], F.floor(F.col("at") / 10)).collect()}
    for g in {x[0] for x in rows}:
        order = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[g, x[2]] for x in order] == list(range(len(order)))
    assert numbered(df.limit(0), ["g"], ["at"], F.col("at")).count() == 0


def test_random_windows(spark):
    df = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "ACG"), ("c", None), ("d", "ACGT")], "k string, s string")
    got = seq.random_windows(df, "k", "s", 5, 4).collect()
    text = {"a": "ACGTACGTAC", "d": "ACGT"}
    assert {x["k"]: 5 for x in got} == {"a": 5, "d": 5} and len(got) == 10
    assert all(text[x["k"]][x["start"] : x["start"] + 4] == x["window"] and len(x["window"]) == 4 for x in got)


def test_tails(spark):
    df = spark.createDataFrame([("a", float(2**i)) for i in range(20)] + [("b", 8388608.0), ("b", -16777216.0), ("b", 0.0), ("c", None)], "g string, x double")
    hits = {x["g"]: (x["n_hits"], x["hit"]) for x in sta.constant_hits(df, ["g"], "x").collect()}
    assert hits == {"a": (0, False), "b": (2, True), "c": (0, None)}
    shape = {x["g"]: x for x in sta.tail_shape(df, ["g"], "x").collect()}
    tail = [i * math.log(2) for i in range(10, 20)]
    assert shape["a"]["hill"] == pytest.approx(1 / (sum(tail) / 10 - tail[0]), abs=1e-6) and shape["b"]["hill"] == 0 and shape["a"]["k"] == 10
    ratio = {x["g"]: x for x in sta.tail_ratio(df, ["g"], "x").collect()}
    assert ratio["a"]["max"] == 524288 and ratio["c"]["tail_ratio"] is None
    steps = sta.trajectory(spark.createDataFrame([(0, 1, 2.0), (0, 2, 5.0)], "t int, layer int, x double"), "t", "layer", "x").orderBy("layer").collect()
    assert [x["change"] for x in steps] == [None, 3.0]


def test_each_group_first(spark):
    df = spark.createDataFrame([("a", f"a{i}") for i in range(9)] + [("b", "b0"), ("c", "c0"), (None, "n0")], "g string, id string")
    got = rel.sample_each_group_first(df, "g", "id", 5).collect()
    assert len(got) == 5 and {x["g"] for x in got} == {"a", "b", "c", None}
    assert rel.sample_each_group_first(df, "g", "id", 2).count() == 2 and rel.sample_each_group_first(df.limit(0), "g", "id", 2).count() == 0


def test_padded_windows_and_selected_stats(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(5)] + [("b", 0, None)], "k string, t long, x double")
    got = {(x["k"], x["window_idx"]): x["series"] for x in seq.padded_windows(df, "k", "x", 4).collect()}
    assert got == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 0, 0, 0], ("b", 0): [None, 0, 0, 0]}
    stats = seq.selected_stats(df, ["k"], "x", ["std", "median", "mean"])
    assert stats.columns == ["k", "mean", "std", "median"] and {x["k"]: x["median"] for x in stats.collect()} == {"a": 2.0, "b": None}
    with pytest.raises(ValueError):
        seq.selected_stats(df, ["k"], "x", ["mode"])


@pytest.mark.parametrize("block", [4, 7, 1 << 16])
def test_kmer_counts_against_a_plain_loop(spark, block):
    texts = [("a", "ACGTNNacgtaCC"), ("a", "ACGTNNacgtaCC"), ("b", ""), ("c", None), ("d", "NNN"), ("e", "G"), (None, "AC"), ("long", "ACGGT" * 500)]
    want = Counter()
    for key, s in texts:
        for k in (1, 2, 3):
            for i in range(len(s or "") - k + 1):
                w = s[i : i + k].upper()
                if set(w) <= set("ACGT"):
                    want[key, w] += 1
    df = spark.createDataFrame([(*t, 7) for t in texts], "key string, text string, n int")
    got = {(r["key"], r["kmer"]): r["n"] for r in seq.kmer_counts(df, "key", "text", block=block).collect()}
    assert got == dict(want)
    assert seq.kmer_counts(df.limit(0), "key", "text").count() == 0


def test_quota_plan_and_sample(spark):
    rows = [("a", 0, i) for i in range(10)] + [("a", 1, 100 + i) for i in range(50)] + [("b", 1, 200 + i) for i in range(3)] + [("b", None, 300), ("c", 1, 400)]
    df = spark.createDataFrame(rows, "g string, y int, id long")
    targets = spark.createDataFrame([("a", 40, 0.35), ("b", 10, 0.5), ("none", 5, None)], "g string, target long, share_of_zero double")
    plan = rel.quota_plan(df, "g", "y", targets)
    assert sorted((r["g"], r["n_zero"], r["n_one"]) for r in plan.collect()) == [("a", 10, 30), ("b", 0, 3), ("none", 0, 0)]
    got = rel.sample_planned(df, "g", "y", "id", plan).collect()
    assert Counter((r["g"], r["y"]) for r in got) == {("a", 0): 10, ("a", 1): 30, ("b", 1): 3} and len({r["id"] for r in got}) == 43
    assert rel.sample_planned(df.limit(0), "g", "y", "id", plan).count() == 0


@pytest.mark.parametrize("kind", ["inner", "left"])
def test_looked_up_equals_a_join_whatever_the_skew(spark, kind):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(200)] + [("gone", 1), (None, 2), (None, 3)], "k string, i int")
    values = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)] + [("other", 9)], "k string, v int")
    got, want = (sorted(map(str, df.select("k", "i", "v").collect())) for df in (looked_up(rows, "k", values, kind, least=0), rows.join(values, "k", kind)))
    assert got == want
    assert looked_up(rows.limit(0), "k", values, kind, least=-1).count() == 0


@pytest.mark.parametrize("size", [1, 3, 512])
def test_blocked_join_equals_a_join(spark, size):
    left = spark.createDataFrame([("hot", i) for i in range(30)] + [("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(20)] + [("a", 5), ("a", 5), ("c", 2), (None, 3)], "k string, y int")
    got, want = (sorted(map(str, df.select("k", "x", "y").collect())) for df in (blocked_join(left, right, "k", size), left.join(right, "k")))
    assert got == want
