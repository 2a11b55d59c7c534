import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as sc
from strandline.operators import metrics as met
from strandline.operators import relational as rel
from strandline.operators import sequences as seq
from strandline.operators import statistics as sta
from strandline.operators import vectors as vec
from strandline.operators.ordering import value_summary, value_totals
from strandline.sources import files as src


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 1000])
def test_value_totals_against_brute_force(spark, least):
    draw = random.Random(3)
    data = [(g, draw.choice([None, float("nan"), round(draw.gauss(0, 1), 1), draw.random()]), draw.randint(0, 4)) for g in (None, "a", "a", "a", "b") for _ in range(300)]
    df = spark.createDataFrame(data, "g string, x double, w long")
    key = lambda x: (-1, 0.0) if x is None else (1, 0.0) if math.isnan(x) else (0, x)
    for r in value_totals(df, ["g"], "x", {"w": F.sum("w"), "n": F.count("*")}, 8, least).collect():
        mine = [(key(x), w) for g, x, w in data if g == r["g"]]
        at = key(r["x"])
        assert r["w"] == sum(w for x, w in mine if x == at) and r["n"] == sum(1 for x, _ in mine if x == at)
        assert r["w_before"] == sum(w for x, w in mine if x < at) and r["n_before"] == sum(1 for x, _ in mine if x < at)
        assert r["w_total"] == sum(w for _, w in mine) and r["n_total"] == len(mine)
    assert value_totals(df.where("false"), ["g"], "x", {"n": F.count("*")}).count() == 0


def test_percentiles_against_numpy(spark):
    draw = random.Random(5)
    data = [(g, draw.choice([draw.gauss(0, 5), float(draw.randint(-2, 2))])) for g in ("a", "b") for _ in range(700)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(data, "g string, x double")
    points = [0.0, 0.25, 0.5, 0.95, 0.999, 1.0]
    got = {r["g"]: r for r in value_summary(df, ["g"], F.col("x"), points, 100).collect()}
    for g in ("a", "b", "one", None):
        mine = [x for k, x in data if k == g]
        assert list(got[g]["p"]) == pytest.approx(list(np.quantile(mine, points)))
        assert (got[g]["n"], got[g]["mean"], got[g]["std_pop"], got[g]["min"], got[g]["max"]) == pytest.approx((len(mine), np.mean(mine), np.std(mine), min(mine), max(mine)))
    assert got["a"]["std_samp"] == pytest.approx(np.std([x for k, x in data if k == "a"], ddof=1)) and got["one"]["std_samp"] is None
    assert got["none"]["n"] == 0 and got["none"]["mean"] is None and set(got["none"]["p"]) == {None}
    empty = value_summary(df.where("false"), [], F.col("x"), [0.5]).first()
    assert empty["n"] == 0 and empty["p"] == [None]
    whole = sta.percentiles(df, [], "x", [0.5]).first()[0]
    assert whole == pytest.approx(float(np.median([x for _, x in data if x is not None])), abs=1e-6)
    assert sta.percentiles(df.where("g = 'none'"), ["g"], "x", [0.5]).first()["p0_5"] is None


def test_score_steps_keep_ties_together(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.5), ("a", 0, 0.1), ("a", 2, 0.1), ("a", 1, None)], "g string, y_true int, y_score double")
    got = rows_of(met.score_steps(df, ["g"]), "y_score", "p", "n", "tp", "fp", "pos", "neg")
    assert got == [(0.1, 0, 1, 2, 2, 2, 2), (0.5, 1, 0, 2, 1, 2, 2), (0.9, 1, 1, 1, 1, 2, 2)]


def test_clustered_split_keeps_clusters_whole_and_shares(spark):
    draw = random.Random(1)
    data = [(f"c{i}",) for i in range(400) for _ in range(draw.randint(1, 9))] + [(None,)] * 50 + [("giant",)] * 900
    df = spark.createDataFrame(data, "c string")
    got = {r["c"]: (r["n"], r["assigned"]) for r in rel.clustered_split(df, "c", {"validation": 0.2, "test": 0.15}, 2, 100).collect()}
    total = sum(n for n, _ in got.values())
    assert total == len(data) - 50 and got["giant"] == (900, "train")
    assert all(a == "train" for n, a in got.values() if n < 2)
    for name, share in (("validation", 0.2), ("test", 0.15)):
        assert abs(sum(n for n, a in got.values() if a == name) - share * total) <= 9
    assert rel.clustered_split(df.where("false"), "c", {"validation": 0.2}).count() == 0
    for bad in ({"a": -0.1}, {"a": 0.6, "b": 0.4}):
        with pytest.raises(ValueError):
            rel.clustered_split(df, "c", bad)
    with pytest.raises(ValueError):
        rel.clustered_split(df, "c", {"a": 0.1}, 5, 4)


def test_designs_and_holdout(spark):
    df = spark.createDataFrame([("ab_cd", "1.1"), ("ab_ef", "1.2"), ("gh_ij", "2.5"), (None, "3")], "species string, genome_id string")
    assert rows_of(rel.designed_split(df, "genus"), "cluster", "n")[:2] == [("ab", 2), ("gh", 1)]
    assert rows_of(rel.designed_split(df, "taxa", 1), "cluster", "n") == [("1", 2), ("2", 1), ("3", 1)]
    for level in ("family", "phylogeny"):
        with pytest.raises(ValueError):
            rel.designed_split(df, level)
    held = rows_of(rel.species_holdout(df, ["gh_ij"], ["ab_cd"]), "genome_id", "assigned")
    assert held == [("1.1", "validation"), ("1.2", "train"), ("2.5", "test"), ("3", "train")]
    for test, val in (([], ["x"]), (["x"], ["x"])):
        with pytest.raises(ValueError):
            rel.species_holdout(df, test, val)


def test_natural_extraction(spark):
    data = [("train", f"s{i}", f"t{i}.{j}") for i in range(30) for j in range(10)]
    data += [(x, f"s{i}", f"{x}{i}.{j}") for x in ("val_overlapped", "test_outside") for i in range(25, 60) for j in range(6)]
    df = spark.createDataFrame(data * 2, "split string, species string, genome_id string")
    used = spark.createDataFrame([("t0.1",), (None,)], "genome_id string")
    got = rows_of(rel.natural_extraction(df, used), "split", "species", "genome_id")
    count = lambda x, s=None: sum(1 for r in got if r[0] == x and s in (None, r[1]))
    assert count("train") == 150 and count("train", "s3") == 5 and ("train", "s0", "t0.1") not in got
    assert count("val_overlapped") == 10 and count("val_overlapped", "s29") == 2
    assert count("test_outside") == 75 and not any(r[1] in {f"s{i}" for i in range(30)} for r in got if r[0] == "test_outside")
    assert rel.natural_extraction(df.where("false"), used).count() == 0


def test_folds_are_even_in_each_repeat(spark):
    df = spark.range(103).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    n = rel.repeated_folds(df, "y", "id", 5, 2).groupBy("repeat", "y", "fold").count().collect()
    assert len(n) == 20 and all(r["count"] in ((5, 6) if r["y"] else (15, 16)) for r in n)
    folds = {(r["repeat"], r["id"]): r["fold"] for r in rel.repeated_folds(df, "y", "id", 5, 2).collect()}
    assert any(folds[0, i] != folds[1, i] for i in range(103))


def test_reports(spark):
    df = spark.createDataFrame([("b", "x", 1, "1"), ("b", "x", 0, "1"), ("b", "y", 1, "2"), ("z", "y", 0, "3")], "split string, species string, phenotype int, genome_id string")
    got = rows_of(rel.species_report(df, ["split"]), "split", "n_genomes", "n_species", "n_resistant", "n_susceptible", "names", "n_more", "rate")
    assert got == [("b", 2, 2, 2, 1, "x (2); y (1)", 0, "66.7%"), ("z", 1, 1, 0, 1, "y (1)", 0, "0.0%")]
    losses = rel.join_losses(spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "genome_id string"), df, "genome_id").first()
    assert tuple(losses) == (4, 2, 2)
    order = rel.in_plan_order(df.select("split").distinct().unionByName(spark.createDataFrame([("q",)], "split string")), "split", ["z", "b"]).collect()
    assert [(r["split"], r["priority"]) for r in order] == [("z", 1), ("b", 2), ("q", None)]


def test_matrix_summary_and_stages(spark):
    cells = spark.createDataFrame([(0, 0.0), (0, 2.0), (1, 4.0), (1, 8.0)], "dim int, x double")
    r = sta.matrix_summary(cells, "dim", "x").first()
    assert (r["mean_low"], r["mean_high"], r["std_low"], r["std_high"], r["min"], r["max"], r["median"], r["sparsity"]) == (1, 6, 1, 2, 0, 8, 3, 0.25)
    e = spark.createDataFrame([(0, "pre", -1.0), (0, "pre", 3.0), (0, "post", 8.0), (1, "pre", 1.0), (1, "other", 1.0)], "layer int, s string, x double")
    got = {r["layer"]: r for r in sta.stage_decomposition(e, "layer", "s", "x", ["pre", "mlp", "post"]).collect()}
    assert (got[0]["pre_mean"], got[0]["pre_max"], got[0]["gain_mean"], got[0]["mlp_max"]) == (2, 3, 4, None)
    assert got[0]["gain_max"] == pytest.approx(8 / 3, abs=1e-6) and got[1]["gain_max"] is None
    leaks = rows_of(sta.mask_leak(e.withColumn("ok", F.col("s") == "other"), ["layer"], F.col("ok"), "x"), "layer", "max_padded", "leaks")
    assert leaks == [(0, 8.0, True), (1, 1.0, True)]


def test_permuted_letters_and_alphabets(spark):
    texts = ["ACGTTGCA" * 40, "A", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(seq.permuted(F.col("t"))).collect()]
    assert got[1:] == ["A", "", None] and sorted(got[0]) == sorted(texts[0]) and got[0] != texts[0]
    df = spark.createDataFrame([("a", "AUCG"), ("b", "ATCG"), ("c", "")], "k string, t string")
    assert rows_of(seq.sequence_errors(df, "k", "t", 1, 9, seq.ALPHABETS["rna"]), "k", "error") == [("b", "alphabet"), ("c", "empty")]


def test_axes_of_both_kinds_keep_distances():
    x = np.random.default_rng(2).normal(size=(40, 64))
    for axes in (vec.gaussian_axes(64, 256), vec.sparse_axes(64, 256)):
        ratio = np.linalg.norm(x @ axes.T, axis=1) / np.linalg.norm(x, axis=1)
        assert ratio.mean() == pytest.approx(1, abs=0.05) and ratio.std() < 0.12


def test_ids_of_data_files(spark):
    names = ["d/1.5_pca_stats_dim64.csv", "1.5_mr_win10_s5.npz", "x/1.6_pooled_embeddings.npz", "1.7_embeddings.hdf5", "1.8.h5", "1_8.h5", "1.9.fna", "", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "p string").select(sc.id_of_data_file(F.col("p"))).collect()]
    assert got == ["1.5", "1.5", "1.6", "1.7", "1.8", None, None, None, None]


def test_checked_and_listed_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n" + "1\t2\n" * 9)
    (tmp_path / "b.csv").write_text("x,y\n")
    (tmp_path / "c.h5").write_text("12345")
    (tmp_path / "d.hdf5").write_text("123")
    (tmp_path / "e.h5").write_text("")
    assert src.checked_file(spark, str(tmp_path / "a.tsv"), ("x", "y")).count() == 5
    for name, columns in (("b.csv", ()), ("c.h5", ()), ("gone.csv", ()), ("a.tsv", ("z",))):
        with pytest.raises(ValueError):
            src.checked_file(spark, str(tmp_path / name), columns)
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in src.list_files(spark, str(tmp_path)).collect()] == [("c.h5", 5), ("d.hdf5", 3)]  # no empty file


def test_write_missing_and_path_lists(spark, tmp_path):
    out = str(tmp_path / "features")
    src.write_missing(spark.createDataFrame([("1", "train", 1.0), ("2", "test", 2.0)], "id string, split string, x double"), out, "id", ("split",))
    again = spark.createDataFrame([("2", "test", 9.0), ("3", "train", 3.0)], "id string, split string, x double")
    src.write_missing(again, out, "id", ("split",))
    assert rows_of(spark.read.parquet(out), "id", "x") == [("1", 1.0), ("2", 2.0), ("3", 3.0)]
    src.write_missing(again, out, "id", ("split",), overwrite=True)
    assert rows_of(spark.read.parquet(out), "id", "x") == [("2", 9.0), ("3", 3.0)]
    src.write_path_list(spark.createDataFrame([("p/1", 4), (None, 5)], "sequence_path string, n int"), str(tmp_path / "list"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "list/paths")).collect()] == ["p/1"]
    assert spark.read.csv(str(tmp_path / "list/audit"), header=True).count() == 2
