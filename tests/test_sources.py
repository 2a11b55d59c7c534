import gzip

import numpy as np
import pytest

from strandline.sources import files as src
from strandline.streaming.landing import follow


def test_delimited_keeps_zeros_and_checks_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("genome_id,species,antibiotic,phenotype,partition_label,extra\n1280.10,s,a,1,train,x\n1.0,s,a,maybe,train,y\n")
    rows = src.read_manifest(spark, str(tmp_path / "m.csv")).collect()
    assert [(r["genome_id"], r["phenotype"], r["extra"]) for r in rows] == [("1280.10", 1, "x"), ("1.0", None, "y")]
    with pytest.raises(ValueError, match="nothing"):
        src.read_delimited(spark, str(tmp_path / "m.csv"), ["nothing"])


def test_labels_by_alias(spark, tmp_path):
    (tmp_path / "l.csv").write_text("genome_id,partition_label,antibiotic_label\n1.1,train,1\n")
    assert src.read_labels(spark, str(tmp_path / "l.csv")).first()["phenotype"] == 1


def test_fasta_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fna.gz", "wt") as f:
        f.write(">one\nacgt\r\nNN \n\n>two\nTT\n")
    df = src.fasta_sequences(src.read_fasta(spark, str(tmp_path)))
    assert df.first()["sequence"] == "ACGTNNTT"


def test_arrays_round_trip(spark, tmp_path):
    x = np.arange(6.0).reshape(3, 2)
    np.savez(tmp_path / "a.npz", X=x, spans=np.zeros((3, 2)))
    rows = src.read_arrays(spark, str(tmp_path)).orderBy("row").collect()
    np.testing.assert_array_equal([r["v"] for r in rows], x)


def test_stream_adds_each_key_once(spark, tmp_path):
    schema = "genome_id string, species string"
    land, out, check = (str(tmp_path / n) for n in ("land", "out", "check"))
    for rows in ([("1", "a"), ("2", "b")], [("2", "b"), ("3", "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(land)
        q = follow(spark, land, schema, out, check, lambda df: df, ["genome_id"])
        assert q.awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(out).select("genome_id").collect()) == ["1", "2", "3"]


def test_ids_by_alias(spark, tmp_path):
    (tmp_path / "i.csv").write_text("Name,GenomeID\nx,1.10\ny,1.10\nz,\nw, 2.0 \n")
    assert sorted(r[0] for r in src.read_ids(spark, str(tmp_path / "i.csv")).collect()) == ["1.10", "2.0"]
    (tmp_path / "n.csv").write_text("name\nx\n")
    with pytest.raises(ValueError, match="genomeid"):
        src.read_ids(spark, str(tmp_path / "n.csv"))


def test_subsets_keep_the_last_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("genome_id,label\n1.1,0\n2.2,1\n,1\n")
    (tmp_path / "b.csv").write_text("genome_id,label,species\n1.1,1,s\n1.1,1,s\n3.0,,t\n")
    got = {r["genome_id"]: (r["label"], r["species"]) for r in src.read_subsets(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv")]).collect()}
    assert got == {"1.1": ("1", "s"), "2.2": ("1", None), "3.0": (None, "t")}


def test_path_list(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a.fna\n\nb.fna\n a.fna\n")
    files = spark.createDataFrame([("a.fna",), ("a.fna",), (None,)], "sequence_path string")
    assert sorted(tuple(r) for r in src.read_path_list(spark, str(tmp_path / "p.txt"), files).collect()) == [("a.fna", True), ("b.fna", False)]


def test_sidecars(spark, tmp_path):
    (tmp_path / "1280.10_x.json").write_text('{"n_windows": 3,\n "mode": "rp"}')
    (tmp_path / "2.0.json").write_text("{broken")
    got = sorted(tuple(r) for r in src.read_sidecars(spark, str(tmp_path), "n_windows int, mode string").collect())
    assert got == [("1280.10", 3, "rp"), ("2.0", None, None)]


def test_delimited_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1.10", [1, 2], "a,b"), ("2.0", None, None)], "genome_id string, v array<int>, s string")
    src.write_delimited(df, str(tmp_path / "o"))
    assert sorted(map(tuple, src.read_delimited(spark, str(tmp_path / "o"), ["s"]).collect())) == [("1.10", "[1,2]", "a,b"), ("2.0", None, None)]
