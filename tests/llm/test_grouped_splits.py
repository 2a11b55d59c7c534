import random

import pytest
from pyspark.sql import functions as F

from strandline.llm import grouped_splits as gs

MANIFEST = "genome_id string, species string, partition_label string, root string, n int"
TARGETS = "split_name string, target_share double"
SHARES = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    used = []
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        a, b = find(u), find(v)
        if a != b:
            parent[a] = b
            used.append((u, v, w))
    return {x: find(x) for x in list(parent)}, used


@pytest.mark.parametrize("seed, n, m", [(1, 40, 30), (2, 30, 90), (3, 60, 59)])
def test_forest_is_minimum(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", rng.randrange(5)) for _ in range(m)]
    if seed == 3:
        edges = [(f"v{i:02d}", f"v{i + 1:02d}", i) for i in range(59)]  # a chain
    forest, roots = gs.spanning_forest(spark.createDataFrame(edges, "u string, v string, w long"))
    owner, used = union_find([e for e in edges if e[0] != e[1]])
    got = {r["vertex"]: r["root"] for r in roots.collect()}
    groups = lambda m: sorted(sorted(x for x in m if m[x] == r) for r in set(m.values()))
    assert groups(got) == groups(owner)
    rows = forest.collect()
    assert len(rows) == len(used) and sum(r["w"] for r in rows) == sum(w for *_, w in used)


def test_assignment_keeps_entities_whole_and_shares(spark):
    rng = random.Random(7)
    kind = [f"s{min(int(rng.expovariate(0.05)), 150)}" for _ in range(1500)]
    rows = [(f"g{i}", kind[i], rng.choice(["train", "val_outside"]), "x", 1) for i in range(1500) for _ in range(2)]
    entity = gs.entity_rows(spark.createDataFrame(rows, MANIFEST))
    membership, _ = gs.components(entity)
    got = {(r["entity_kind"], r["entity_key"]): r["split_name"] for r in gs.assign(entity, membership, spark.createDataFrame(SHARES, TARGETS)).collect()}
    assert all(got["genome", g] == got["species", s] for g, s, *_ in rows)
    train = sum(got["genome", g] == "train" for g, *_ in rows) / len(rows)
    assert train == pytest.approx(0.8, abs=0.03)


def test_small_components_are_dealt_in_proportion(spark):
    sizes = spark.range(20000).selectExpr("cast(id as string) as root", "1 + id % 3 as n")
    dealt = {r["split_name"]: r["n"] for r in gs.deal(sizes, spark.createDataFrame(SHARES, TARGETS)).groupBy("split_name").agg({"n": "sum"}).toDF("split_name", "n").collect()}
    total = sum(dealt.values())
    assert sum(1 for _ in dealt) == 3 and dealt["train"] / total == pytest.approx(0.8, abs=0.01) and dealt["test"] / total == pytest.approx(0.1, abs=0.01)


def test_breaks_nulls_and_repeats(spark):
    rows = [
        ("1.1", "A", "train"), ("1.1", "A", "val_outside"), ("1.10", "B b", "Train "), ("2", "b-B", "val_overlapped"), ("3", None, "train"), ("3", " ", "test_outside"),
        ("4", "C", "val_outside"), ("4", "C", "val_overlapped"), ("4", "C", "val_overlapped"), ("5", "C", "holdout"), (None, "D", "train"), (None, "D", "test_outside"), (None, None, "train"), ("6", "C", None),
    ]
    entity = gs.entity_rows(spark.createDataFrame([(*r, "k", 1) for r in rows], MANIFEST))
    membership, forest = gs.components(entity)
    got = sorted((r["entity_kind"], r["entity_key"]) for r in gs.breaks(forest).collect())
    assert got == [("genome", "1.1"), ("genome", "3"), ("species", "a"), ("species", "d")]
    assert gs.breaks(forest.where(F.col("w") > gs.TIES)).count() == 0  # they come from the forest and from nothing else
    root = {r["vertex"]: r["root"] for r in membership.collect()}
    assert root["g:1.1"] == root["s:a"] and root["g:1.10"] == root["g:2"] and len({*root.values()}) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_breaks_and_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    labels = ["train", "val_outside", "val_overlapped", "test_outside", "test_overlapped", "none", None]
    rows = [(rng.choice([None, *(f"g|{i}" for i in range(30))]), rng.choice([None, *(f"s{i}" for i in range(12))]), rng.choice(labels)) for _ in range(70)]
    entity = gs.entity_rows(spark.createDataFrame([(*r, "k", 1) for r in rows], MANIFEST))
    membership, forest = gs.components(entity)
    known = [r for r in rows if r[2] in labels[:5]]
    torn = {("genome", g) for g in {r[0] for r in known} - {None} if len({r[2].split("_")[0] for r in known if r[0] == g}) > 1}
    torn |= {("species", x) for x in {r[1] for r in known} - {None} if {"train"} < ({"train"} & {r[2] for r in known if r[1] == x}) | {"outside" for r in known if r[1] == x and r[2].endswith("outside")}}
    assert {(r["entity_kind"], r["entity_key"]) for r in gs.breaks(forest).collect()} == torn
    owner, used = union_find([(f"g:{g}", f"s:{x}", 0) for g, x, _ in rows if g and x])
    got = {r["vertex"]: r["root"] for r in membership.collect()}
    assert all((got[a] == got[b]) == (owner[a] == owner[b]) for a in owner for b in owner)
    assert forest.where(F.col("w") > gs.TIES).count() == len(used)


def test_reached_shares_and_oversized_components(spark):
    rows = [(f"g{i}", "big" if i < 60 else f"s{i}", "train", "k", 1) for i in range(100)]
    entity = gs.entity_rows(spark.createDataFrame(rows, MANIFEST))
    got = {r["split_name"]: r for r in gs.reached(entity, gs.components(entity)[0], spark.createDataFrame([("a", 0.5), ("b", 0.5)], TARGETS)).collect()}
    big = max(got.values(), key=lambda r: r["largest"])
    assert big["largest"] == 60 and big["too_large"] and sum(r["n_rows"] for r in got.values()) == 100 and sorted(r["n_rows"] for r in got.values()) == [40, 60]


def test_empty(spark):
    entity = gs.entity_rows(spark.createDataFrame([], MANIFEST))
    membership, forest = gs.components(entity)
    assert membership.count() == forest.count() == gs.breaks(forest).count() == 0
    assert gs.assign(entity, membership, spark.createDataFrame(SHARES, TARGETS)).count() == 0
    with pytest.raises(ValueError):
        gs.deal(spark.createDataFrame([], "root string, n long"), spark.createDataFrame([], TARGETS))
