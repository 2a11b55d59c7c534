"""Splits that keep related records together (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import OUTSIDE_SPLITS, key_form, known_split, split_group
from strandline.operators.ordering import running_total
from strandline.operators.skew import looked_up
from strandline.runtime import cut, table


def entity_rows(manifest: DataFrame) -> DataFrame:
    """Rows with the two entities they belong to, as vertices `g:<genome_id>` and `s:<species key>`, and the known split.

    A null genome_id or a blank species is no entity; a row with neither is left out, as nothing ties it.
    """
    return manifest.select(
        F.concat(F.lit("g:"), F.col("genome_id")).alias("genome"), F.concat(F.lit("s:"), key_form("species")).alias("species"), known_split("partition_label").alias("split")
    ).where("genome is not null or species is not null")


# Weights of links between the copies of one entity: they are lighter than any link by rows, so a minimum forest holds them all.
TEARS, TIES = -(1 << 62), -(1 << 61)


def entity_copies(rows: DataFrame) -> DataFrame:
    """(entity, side): every entity once for each side of the present labels its rows stand on.

    Sides of a genome are train, val and test; of a species train and outside, as it may stand in the overlapped splits
    beside either. Rows without a known split, and those of a species in overlapped splits, are on side `-`.
    """
    outside = F.when(F.col("split") == "train", "train").when(F.col("split").isin(*OUTSIDE_SPLITS), "outside")
    sides = F.array(F.struct(F.col("genome").alias("entity"), split_group(F.col("split")).alias("side")), F.struct(F.col("species").alias("entity"), outside.alias("side")))
    return rows.select(F.inline(sides)).where("entity is not null").select("entity", F.coalesce("side", F.lit("-")).alias("side")).distinct()


def entity_edges(rows: DataFrame) -> DataFrame:
    """Links (u, v, w) between copies of entities, each named `<side>|<entity>`; a lighter link binds more.

    Copies of one entity are linked to its first copy: with TEARS where both sides are labelled, which present labels should
    not do, else with TIES. A genome and a species that share rows are linked between their first copies, by as many rows as they share.
    """
    name = lambda side, entity: F.concat(side, F.lit("|"), entity)
    per = entity_copies(rows).groupBy("entity").agg(F.array_sort(F.collect_set("side")).alias("_s"))  # at most four sides
    # `-` sorts before the labelled sides, so the first labelled copy is the second one where `-` is there
    first = F.element_at("_s", F.when((F.col("_s")[0] == "-") & (F.size("_s") > 1), 2).otherwise(1))
    hubs = per.select("entity", "_s", first.alias("_hub"))
    copies = hubs.select("entity", "_hub", F.explode(F.array_remove(F.col("_s"), F.col("_hub"))).alias("_side"))
    identity = copies.select(name(F.col("_hub"), F.col("entity")).alias("u"), name(F.col("_side"), F.col("entity")).alias("v"), F.when(F.col("_side") == "-", TIES).otherwise(TEARS).cast("long").alias("w"))
    shared = rows.where("genome is not null and species is not null").groupBy("genome", "species").agg((-F.count("*")).alias("w"))
    hub = hubs.select("entity", name(F.col("_hub"), F.col("entity")).alias("_copy"))
    u, v = hub.toDF("genome", "u"), hub.toDF("species", "v")
    return identity.unionByName(looked_up(cut(shared.join(u, "genome")), "species", v).select("u", "v", "w"))


def _jump(parents: DataFrame, n: int) -> DataFrame:
    """Roots of all (c, p) pointers, of which there are at most n, doubling the reach of every pointer until none moves."""
    parents = parents.withColumn("o", F.col("p"))
    while True:
        for _ in range(2):  # a pointer target may be that of a third of all vertices
            up = parents.select(F.col("c").alias("p"), F.col("p").alias("_p"))
            parents = looked_up(parents, "p", up, "left", n_rows=n).select("c", F.coalesce("_p", "p").alias("p"), "o")
        parents = cut(parents)
        if parents.where("p <> o").isEmpty():
            return parents.select("c", "p")
        parents = parents.select("c", "p", F.col("p").alias("o"))


def spanning_forest(edges: DataFrame, with_roots: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Minimum spanning forest of (u, v, w) edges, and (if asked) the root of every vertex that has an edge.

    Each round every component picks its lightest outgoing edge, ties by (u, v); picked edges join the forest and are
    contracted by pointer doubling, and of parallel edges between two components the lightest stays. Components at
    least halve each round. All minima are combined before the shuffle, and look-ups of a component's root go by broadcast
    for components that hold many rows, so a component with a third of all edges is no hot task. Forest and roots are tables
    in the shared folder. Loops and repeated edges do no harm.
    """
    live = cut(edges.where("u <> v").select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    roots = cut(live.select("u").union(live.select("v")).distinct().select(F.col("u").alias("vertex"), F.col("u").alias("root"))) if with_roots else None
    forest, n = None, live.count()
    while n:
        ends = live.select("w", "u", "v", F.col("a").alias("c"), F.col("b").alias("p")).union(live.select("w", "u", "v", F.col("b"), F.col("a")))
        best = cut(ends.groupBy("c").agg(F.min(F.struct("w", "u", "v", "p")).alias("e")).select("c", "e.*"))
        picked = best.select("u", "v", "w").distinct()
        forest = picked if forest is None else forest.union(picked)
        # edges are totally ordered, so pointers only ever form cycles of two; the smaller name becomes the root
        back = best.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        parents = best.join(back, (F.col("p") == F.col("_c")) & (F.col("_p") == F.col("c")), "left").select("c", F.when((F.col("_c").isNotNull()) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        top = _jump(parents, 2 * n)
        moved = looked_up(live, "a", top.toDF("a", "_a"), n_rows=n)
        moved = looked_up(moved, "b", top.toDF("b", "_b"), n_rows=n).where("_a <> _b")
        low, high = F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
        live = cut(moved.groupBy(low, high).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("e.u", "e.v", "e.w", "a", "b"))
        if with_roots:
            roots = cut(looked_up(roots, "root", top.toDF("root", "_p"), "left").select("vertex", F.coalesce("_p", "root").alias("root")))
        n = live.count()
    empty = edges.select("u", "v", "w").limit(0)
    return (cut(forest) if forest is not None else empty), roots


def entity_of(copy: str) -> Column:
    """The entity of a copy's name."""
    return F.regexp_replace(copy, "^[a-z-]+[|]", "")


def components(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Root of every entity of the rows, and the persisted spanning forest; an entity without links is its own root."""
    forest, roots = spanning_forest(cut(entity_edges(rows)))
    # copies of one entity are in one component
    of_entity = roots.groupBy(entity_of("vertex").alias("vertex")).agg(F.min("root").alias("root"))
    every = rows.select(F.explode(F.array("genome", "species")).alias("vertex")).where("vertex is not null").distinct()
    return cut(every.join(of_entity, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))), forest


def deal(sizes: DataFrame, targets: DataFrame, seed: int = 42, large: int = 1000) -> DataFrame:
    """Split of every root in (root, n), near the target shares.

    Roots that hold a thousandth of all rows or more, of which there are at most `large` = 1,000, are dealt largest
    first to the split that lacks most. All others are put into bands by the power of two of their size, and each band
    is dealt systematically: in permuted order, the place of a root on the band's running total tells its split, in
    proportion to what the splits still lack. Shares are normalised; null or negative shares count as 0.
    """
    goals = [(r["split_name"], float(max(r["target_share"] or 0, 0))) for r in targets.select("split_name", "target_share").collect() if r["split_name"]]
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    whole = sum(s for _, s in goals)
    if not goals or not whole:
        raise ValueError("targets need a split with a share above 0")
    lack = {name: share / whole * total for name, share in goals}
    is_large = F.col("n") * large >= total
    dealt = []
    for r in sorted(sizes.where(is_large).collect(), key=lambda r: (-r["n"], r["root"])):  # at most `large` roots
        name = max(lack, key=lambda s: (lack[s], s))
        lack[name] -= r["n"]
        dealt.append((r["root"], name))
    left = {s: max(x, 0.0) for s, x in lack.items()}
    rest = sum(left.values()) or 1.0
    small = running_total(sizes.where(~is_large).withColumn("band", F.floor(F.log2("n")).cast("int")), ["band"], ["root"], "n", seed, "_before")
    bands = sizes.where(~is_large).groupBy(F.floor(F.log2("n")).cast("int").alias("band")).agg(F.sum("n").alias("_band"))  # at most 63 rows
    place = (F.col("_before") + F.col("n") / 2) / F.col("_band")
    choice, edge = F.lit(max(left, key=left.get)), 1.0
    for name, x in reversed(left.items()):
        edge -= x / rest
        choice = F.when(place < edge + x / rest, F.lit(name)).otherwise(choice) if x else choice
    spread = small.join(F.broadcast(bands), "band").select("root", "n", choice.alias("split_name"))
    fixed = sizes.sparkSession.createDataFrame(dealt, "root string, split_name string")
    return spread.unionByName(sizes.where(is_large).join(F.broadcast(fixed), "root").select("root", "n", "split_name"))


def _kind() -> list[Column]:
    return [F.when(F.col("vertex").startswith("g:"), "genome").otherwise("species").alias("entity_kind"), F.substring("vertex", 3, 1 << 30).alias("entity_key")]


def assign(rows: DataFrame, membership: DataFrame, targets: DataFrame) -> DataFrame:
    """Split of every entity: (entity_kind, entity_key, root, split_name). A component goes to one split whole."""
    split = deal(component_sizes(rows, membership), targets)
    return looked_up(membership, "root", split).select(*_kind(), "root", "split_name")


def component_sizes(rows: DataFrame, membership: DataFrame) -> DataFrame:
    """(root, n): rows of every component. Rows are counted per entity first, so a component is met once for each of its entities."""
    counts = rows.groupBy(F.coalesce("genome", "species").alias("vertex")).agg(F.count("*").alias("n"))
    return cut(counts.join(membership, "vertex").groupBy("root").agg(F.sum("n").alias("n")))


def reached(rows: DataFrame, membership: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: target share and rows, rows and share it got, components, its largest component and whether that is larger than the target."""
    sizes = component_sizes(rows, membership)
    per = deal(sizes, targets).groupBy("split_name").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_components"), F.max("n").alias("largest"))
    goals = targets.where("split_name is not null").groupBy("split_name").agg(F.greatest(F.sum(F.coalesce("target_share", F.lit(0.0))), F.lit(0.0)).alias("_s"))
    total, whole = sizes.agg(F.sum("n")).scalar(), goals.agg(F.sum("_s")).scalar()
    both = goals.join(per, "split_name", "left").fillna(0, ["n_rows", "n_components", "largest"])
    goal = F.coalesce(F.try_divide(F.col("_s"), whole), F.lit(0.0))
    return both.select(
        "split_name", F.round(goal, 6).alias("target_share"), "n_rows", F.round(F.coalesce(F.try_divide(F.col("n_rows").cast("double"), total), F.lit(0.0)), 6).alias("actual_share"),
        "n_components", "largest", (F.col("largest") > F.coalesce(goal * total, F.lit(0.0))).alias("too_large"),
    )


def breaks(forest: DataFrame) -> DataFrame:
    """(entity_kind, entity_key) of the entities that the present split labels tear apart, from the spanning forest.

    Walking the forest, these are the links that lead from one labelled side of an entity to another: a genome in more than one
    of train, val and test, a species in train and in an outside split. They are lighter than all other links and form no cycle,
    so a minimum forest holds every one of them.
    """
    torn = forest.where(F.col("w") == TEARS).select(entity_of("u").alias("vertex")).distinct()
    return torn.select(*_kind())


def _rows(spark, folder):
    return cut(entity_rows(table(spark, folder, "tiny_manifest", ["genome_id", "species", "partition_label"])))


def p5_found(spark, folder):
    """What the labels of today break."""
    return breaks(spanning_forest(cut(entity_edges(_rows(spark, folder))), False)[0])


def p5_assignment(spark, folder):
    """Split of every genome and species."""
    rows = _rows(spark, folder)
    return assign(rows, components(rows)[0], table(spark, folder, "split_targets"))


def p5_shares(spark, folder):
    """Shares really reached, and components larger than a split."""
    rows = _rows(spark, folder)
    return reached(rows, components(rows)[0], table(spark, folder, "split_targets"))


def p5_forest(spark, folder):
    """The links by rows that hold the components together."""
    forest = spanning_forest(cut(entity_edges(_rows(spark, folder))), False)[0].where(F.col("w") > TIES)
    return forest.select(F.substring(entity_of("u"), 3, 1 << 30).alias("genome_id"), F.substring(entity_of("v"), 3, 1 << 30).alias("species"), (-F.col("w")).alias("n_rows"))
