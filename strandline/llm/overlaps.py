"""Same or nearly the same genomes across splits (problem 4)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import key_form, known_split, split_group
from strandline.llm.genome_bytes import content_key, coverage, parse_batch, winnow
from strandline.operators.skew import HeavyKeys, blocked_join, heavy_keys, looked_up
from strandline.runtime import broadcast_if, cut, table


@dataclass(frozen=True)
class Overlap:
    """seed: which bases of a stretch make a fingerprint, 20 of 44. Differences that stand in every n-th base (n of 20 or
    more), or in any two places of every 40, leave at least 30 % of these whole, as random ones leave 36 %; they can leave
    none of 20 bases in a row. window: winnowing; narrow: narrower windows of files of fewer bases. shorter: bases the file with
    fewer has, as a share of the other's. covered: share of its bases that stand in the other. evidence: share of its
    distinct fingerprints that the file with fewer bases has to share to be aligned; with 30 % whole, about 18 % are shared. spread: fifteenths
    of that file in which they have to stand (fewer in files of few prints): nearly equal files share them all over, those that have
    but an element in common in one place. all_over: fifteenths that are evidence by themselves, as files of repeats have few distinct prints. crowd: (train files x
    other files) of a fingerprint beyond which it is crowded. few: sequences up to which keys are broadcast. block: pairs of
    one key in a task. block_bases: bases that an aligning task is given.
    """

    seed: str = "11111000001100001010100101010000110000011111"
    window: int = 48
    narrow: tuple[tuple[int, int], ...] = ((1000, 12), (2000, 24))
    shorter: float = 0.8
    covered: float = 0.95
    evidence: float = 0.05
    spread: int = 4
    all_over: int = 12
    crowd: int = 1024
    few: int = 200_000
    block: int = 512
    block_bases: int = 1 << 25

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(i for i, c in enumerate(self.seed) if c == "1")

    def windows(self, n_bases: np.ndarray) -> np.ndarray:
        """The window of files of so many bases."""
        out = np.full(len(n_bases), self.window)
        for below, w in sorted(self.narrow, reverse=True):
            out[n_bases < below] = w
        return out


PRINTS = "sequence_path string, n_bases long, content long, n_prints int, prints array<bigint>, places array<int>, parts array<smallint>"
HOT = HeavyKeys(share=0.001)  # a fingerprint of a third of all files is some thousandths of all rows


def genome_sides(manifest: DataFrame) -> DataFrame:
    """(genome_id, in_train, in_eval): on which sides of the known splits a genome has rows."""
    side = split_group(known_split("partition_label"))
    return manifest.select("genome_id", side.alias("_side")).where("genome_id is not null and _side is not null").groupBy("genome_id").agg(F.bool_or(F.col("_side") == "train").alias("in_train"), F.bool_or(F.col("_side") != "train").alias("in_eval"))


def fingerprints(files: DataFrame, how: Overlap) -> DataFrame:
    """Of every file: bases, content key (neither case, layout, order nor strand of records change it), winnowed prints and how many differ.

    A print's place is its first base, negative (-1 - place) where the other strand has the smaller code.
    """

    shape = how.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                bases, offsets, records, owner = parse_batch([bytes(x) for x in part["fasta"]])
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                h, seq, place, flip = winnow(bases, offsets, shape, how.windows(np.diff(offsets)))
                # a print that a file has several times counts once, at its first place
                by = np.lexsort((place, h, seq))
                new = np.append(True, (np.diff(seq[by]) != 0) | (np.diff(h[by]) != 0))[: len(by)]
                # one bit for each fifteenth of the file in which a print stands
                bits = np.int32(1) << (place[by] * 15 // np.maximum(np.diff(offsets), 1)[seq[by]]).astype(np.int32)
                bits = (np.bitwise_or.reduceat(bits, np.flatnonzero(new)) if len(by) else bits).astype(np.int16)
                h, seq = h[by][new], seq[by][new]
                place = np.where(flip, -1 - place, place).astype(np.int32)[by][new]
                bounds = np.searchsorted(seq, np.arange(len(part) + 1))
                yield pd.DataFrame({
                    "sequence_path": part["sequence_path"].to_numpy(),
                    "n_bases": np.diff(offsets),
                    "content": [content_key(bases, offsets[i], offsets[i + 1], records[cuts[i] : cuts[i + 1]]) for i in range(len(part))],
                    "n_prints": np.diff(bounds),
                    "prints": [h[a:b] for a, b in zip(bounds[:-1], bounds[1:])],
                    "places": [place[a:b] for a, b in zip(bounds[:-1], bounds[1:])],
                    "parts": [bits[a:b] for a, b in zip(bounds[:-1], bounds[1:])],
                })

    return files.select("sequence_path", F.col("fasta").cast("binary").alias("fasta")).where("fasta is not null").mapInPandas(run, PRINTS)


def _classes(printed: DataFrame, owners: DataFrame) -> DataFrame:
    """(sequence_path, class, in_train, in_eval) of the files that a genome of a known split names.

    Files of equal content are one class, so copies, however many, are compared with others once.
    """
    sides = owners.groupBy("sequence_path").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_eval").alias("in_eval"))
    return printed.select("sequence_path", F.col("content").alias("class")).join(sides, "sequence_path")


def candidates(printed: DataFrame, classes: DataFrame, how: Overlap) -> DataFrame:
    """Pairs (a, b) of classes on both sides of the split that share enough collinear fingerprints to be aligned.

    Fingerprints of one side are joined with those of the other. A crowded fingerprint, such as a mobile element in
    thousands of genomes, would join all of these with each other, so it is joined only where it can decide, which
    loses no pair. A pair that shares crowded prints only has to have the evidence in these alone, so the class with
    fewer bases is rich: its crowded prints reach the evidence, and stand in as many parts of it as are asked for. Rich classes are joined by all their prints. Where
    neither class is rich, a pair shares a print that is not crowded too; its crowded ones are looked up for that pair.
    """
    total = printed.agg(F.sum("n_prints")).first()[0] or 0
    parts = max(int(printed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 250_000)  # some megabytes a task

    def seeds_of(df: DataFrame) -> DataFrame:
        """A row for each print of a file; place and parts share one number, as this is what is moved most."""
        spot = F.shiftleft(F.col("_s.places").cast("long"), 16).bitwiseOR(F.col("_s.parts").cast("long"))
        return df.select(F.col("content").alias("class"), F.explode(F.arrays_zip("prints", "places", "parts")).alias("_s")).select("class", F.col("_s.prints").alias("print"), spot.alias("spot"))

    seeds = seeds_of(printed)
    # prints that many files hold are told apart by a sample, as the shuffle by print would put each into one task
    hot = cut(heavy_keys(seeds_of(printed.sample(0.1, 7)), ["print"], HOT))
    is_hot = F.xxhash64("print") == F.col("_heavy")
    # nearly all other prints are of one class only: one shuffle serves to find the others and to keep their rows
    rest = seeds.join(F.broadcast(hot), is_hot, "left_anti").repartition(parts, "print")
    # the checksum makes this side read every column, so that both sides of the join read the same shuffle
    several = rest.groupBy("print").agg(F.min("class").alias("_low"), F.max("class").alias("_high"), F.bit_xor(F.xxhash64(*rest.columns)).alias("_sum")).where("_low <> _high")
    met_twice = rest.join(several.select("print", "_sum"), "print").drop("_sum").unionByName(seeds.join(F.broadcast(hot), is_hot, "left_semi"))
    # copies of one content are one class
    place, part = F.shiftright("spot", 16).cast("int"), F.col("spot").bitwiseAND(F.lit(0x7FFF)).cast("int")
    own = cut(met_twice.groupBy("class", "print").agg(F.min(place).alias("place"), F.bit_or(part).alias("part")))
    sizes = printed.groupBy(F.col("content").alias("class")).agg(F.max("n_bases").alias("n_bases"), F.max("n_prints").alias("n_prints"))
    sides = classes.groupBy("class").agg(F.bool_or("in_train").alias("in_train"), F.bool_or("in_eval").alias("in_eval")).join(sizes, "class")
    own = cut(own.join(sides, "class"))
    counts = cut(own.groupBy("print").agg(F.count_if("in_train").alias("_t"), F.count_if("in_eval").alias("_e"), F.count("*").alias("_all")).where("_t > 0 and _e > 0 and _all > 1").select("print", (F.col("_t") * F.col("_e") > how.crowd).alias("crowded")))
    shared = cut(looked_up(own, "print", counts, how=HOT))
    load = shared.where("crowded").groupBy("class", "n_prints").agg(F.count("*").alias("_c"), F.bit_or("part").alias("_parts"))

    def enough(n: str) -> Column:
        parts = F.bit_count("_parts")
        return ((F.col("_c") >= F.greatest(F.lit(1.0), how.evidence * F.col(n))) & (parts >= F.least(F.lit(how.spread), F.floor(F.col(n) / 8)))) | (parts >= how.all_over)

    rich_classes = cut(load.where(enough("n_prints")).select("class"))
    fields = ["class", "place", "n_bases", "n_prints", "part"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("print", *[F.col(c).alias(f"{c}_{name}") for c in fields])

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        return shares(blocked_join(side(left, "a"), side(right, "b"), "print", how.block))

    def shares(joined: DataFrame) -> DataFrame:
        longer, shorter = F.greatest("n_bases_a", "n_bases_b"), F.least("n_bases_a", "n_bases_b")
        flip = (F.col("place_a") < 0) != (F.col("place_b") < 0)
        at_a, at_b = (F.when(F.col(c) < 0, -1 - F.col(c)).otherwise(F.col(c)) for c in ("place_a", "place_b"))
        diagonal = F.when(flip, at_a + at_b).otherwise(at_a - at_b)
        both = joined.where((F.col("class_a") != F.col("class_b")) & (shorter >= longer * how.shorter))
        swap, fewer = F.col("class_a") > F.col("class_b"), F.struct("n_bases_a", "class_a") < F.struct("n_bases_b", "class_b")
        return both.select(
            F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), F.col("print"), F.when(fewer, F.col("n_prints_a")).otherwise(F.col("n_prints_b")).alias("n"), F.when(fewer, F.col("part_a")).otherwise(F.col("part_b")).alias("part"),
            flip.alias("flip"), F.floor(F.when(swap & ~flip, -diagonal).otherwise(diagonal) / 64).alias("band"),
        )

    plain, thick = shared.where("not crowded"), shared.where("crowded")
    rich, scarce = cut(thick.join(rich_classes, "class", "left_semi")), thick.join(rich_classes, "class", "left_anti")
    open_pairs = cut(shares(side(plain.where("in_train"), "a").join(side(plain.where("in_eval"), "b"), "print")))  # at most `crowd` pairs of a print
    on_a, on_b = side(scarce, "a").withColumnRenamed("print", "print_a"), side(scarce, "b")
    looked = open_pairs.select("a", "b").distinct().join(on_a, F.col("a") == F.col("class_a")).join(on_b, (F.col("b") == F.col("class_b")) & (F.col("print_a") == F.col("print")))
    pairs = open_pairs.unionByName(shares(looked)).unionByName(met(rich.where("in_train"), thick.where("in_eval"))).unionByName(met(thick.where("in_train"), rich.where("in_eval")))
    # a chain: prints of one strand and one band of diagonals; single prints count only where a class has few
    chains = pairs.groupBy("a", "b", "flip", "band").agg(F.count_distinct("print").alias("_c"), F.max("n").alias("n"), F.bit_or("part").alias("_parts"))
    whole = chains.groupBy("a", "b").agg(F.sum("_c").alias("_c"), F.max("_c").alias("_best"), F.max("n").alias("n"), F.bit_or("_parts").alias("_parts"))
    return cut(whole.where(enough("n") & ((F.col("_best") > 1) | (F.col("n") < 20) | (F.bit_count("_parts") >= how.all_over))).select("a", "b"))


def aligned(pairs: DataFrame, classes: DataFrame, files: DataFrame, how: Overlap) -> DataFrame:
    """Pairs whose alignment covers enough of the file with fewer bases: (a, b, n_bases, matched).

    Pairs are dealt to a grid of blocks by both classes, and a text goes once to every block that needs it: so the texts of
    m files that all resemble each other move about m x 2 sqrt(blocks) times and not m x m times. Blocks that get more than `block_bases`
    bases are cut further, so a file with very many partners fills no task.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    paths = cut(needed.join(classes, "class").groupBy("class").agg(F.min("sequence_path").alias("sequence_path")))
    rows = paths.count()
    raw = files.select("sequence_path", F.col("fasta").cast("binary").alias("fasta")).join(broadcast_if(paths, rows, how.few), "sequence_path").select("class", "fasta")
    text = cut(raw.dropDuplicates(["class"]))
    sizes = text.select("class", F.octet_length("fasta").cast("long").alias("n"))
    sized = pairs.join(sizes.toDF("a", "_na"), "a").join(sizes.toDF("b", "_nb"), "b").withColumn("_n", F.col("_na") + F.col("_nb"))
    sized = cut(sized)
    total = sized.agg(F.sum("_n")).first()[0] or 0
    grid = max(1, int(np.ceil(np.sqrt(2 * total / how.block_bases))))
    sized = sized.withColumn("_x", F.pmod(F.xxhash64("a"), F.lit(grid))).withColumn("_y", F.pmod(F.xxhash64("b"), F.lit(grid)))
    heavy = sized.groupBy("_x", "_y").agg(F.ceil(F.sum("_n") / how.block_bases).alias("_cuts"))
    placed = cut(sized.join(heavy, ["_x", "_y"]).select("a", "b", F.concat_ws(",", "_x", "_y", F.pmod(F.xxhash64("a", "b"), "_cuts")).alias("block")))
    sent = placed.select(F.col("block").alias("to"), F.explode(F.array("a", "b")).alias("class")).distinct().join(text, "class")

    def run(pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        held = {c: parse_batch([bytes(t)])[0] for c, t in zip(texts["class"], texts["fasta"])}
        out = []
        for a, b in zip(pairs["a"], pairs["b"]):
            p, q = sorted((held[a], held[b]), key=len)
            out.append((a, b, len(p), coverage(p, q)))
        return pd.DataFrame(out, columns=["a", "b", "n_bases", "matched"])

    found = placed.groupBy("block").cogroup(sent.groupBy("to")).applyInPandas(run, "a long, b long, n_bases long, matched long")
    return found.where(F.col("matched") >= F.col("n_bases") * how.covered)


def near_classes(manifest: DataFrame, files: DataFrame, how: Overlap = Overlap()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sides of genomes, what each owns, class of every file that a known split names, and pairs of classes that are nearly the same."""
    sides = genome_sides(manifest)
    owned = manifest.select("genome_id", "sequence_path").where("genome_id is not null and sequence_path is not null").distinct()
    owners = cut(owned.join(sides, "genome_id"))
    printed = cut(fingerprints(files, how).where("n_bases > 0"))
    classes = cut(_classes(printed, owners))
    return sides, owners, classes, cut(aligned(candidates(printed, classes, how), classes, files, how))


def cross_split_pairs(manifest: DataFrame, files: DataFrame, how: Overlap = Overlap()) -> DataFrame:
    """(genome_id_a, genome_id_b, coverage) of all genomes in train and a val or test split with the same or nearly the same file.

    genome_id_a <= genome_id_b as byte strings. coverage is the share of the bases of the file with fewer that an
    alignment finds in the other; 1 for equal content, for the same path and for a genome on both sides, which pairs
    with itself. A genome has the path of any of its rows. A file without bases matches nothing by content; a path
    that names no file still matches itself. Rows with a null genome_id are left out; null paths match nothing;
    repeated rows count once. A file with fewer bases than the seed spans, or without any seed free of N, is found by equal content only.
    """
    sides, owners, classes, found = near_classes(manifest, files, how)
    # what a genome holds: contents, and paths as such
    holds = cut(owners.join(classes.select("sequence_path", "class"), "sequence_path", "left").select("genome_id", "in_train", "in_eval", "sequence_path", "class"))
    content = cut(holds.where("class is not null").select("genome_id", "in_train", "in_eval", "class").distinct())
    opposite = (F.col("train_x") & F.col("eval_y")) | (F.col("eval_x") & F.col("train_y"))

    def side(df: DataFrame, key: str, name: str, to: str) -> DataFrame:
        return df.select(F.col(key).alias(to), F.col("genome_id").alias(f"genome_{name}"), F.col("in_train").alias(f"train_{name}"), F.col("in_eval").alias(f"eval_{name}"))

    def pair(x: DataFrame, share: Column) -> DataFrame:
        return x.select(F.least("genome_x", "genome_y").alias("genome_id_a"), F.greatest("genome_x", "genome_y").alias("genome_id_b"), share.alias("coverage"))

    whole = F.lit(1.0)

    def within(df: DataFrame, key: str) -> DataFrame:
        return pair(blocked_join(side(df.where("in_train"), key, "x", "_key"), side(df.where("in_eval"), key, "y", "_key"), "_key", how.block), whole)

    of_a = cut(blocked_join(found, side(content, "class", "x", "a"), "a", how.block))
    near = blocked_join(of_a, side(content, "class", "y", "b"), "b", how.block).where(opposite)
    same_path = within(holds.where("class is null"), "sequence_path")
    itself = sides.where("in_train and in_eval").select(F.col("genome_id").alias("genome_id_a"), F.col("genome_id").alias("genome_id_b"), whole.alias("coverage"))
    every = pair(near, F.col("matched") / F.col("n_bases")).unionByName(within(content, "class")).unionByName(same_path).unionByName(itself)
    return every.groupBy("genome_id_a", "genome_id_b").agg(F.max("coverage").alias("coverage"))


def members(manifest: DataFrame, files: DataFrame, how: Overlap = Overlap()) -> DataFrame:
    """(sequence_path, class, n_links): the class of equal content of every file of a known split, and how many other classes it is nearly the same as.

    With `near_classes` this says what the pairs of genomes say, in a table as long as the files.
    """
    _, _, classes, found = near_classes(manifest, files, how)
    links = found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return looked_up(classes.select("sequence_path", "class"), "class", links, "left").select("sequence_path", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(pairs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per partition_label (key form, known) and source_dataset: genomes, and those with an overlap across the split."""
    hit = pairs.select(F.explode(F.array("genome_id_a", "genome_id_b")).alias("genome_id")).distinct().withColumn("_hit", F.lit(1))
    rows = manifest.select("genome_id", known_split("partition_label").alias("partition_label"), key_form("source_dataset").alias("source_dataset")).where("genome_id is not null and partition_label is not null").distinct()
    return rows.join(hit, "genome_id", "left").groupBy("partition_label", "source_dataset").agg(F.count("*").alias("n_genomes"), F.count("_hit").alias("n_overlapping"))


def _pairs(spark, folder):
    manifest = table(spark, folder, "tiny_manifest", ["genome_id", "sequence_path", "partition_label"])
    return cross_split_pairs(manifest, table(spark, folder, "sequences", ["sequence_path", "fasta"]))


def p4_found(spark, folder):
    """All pairs."""
    return _pairs(spark, folder).select("genome_id_a", "genome_id_b")


def p4_pairs(spark, folder):
    """All pairs with their coverage."""
    return _pairs(spark, folder)


def p4_report(spark, folder):
    """Overlaps per split and source."""
    return overlap_report(_pairs(spark, folder), table(spark, folder, "tiny_manifest", ["genome_id", "partition_label", "source_dataset"]))


def p4_members(spark, folder):
    """Every file with its class of equal content and the number of classes it is nearly the same as."""
    return members(table(spark, folder, "tiny_manifest", ["genome_id", "sequence_path", "partition_label"]), table(spark, folder, "sequences", ["sequence_path", "fasta"]))
