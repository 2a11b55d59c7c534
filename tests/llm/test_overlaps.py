import random

import numpy as np
import pytest

from strandline.llm import overlaps as ov
from strandline.llm.genome_bytes import content_key, coverage, parse_batch, reverse_complement, winnow

MANIFEST = "genome_id string, sequence_path string, partition_label string, source_dataset string, class string"
FILES = "sequence_path string, fasta string, content string"


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutated(rng, s, share):
    out = list(s)
    for i in rng.sample(range(len(s)), int(len(s) * share)):
        out[i] = rng.choice([c for c in "ACGT" if c != out[i]])
    return "".join(out)


def flip(s):
    return reverse_complement(s.encode()).decode()


def arr(s):
    return np.frombuffer(s.encode(), np.uint8)


def test_parse_batch():
    b, offsets, records, owner = parse_batch([b">a\nac gt\r\n>b\nNN\n", b"", b"\n", b"TT>x\n>c\nA"])
    assert b.tobytes() == b"ACGTNNTTXA" and offsets.tolist() == [0, 6, 6, 6, 10]
    assert records.tolist() == [0, 4, 6, 9] and owner.tolist() == [0, 0, 3, 3]


def test_content_key_ignores_order_and_strand():
    rng = random.Random(1)
    x, y = bases(rng, 50), bases(rng, 70)
    keys = set()
    for text in (f">1\n{x}\n>2\n{y}", f">q\n{flip(y).lower()}\n>r\n{x}\n"):
        b, offsets, records, _ = parse_batch([text.encode()])
        keys.add(content_key(b, offsets[0], offsets[1], records))
    assert len(keys) == 1


SHAPE = ov.Overlap().shape


@pytest.mark.parametrize("seed", [11, 16, 20, 31, SHAPE])
def test_winnow_shares_prints_of_common_stretches(seed):
    k = seed if isinstance(seed, int) else seed[-1] + 1
    rng = random.Random(k)
    common = bases(rng, k + 30)
    texts = [bases(rng, 100) + common + bases(rng, 90), bases(rng, 70) + flip(common), "ACG", "N" * 200]
    b, offsets, _, _ = parse_batch([t.encode() for t in texts])
    h, seq, place, _ = winnow(b, offsets, seed, 30)
    assert set(h[seq == 0]) & set(h[seq == 1])
    assert not (seq >= 2).any()
    alone = winnow(*parse_batch([texts[1].encode()])[:2], seed, 30)
    assert sorted(h[seq == 1]) == sorted(alone[0])  # a file's prints don't depend on its neighbours
    assert all(0 <= p <= len(texts[s]) - k for s, p in zip(seq, place))


def test_wide_windows_choose_among_the_prints_of_narrow_ones():
    rng = random.Random(12)
    b, offsets, _, _ = parse_batch([bases(rng, n).encode() for n in (700, 30, 1500, 3000)])
    sets = {}
    for w in (6, 12, 48, np.array([6, 12, 12, 48])):
        h, seq, place, _ = winnow(b, offsets, SHAPE, w)
        assert (np.diff(seq * 10_000 + place) > 0).all()
        sets[str(w)] = {*zip(seq.tolist(), h.tolist())}
    assert sets["48"] < sets["12"] < sets["6"]
    assert sets["[ 6 12 12 48]"] == {x for x in sets["6"] if x[0] == 0} | {x for x in sets["12"] if x[0] in (1, 2)} | {x for x in sets["48"] if x[0] == 3}


def test_seed_reads_the_same_from_both_ends_and_survives_regular_differences():
    assert len(SHAPE) == 20 and [SHAPE[-1] - p for p in reversed(SHAPE)] == list(SHAPE)
    for period, places in [(n, [0]) for n in range(20, 60)] + [(40, [0, d]) for d in range(1, 21)]:
        assert len({(m - p) % period for m in places for p in SHAPE}) <= 0.7 * period + 1e-9


def test_coverage():
    rng = random.Random(2)
    x = bases(rng, 2000)
    assert coverage(arr(x), arr(x)) == 2000
    assert coverage(arr(x), arr(flip(x[1200:]) + x[:1200])) >= 1990
    assert 0.94 < coverage(arr(mutated(rng, x, 0.05)), arr(x)) / 2000 < 0.965
    shorter = x[:700] + x[730:]
    assert coverage(arr(shorter), arr(x)) / len(shorter) > 0.99
    assert coverage(arr(bases(rng, 2000)), arr(x)) / 2000 < 0.1
    assert coverage(arr("ACGTTTGA"), arr(x + "ACGTTTGA")) == 8


def test_pairs_against_known_cases(spark):
    rng = random.Random(3)
    a, element = bases(rng, 1500), bases(rng, 500)
    near, far, short = mutated(rng, a, 0.03), mutated(rng, a, 0.12), a[:1100]
    b = bases(rng, 1200)
    seqs = {
        "a": a, "near": flip(near), "far": far, "short": short, "b": b, "empty": "",
        "recut": b[700:] + "\n>z\n" + b[:700], "nested": a[:1300],
    }
    files = [(p, f">h {p}\n" + "\n".join(s.lower()[i : i + 60] if ">" not in s else s for i in ([0] if ">" in s else range(0, max(len(s), 1), 60))), None) for p, s in seqs.items()]
    carriers = [(f"c{i}", ">c\n" + bases(rng, 900) + element + bases(rng, 900), None) for i in range(12)]
    rows = [
        ("ga", "a", "train"), ("gn", "near", "val_outside"), ("gf", "far", "test_outside"), ("gs", "short", "test_outside"), ("gb", "b", "Val-Overlapped"), ("gr", "recut", " TRAIN"),
        ("ge", "empty", "train"), ("gm", "missing", "train"), ("gm2", "missing", "test_outside"), ("both", None, "train"), ("both", None, "test_overlapped"),
        ("gx", "nested", "test_overlapped"), ("gx", "nested", "test_overlapped"), (None, "a", "test_outside"), ("gu", "a", "holdout"), ("gv", "near", None), ("ge2", "empty", "val_outside"),
        ("multi", "a", "unassigned"), ("multi", "b", "train"), ("1.1", "a", "val_outside"), ("1.10", "b", "train"),
    ] + [(f"gc{i}", f"c{i}", "train" if i % 2 else "val_outside") for i in range(12)]
    manifest = spark.createDataFrame([(*r, "src", "k") for r in rows], MANIFEST)
    found = ov.cross_split_pairs(manifest, spark.createDataFrame(files + carriers, FILES), ov.Overlap(crowd=8)).collect()
    got = {(r["genome_id_a"], r["genome_id_b"]) for r in found}
    expected = {
        ("ga", "gn"), ("ga", "gx"), ("1.1", "ga"), ("gb", "gr"), ("gb", "multi"), ("1.10", "gb"), ("gm", "gm2"), ("both", "both"), ("ge", "ge2"),
        ("gn", "multi"), ("gx", "multi"), ("gx", "multi"), ("1.1", "multi"),
    }
    expected = {tuple(sorted(p)) for p in expected}
    assert got == expected
    assert all(0.95 <= r["coverage"] <= 1 for r in found)
    report = {r["partition_label"]: (r["n_genomes"], r["n_overlapping"]) for r in ov.overlap_report(spark.createDataFrame(list(got), "genome_id_a string, genome_id_b string"), manifest).collect()}
    assert report["test_outside"] == (3, 1)


def test_mostly_crowded_classes_are_still_found(spark):
    rng = random.Random(4)
    base = bases(rng, 1000)
    files = [(f"p{i}", ">x\n" + mutated(rng, base, 0.01), None) for i in range(10)]
    manifest = spark.createDataFrame([(f"g{i}", f"p{i}", "train" if i < 5 else "test_outside", None, None) for i in range(10)], MANIFEST)
    got = ov.cross_split_pairs(manifest, spark.createDataFrame(files, FILES), ov.Overlap(crowd=1)).collect()
    assert len(got) == 25


def test_family_of_near_copies_is_found_through_crowded_prints(spark):
    rng = random.Random(7)
    base = bases(rng, 1500)
    seqs = [mutated(rng, base, rng.uniform(0.02, 0.025)) for _ in range(28)]
    files = spark.createDataFrame([(f"p{i}", ">x\n" + s, None) for i, s in enumerate(seqs)], FILES)
    manifest = spark.createDataFrame([(f"g{i:02}", f"p{i}", "train" if i < 14 else "test_outside", None, None) for i in range(28)], MANIFEST)
    got = {(r[0], r[1]) for r in ov.cross_split_pairs(manifest, files, ov.Overlap(crowd=64)).collect()}
    near = {(f"g{i:02}", f"g{j:02}") for i in range(14) for j in range(14, 28) if coverage(arr(seqs[i]), arr(seqs[j])) >= 0.95 * 1500}
    assert len(near) > 100 and got == near


@pytest.mark.parametrize("crowd, evidence", [(1, 0.08), (4, 0.2), (4, 0.35), (30, 0.2)])
def test_crowds_change_no_candidate(spark, crowd, evidence):
    rng = random.Random(8)
    base, element = bases(rng, 1500), bases(rng, 500)
    parts = [bases(rng, 1000) for _ in range(4)]
    seqs = [mutated(rng, base, 0.03) for _ in range(10)] + [mutated(rng, rng.choice(parts), 0.04) + element[: rng.randint(100, 500)] for _ in range(16)]
    files = spark.createDataFrame([(f"p{i}", ">x\n" + s, None) for i, s in enumerate(seqs)], FILES)
    how = [ov.Overlap(crowd=c, evidence=evidence) for c in (crowd, 1 << 40)]
    printed = ov.fingerprints(files, how[0]).cache()
    owners = spark.createDataFrame([(f"p{i}", i % 2 == 0, i % 2 == 1 or i % 7 == 0) for i in range(len(seqs))], "sequence_path string, in_train boolean, in_eval boolean")
    classes = ov._classes(printed, owners)
    some, every = ({(r["a"], r["b"]) for r in ov.candidates(printed, classes, h).collect()} for h in how)
    assert every and some == every


def test_files_of_repeats_are_found(spark):
    rng = random.Random(9)
    files, rows = [], []
    for n, (unit, times) in enumerate([(200, 20), (100, 30), (48, 60)]):
        base = bases(rng, unit) * times
        for i in range(6):
            files.append((f"p{n}_{i}", ">x\n" + mutated(rng, base, 0.015 * (i % 2) + 0.0005 * i), None))
            rows.append((f"g{n}_{i}", f"p{n}_{i}", "train" if i < 3 else "test_outside", None, None))
    got = {(r[0], r[1]) for r in ov.cross_split_pairs(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, FILES)).collect()}
    assert got == {(f"g{n}_{i}", f"g{n}_{j}") for n in range(3) for i in range(3) for j in range(3, 6)}


def regular(s, step, start=0):
    """Every step-th base changed."""
    return "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] if i >= start and (i - start) % step == step - 1 else c for i, c in enumerate(s))


def found_of(spark, pairs, others=()):
    """Which of the planted (train text, test text) pairs are found, among other texts of train."""
    files = [(f"{side}{i}", ">x\n" + t, None) for i, pair in enumerate(pairs) for side, t in zip("ab", pair)] + [(f"o{i}", ">o\n" + t, None) for i, t in enumerate(others)]
    rows = [(f"{side}{i:04}", f"{side}{i}", split, None, None) for i in range(len(pairs)) for side, split in (("a", "train"), ("b", "test_outside"))]
    rows += [(f"o{i:04}", f"o{i}", "train" if i % 2 else "val_outside", None, None) for i in range(len(others))]
    got = {(r[0], r[1]) for r in ov.cross_split_pairs(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, FILES)).collect()}
    return [i for i in range(len(pairs)) if (f"a{i:04}", f"b{i:04}") in got]


def test_regular_differences_are_found(spark):
    rng = random.Random(20)
    texts = [bases(rng, n) for n in [300, 600, 900, 1400, 2000, 2600, 3500, 6000] for _ in range(10)]
    pairs = [(t, regular(t, 20)) for t in texts]
    true = [i for i, (x, y) in enumerate(pairs) if coverage(arr(x), arr(y)) >= 0.95 * len(x)]
    found = found_of(spark, pairs)
    assert len(true) > 70 and len(set(true) & set(found)) >= 0.99 * len(true) and all(i in true for i in found)


def test_pairs_that_share_an_element_of_many_files_are_found(spark):
    rng = random.Random(21)
    element = bases(rng, 1000)
    pairs = []
    for _ in range(20):
        own = bases(rng, 1200)
        pairs.append((own + element, regular(own, 12) + element))
    assert all(coverage(arr(x), arr(y)) >= 0.95 * 2200 for x, y in pairs)
    carriers = [bases(rng, rng.randint(800, 1400)) + element + bases(rng, rng.randint(300, 900)) for _ in range(66)]
    assert found_of(spark, pairs, carriers) == list(range(20))


def test_recall_against_brute_force(spark):
    rng = random.Random(22)
    roots = [bases(rng, rng.choice([350, 700, 1200, 2500])) for _ in range(24)]
    texts = []
    for i in range(120):
        s = mutated(rng, roots[i % 24], rng.choice([0.0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05]))
        s = s[rng.randint(0, len(s) // 8) :]
        turn = rng.randint(0, len(s))
        texts.append(rng.choice([s, flip(s), s[turn:] + s[:turn], s[:turn] + flip(s[turn:])]))
    files = spark.createDataFrame([(f"p{i}", ">x\n" + t, None) for i, t in enumerate(texts)], FILES)
    manifest = spark.createDataFrame([(f"g{i:03}", f"p{i}", rng.choice(["train", "test_outside"]), None, None) for i in range(120)], MANIFEST)
    side = {r[0]: r[2] for r in manifest.collect()}
    true = set()
    for i in range(120):
        for j in range(i + 1, 120):
            x, y = sorted((texts[i], texts[j]), key=len)
            if side[f"g{i:03}"] != side[f"g{j:03}"] and len(x) >= 0.8 * len(y) and coverage(arr(x), arr(y)) >= 0.95 * len(x):
                true.add((f"g{i:03}", f"g{j:03}"))
    got = {(r[0], r[1]) for r in ov.cross_split_pairs(manifest, files).collect()}
    assert len(true) > 60 and got <= true and len(got) >= 0.99 * len(true)


def test_blocks_of_one_key_give_every_pair_once(spark):
    rng = random.Random(23)
    base = bases(rng, 900)
    files = [(f"p{i}", ">x\n" + (base if i < 30 else mutated(rng, base, 0.01)), None) for i in range(40)]
    rows = [(f"g{i:02}", f"p{i}", "train" if i % 2 else "val_outside", None, None) for i in range(40)]
    got = [(r[0], r[1]) for r in ov.cross_split_pairs(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, FILES), ov.Overlap(crowd=2, block=3, block_bases=4000)).collect()]
    assert len(got) == len(set(got)) == 400
    links = {r["sequence_path"]: (r["class"], r["n_links"]) for r in ov.members(spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(files, FILES)).collect()}
    assert len(links) == 40 and len({c for c, _ in links.values()}) == 11 and links["p0"] == links["p29"] == (links["p0"][0], 10)


def test_empty_tables(spark):
    manifest, files = spark.createDataFrame([], MANIFEST), spark.createDataFrame([], FILES)
    assert ov.cross_split_pairs(manifest, files).count() == 0
    one = spark.createDataFrame([("g", "p", "train", None, None), ("h", "p", "val_outside", None, None)], MANIFEST)
    assert [(r[0], r[1]) for r in ov.cross_split_pairs(one, files).collect()] == [("g", "h")]
